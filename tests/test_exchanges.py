"""Exchanges of parcels do not depend on how many parcels are free."""

import numpy as np
import pytest

from urbanloom.operators import allocation, contiguity


def _plan(kind, side, seed):
    rng, n = np.random.default_rng(seed), side * side
    near = [[(m, 5.0) for m in (p - 1 if p % side else -1, p + 1 if p % side < side - 1 else -1, p - side, p + side) if 0 <= m < n] for p in range(n)]
    return kind(rng.choice([10.0, 20.0], n), rng.integers(1, 50, (n, 3)).astype(float), np.array([300.0, 200.0, 250.0]), np.full(n, -1), near, 30.0)


def _every_pair(plan):
    """All exchanges of two parcels one after the other, as the operator says; their number."""
    whole, changes = isinstance(plan, contiguity.Regions), 0
    for i, p in enumerate(plan.free.tolist()):
        for q in plan.free[i + 1 :].tolist():
            a, b = plan.use[p], plan.use[q]
            d = plan.area[p] - plan.area[q]
            if a == b or a < 0 or b < 0 or d > plan.left[b] + 1e-9 or -d > plan.left[a] + 1e-9:
                continue
            if whole and not (any(plan.use[n] == b and n != q for n, _ in plan.near[p]) and any(plan.use[n] == a and n != p for n, _ in plan.near[q])):
                continue
            old = plan.gain(p, a) + plan.gain(q, b)
            plan.use[p], plan.use[q] = b, a
            if plan.gain(p, b) + plan.gain(q, a) > old + (contiguity.LEAST if whole else 1e-9) and (not whole or (plan.whole(a) and plan.whole(b))):
                plan.left[a] += d
                plan.left[b] -= d
                changes += 1
            else:
                plan.use[p], plan.use[q] = a, b
    return changes


@pytest.mark.parametrize("seed", range(4))
def test_exchanges_are_those_of_all_pairs(seed):
    found = 0
    for kind, step in ((allocation.Plan, "_exchange"), (contiguity.Regions, "_swap")):
        got, want = (_plan(kind, 9, seed) for _ in range(2))
        for plan in (got, want):
            # Two thirds of the parcels in use, at random or in bands.
            plan.left[:] = 1000.0
            plan.use[:] = np.random.default_rng(seed).integers(-1, 3, 81) if kind is allocation.Plan else np.arange(81) // 9 // 3
        changes = [getattr(got, step)(), _every_pair(want)]
        assert changes[0] == changes[1] and (got.use == want.use).all() and (got.left == want.left).all()
        found += changes[0]
    assert found


def test_many_free_parcels_are_exchanged_too():
    for seed in range(3):
        plan = _plan(allocation.Plan, 40, seed)
        plan.fill()
        plan.improve()
        assert _every_pair(plan) == 0
        plan = _plan(contiguity.Regions, 40, seed)
        plan.seed()
        assert plan.grow() is not None
        plan.improve()
        assert _every_pair(plan) == 0
