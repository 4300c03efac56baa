"""Land use in whole regions: each use of a study area is one connected set of parcels.

Uses grow from a seed, in turn, by the best parcel on their border; then single parcels and pairs change their use while
that raises the plan's value and leaves every region whole. A parcel may leave a region only if it is no articulation
point of it. Study areas are planned apart, each in a task of its own (at most allocation.PARCELS parcels, counted first).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.operators import allocation

#: Rounds of the search; gains up to this count as none.
ROUNDS, LEAST = 50, 1e-12


class Regions(allocation.Plan):
    """A plan whose uses are connected sets of parcels."""

    def seed(self) -> None:
        """Each use without a locked parcel starts at the free parcel that suits it best (ties: the first)."""
        for u in range(len(self.left)):
            open_ = np.flatnonzero(self.use < 0)
            if not (self.use == u).any() and open_.size:
                self.give(int(open_[np.argmax(self.suit[open_, u])]), u)

    def give(self, parcel: int, use: int) -> None:
        if self.use[parcel] >= 0:
            self.left[self.use[parcel]] += self.area[parcel]
        self.use[parcel] = use
        self.left[use] -= self.area[parcel]

    def grow(self) -> bool:
        """Uses with area left take the parcel beside them that is worth most (suitability times area and the border
        with the region), in turn. Whether every target was reached that free parcels beside a region could fill."""
        border: list[dict[int, float]] = [{} for _ in self.left]

        def reach(parcel: int, use: int) -> None:
            for n, length in self.near[parcel]:
                if self.use[n] < 0:
                    border[use][n] = border[use].get(n, 0.0) + length

        for p in np.flatnonzero(self.use >= 0).tolist():
            reach(p, int(self.use[p]))
        moved = True
        while moved:
            moved = False
            for u, left in enumerate(self.left.tolist()):
                open_ = [(self.suit[p, u] * self.area[p] + self.weight * shared, -p) for p, shared in border[u].items() if self.use[p] < 0]
                if left > allocation.TOLERANCE and open_:
                    parcel = -max(open_)[1]
                    self.give(parcel, u)
                    reach(parcel, u)
                    moved = True
        return not (self.left > allocation.TOLERANCE).any()

    def whole(self, use: int, without: int = -1, with_: int = -1) -> bool:
        """Whether a region without one parcel, and with another, hangs together."""
        held = set(np.flatnonzero(self.use == use).tolist()) - {without}
        if with_ >= 0:
            held.add(with_)
        if len(held) < 2:
            return True
        start = next(iter(held))
        seen, todo = {start}, [start]
        while todo:
            for n, _ in self.near[todo.pop()]:
                if n in held and n not in seen:
                    seen.add(n)
                    todo.append(n)
        return len(seen) == len(held)

    def articulation(self, parcel: int) -> bool:
        """Whether the parcel's region falls apart without it: its neighbours in it reach one another only through it."""
        use = self.use[parcel]
        ends = {n for n, _ in self.near[parcel] if self.use[n] == use}
        if len(ends) < 2:
            return False
        start = ends.pop()
        seen, todo = {start, parcel}, [start]
        while todo and ends:
            for n, _ in self.near[todo.pop()]:
                if self.use[n] == use and n not in seen:
                    seen.add(n)
                    ends.discard(n)
                    todo.append(n)
        return bool(ends)

    def improve(self, rounds: int = ROUNDS) -> int:
        """Changes of single parcels and exchanges of two that raise the value and keep regions whole; their number."""
        changes = 0
        for _ in range(rounds):
            before = changes
            for p in self.free.tolist():
                changes += self._move(p)
            changes += self._swap()
            if changes == before:
                break
        return changes

    def _move(self, p: int) -> bool:
        now = int(self.use[p])
        beside = {int(self.use[n]) for n, _ in self.near[p]} - {-1, now}
        room = [u for u in sorted(beside) if self.left[u] + 1e-9 >= self.area[p]]
        old = self.gain(p, now) if now >= 0 else 0.0
        gains = [(self.gain(p, u) - old, -u) for u in room]
        best = max(gains, default=(0.0, 0))
        if best[0] <= LEAST or (now >= 0 and self.articulation(p)):
            return False
        self.give(p, -best[1])
        return True

    def _rim(self, parcel: int) -> bool:
        """Whether the parcel borders on another use than its own."""
        return any(self.use[n] >= 0 and self.use[n] != self.use[parcel] for n, _ in self.near[parcel])

    def _swap(self) -> int:
        """Every pair of parcels in use, in order, however many there are; only parcels on rims of regions can be exchanged."""
        changes, used = 0, self.free[self.use[self.free] >= 0]
        place = {p: i for i, p in enumerate(used.tolist())}
        rim = np.array([self._rim(p) for p in place], bool)
        for i, p in enumerate(used.tolist()):
            at = i + 1
            while rim[i]:
                done = next((j for j in (at + np.flatnonzero(rim[at:])).tolist() if self._swapped(p, int(used[j]))), None)
                if done is None:
                    break
                changes, at = changes + 1, done + 1
                for n in {n for k in (p, int(used[done])) for n in (k, *(m for m, _ in self.near[k]))} & place.keys():
                    rim[place[n]] = self._rim(n)
        return changes

    def _swapped(self, p: int, q: int) -> bool:
        a, b = int(self.use[p]), int(self.use[q])
        d = self.area[p] - self.area[q]
        if a == b or d > self.left[b] + 1e-9 or -d > self.left[a] + 1e-9 or not any(self.use[n] == b and n != q for n, _ in self.near[p]) or not any(self.use[n] == a and n != p for n, _ in self.near[q]):
            return False
        old = self.gain(p, a) + self.gain(q, b)
        self.use[p], self.use[q] = b, a
        if self.gain(p, b) + self.gain(q, a) > old + LEAST and self.whole(a) and self.whole(b):
            self.left[a] += d
            self.left[b] -= d
            return True
        self.use[p], self.use[q] = a, b
        return False


def contiguous_allocation(parcels: DataFrame, targets: dict[str, float], borders: DataFrame, weight: float = 1.0, compat: dict[tuple[str, str], float] | None = None, study: str | None = None) -> DataFrame:
    """id, alloc_use (null: none), alloc_suit, alloc_area, whole: the plan of each study area, whose uses are one region
    each; where the targets can't be met so, the plan without that rule, with whole = 0.

    parcels: id, area, suit_<use>, lock (a use; may be absent) and, with `study`, the name of a column that parts them;
    borders: a, b (ids of one study area), length. weight: of a metre of border between parcels, times compat of their
    uses (by default 1 for the same use and 0 otherwise; pairs hold both ways). targets: m2 for each use and study area.
    """
    uses = list(targets)
    matrix = np.eye(len(uses)) if compat is None else np.zeros((len(uses), len(uses)))
    for (a, b), value in (compat or {}).items():
        i, j = uses.index(a), uses.index(b)
        matrix[i, j] = matrix[j, i] = value
    key = F.col(study).cast("string") if study else F.lit("")
    most = parcels.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if most > allocation.PARCELS:
        raise ValueError(f"{most} parcels are too many for one plan")
    own = parcels.select(F.col("id").cast("long").alias("id"), key.alias("_one"))
    at = own.select(F.col("id").alias("a"), "_one")
    every = allocation._together(parcels, None, uses).drop("_one").join(own, "id")
    links = allocation._together(parcels.limit(0), borders, uses).drop("_one").join(at, F.col("id") == F.col("a")).drop("a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, soft = allocation._plan(pdf, uses, targets, weight)
        plan = Regions(soft.area, soft.suit, soft.left, soft.use, soft.near, weight, matrix)
        plan.left = soft.left.copy()
        plan.seed()
        done = plan.grow()
        if done:
            plan.improve()
        else:
            plan = soft
            plan.compat = matrix
            plan.fill()
            plan.improve()
        on = plan.use >= 0
        return pd.DataFrame({"id": ids, "alloc_use": [uses[u] if u >= 0 else None for u in plan.use], "alloc_suit": np.where(on, plan.suit[np.arange(len(ids)), np.maximum(plan.use, 0)], 0.0), "alloc_area": np.where(on, plan.area, 0.0), "whole": np.int32(done)})

    return every.unionByName(links).groupBy("_one").applyInPandas(run, "id long, alloc_use string, alloc_suit double, alloc_area double, whole int")
