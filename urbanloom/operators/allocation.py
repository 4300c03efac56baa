"""Land-use allocation: parcels to uses by suitability, area targets and compactness, and the sweep between the two.

Parcels: id, area, suit_<use> for each use, lock (a use, or null). Adjacency: a, b, length of the shared border. The search
improves one plan step by step, so it runs as a kernel in one task over one study area (at most PARCELS parcels, an error
beyond); areas that are planned apart run as groups of one call each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARCELS = 500_000
#: Differences of an objective that count as none.
TOLERANCE = 1e-9


class Plan:
    """An assignment of parcels to uses (-1: none) that is improved under area targets."""

    def __init__(self, area: np.ndarray, suit: np.ndarray, targets: np.ndarray, locked: np.ndarray, near: list[list[tuple[int, float]]], weight: float, compat: np.ndarray | None = None):
        self.area, self.suit, self.near, self.weight = area, suit, near, weight
        self.compat = np.eye(len(targets)) if compat is None else compat
        self.use = locked.copy()
        self.free = np.flatnonzero(locked < 0)
        self.left = targets.astype("f8").copy()
        for u in range(len(targets)):
            self.left[u] -= area[locked == u].sum()

    def gain(self, parcel: int, use: int) -> float:
        """Suitability times area, and the weight times the border with each neighbour times how well the uses go together."""
        shared = sum(length * self.compat[use, self.use[n]] for n, length in self.near[parcel] if self.use[n] >= 0)
        return float(self.suit[parcel, use] * self.area[parcel] + self.weight * shared)

    def fill(self) -> None:
        """Pairs of the highest suitability first (ties: smaller parcel, then use), while the use's area has room."""
        value = self.suit[self.free]
        order = np.lexsort((np.tile(np.arange(value.shape[1]), len(self.free)), np.repeat(self.free, value.shape[1]), -value.ravel()))
        for k in order.tolist():
            parcel, use = int(self.free[k // value.shape[1]]), k % value.shape[1]
            if self.use[parcel] < 0 and self.area[parcel] <= self.left[use] + 1e-9:
                self.use[parcel] = use
                self.left[use] -= self.area[parcel]

    def improve(self, rounds: int = 50) -> int:
        """Moves of single parcels, then exchanges of two, as long as the sum of gains rises; the number of changes."""
        changes = 0
        for _ in range(rounds):
            before = changes
            for p in self.free.tolist():
                now = self.use[p]
                fit = [u for u in range(len(self.left)) if u != now and self.area[p] <= self.left[u] + 1e-9]
                if fit:
                    best = max(fit, key=lambda u: (self.gain(p, u), -u))
                    if self.gain(p, best) > (self.gain(p, now) if now >= 0 else 0.0) + 1e-9:
                        if now >= 0:
                            self.left[now] += self.area[p]
                        self.left[best] -= self.area[p]
                        self.use[p] = best
                        changes += 1
            changes += self._exchange()
            if changes == before:
                break
        return changes

    def _exchange(self) -> int:
        """Every pair of parcels in use, in order, however many there are: a parcel meets all later ones as arrays, and only
        pairs that could rise, or border on each other, are tried."""
        changes, uses = 0, range(len(self.left))
        used = self.free[self.use[self.free] >= 0]
        gains = np.array([[self.gain(p, u) for u in uses] for p in used.tolist()]).reshape(len(used), len(uses))
        place = {p: i for i, p in enumerate(used.tolist())}
        slack = 1e-12 * np.abs(gains).max(initial=1.0)
        for i, p in enumerate(used.tolist()):
            beside, at = [place[n] for n, _ in self.near[p] if place.get(n, -1) > i], i + 1
            while at < len(used):
                a, others = self.use[p], self.use[used[at:]]
                d = self.area[p] - self.area[used[at:]]
                rise = gains[i, others] + gains[at:, a] - gains[i, a] - gains[np.arange(at, len(used)), others]
                todo = rise > 1e-9 - slack
                todo[[j - at for j in beside if j >= at]] = True
                todo &= (others != a) & ~(d > self.left[others] + 1e-9) & ~(-d > self.left[a] + 1e-9)
                done = next((j for j in (at + np.flatnonzero(todo)).tolist() if self._exchanged(p, int(used[j]))), None)
                if done is None:
                    break
                changes, at = changes + 1, done + 1
                for n in {n for k in (p, int(used[done])) for n, _ in self.near[k]} & place.keys():
                    gains[place[n]] = [self.gain(n, u) for u in uses]
        return changes

    def _exchanged(self, p: int, q: int) -> bool:
        a, b = self.use[p], self.use[q]
        d = self.area[p] - self.area[q]
        old = self.gain(p, a) + self.gain(q, b)
        self.use[p], self.use[q] = b, a
        if self.gain(p, b) + self.gain(q, a) > old + 1e-9:
            self.left[a] += d
            self.left[b] -= d
            return True
        self.use[p], self.use[q] = a, b
        return False

    def objective(self) -> tuple[float, float]:
        """(suitability times area, border between parcels of one use)."""
        on = np.flatnonzero(self.use >= 0)
        inner = sum(length for p in on.tolist() for n, length in self.near[p] if n > p and self.use[n] == self.use[p])
        return float((self.suit[on, self.use[on]] * self.area[on]).sum()), float(inner)


def _plan(pdf: pd.DataFrame, uses: list[str], targets: dict[str, float], weight: float) -> tuple[np.ndarray, Plan]:
    own = pdf[pdf["_t"] == 0].sort_values("id").reset_index(drop=True)
    if len(own) > PARCELS:
        raise ValueError(f"{len(own)} parcels are too many for one plan")
    at = {k: i for i, k in enumerate(own["id"])}
    near: list[list[tuple[int, float]]] = [[] for _ in at]
    for a, b, length in pdf[pdf["_t"] == 1][["id", "other", "area"]].itertuples(index=False):
        if a in at and b in at:
            near[at[a]].append((at[b], length))
            near[at[b]].append((at[a], length))
    locked = np.array([uses.index(x) if x in uses else -1 for x in own["lock"]], "i8")
    suit = np.maximum(np.nan_to_num(np.array(own["suit"].tolist(), "f8").reshape(len(own), len(uses))), 0.0)
    return own["id"].to_numpy(), Plan(own["area"].to_numpy("f8"), suit, np.array([targets[u] for u in uses]), locked, near, weight)


def _together(parcels: DataFrame, borders: DataFrame | None, uses: list[str]) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    lock = F.col("lock").cast("string") if "lock" in parcels.columns else none("string")
    every = parcels.select(F.lit(0).alias("_t"), F.col("id").cast("long").alias("id"), none("long").alias("other"), F.col("area").cast("double").alias("area"), F.array(*[F.col(f"suit_{u}").cast("double") for u in uses]).alias("suit"), lock.alias("lock"))
    if borders is not None:
        every = every.unionByName(borders.select(F.lit(1).alias("_t"), F.col("a").cast("long").alias("id"), F.col("b").cast("long").alias("other"), F.col("length").cast("double").alias("area"), none("array<double>").alias("suit"), none("string").alias("lock")))
    return every.withColumn("_one", F.lit(0))


def land_allocation(parcels: DataFrame, targets: dict[str, float], borders: DataFrame | None = None, compactness: float = 0.0) -> DataFrame:
    """id, alloc_use (null: none), alloc_suit, alloc_area: the best plan found for the targets (m2 by use)."""
    uses = list(targets)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, plan = _plan(pdf, uses, targets, compactness)
        plan.fill()
        plan.improve()
        on = plan.use >= 0
        return pd.DataFrame({"id": ids, "alloc_use": [uses[u] if u >= 0 else None for u in plan.use], "alloc_suit": np.where(on, plan.suit[np.arange(len(ids)), np.maximum(plan.use, 0)], 0.0), "alloc_area": np.where(on, plan.area, 0.0)})

    return _together(parcels, borders, uses).groupBy("_one").applyInPandas(run, "id long, alloc_use string, alloc_suit double, alloc_area double")


def pareto_allocation(parcels: DataFrame, targets: dict[str, float], borders: DataFrame, points: int = 9, most: float | None = None) -> DataFrame:
    """point, w_compact, suitability, compactness, on_front, knee of plans with rising weight of compactness.

    The largest weight is six times the suitability of the first plan over all borders. A plan is on the front if no other
    is as good in both and better in one (differences up to TOLERANCE count as none). The knee is the plan of the front
    farthest from the line between its ends, each objective scaled to its range on the front; a front of fewer than three
    plans, or of one place, has none. Each weight's plan is a task of its own.
    """
    uses = list(targets)
    every = _together(parcels, borders, uses).drop("_one").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["point"].iloc[0])
        _, plan = _plan(pdf, uses, targets, 0.0)
        plan.fill()
        border = sum(length for row in plan.near for _, length in row) / 2
        top = most if most else (6 * plan.objective()[0] / border if border > 0 else 1.0)
        _, plan = _plan(pdf, uses, targets, top * k / max(1, points - 1))
        plan.fill()
        plan.improve()
        return pd.DataFrame([(k, plan.weight, *plan.objective())], columns=["point", "w_compact", "suitability", "compactness"])

    found = every.groupBy("point").applyInPandas(run, "point int, w_compact double, suitability double, compactness double")

    def front(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point").reset_index(drop=True)
        s, c = pdf["suitability"].to_numpy(), pdf["compactness"].to_numpy()
        good, better = (lambda v: v[None, :] >= v[:, None] - TOLERANCE), (lambda v: v[None, :] > v[:, None] + TOLERANCE)
        on = ~(good(s) & good(c) & (better(s) | better(c))).any(axis=1)
        knee = np.zeros(len(pdf), "int32")
        if on.sum() >= 3:
            x, y = ((v - v[on].min()) / np.ptp(v[on]) if np.ptp(v[on]) > 0 else np.zeros(len(v)) for v in (s, c))
            order = np.flatnonzero(on)[np.argsort(x[on], kind="stable")]
            dx, dy = x[order[-1]] - x[order[0]], y[order[-1]] - y[order[0]]
            if np.hypot(dx, dy) > 0:
                knee[order[int(np.argmax(np.abs(dy * (x[order] - x[order[0]]) - dx * (y[order] - y[order[0]]))))]] = 1
        return pdf.assign(on_front=on.astype("int32"), knee=knee)

    return found.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda p: front(p.drop(columns="_one")), "point int, w_compact double, suitability double, compactness double, on_front int, knee int")
