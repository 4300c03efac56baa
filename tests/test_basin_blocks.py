"""Pits over blocks of tiles: levels cross the tiles of a block in one round, and blocks in rounds."""

import numpy as np
import pytest

from urbanloom.operators import basins


def _filled(z):
    """Levels lowered until nothing changes."""
    level = np.where(np.isnan(z), np.nan, np.inf)
    level[[0, -1], :], level[:, [0, -1]] = z[[0, -1], :], z[:, [0, -1]]
    while True:
        framed = np.pad(np.where(np.isnan(level), np.inf, level), 1, constant_values=np.inf)
        low = np.min([framed[1 + a : framed.shape[0] - 1 + a, 1 + b : framed.shape[1] - 1 + b] for a, b in basins.AROUND], axis=0)
        new = np.where(np.isnan(z), np.nan, np.minimum(level, np.maximum(z, low)))
        if ((new == level) | np.isnan(z)).all():
            return np.where(np.isinf(level), z, level)
        level = new


@pytest.mark.parametrize(("block", "rounds"), [(512, 1), (12, 50), (1, 50)])
def test_levels_cross_tiles_and_blocks(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(basins, "BLOCK", block)
    monkeypatch.setattr(basins, "ROUNDS", rounds)
    rng = np.random.default_rng(3)
    z = rng.integers(0, 30, (30, 17)).astype(float)
    z[rng.random(z.shape) < 0.15] = np.nan
    df = spark.createDataFrame([(r - 2, c + 9, float(z[r, c])) for r in range(30) for c in range(17) if not np.isnan(z[r, c])], "row int, col int, value double")
    want = _filled(z)
    got = {(r.row + 2, r.col - 9): r.value for r in basins.fill_depressions(df, 4).collect()}
    assert got == {(r, c): want[r, c] for r in range(30) for c in range(17) if not np.isnan(z[r, c])}
