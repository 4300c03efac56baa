"""Very long texts: windows give the same tokens, and memory does not grow with powers of a text."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from urbanloom.llm import quality
from urbanloom.llm import tokens as tk


@pytest.mark.parametrize("window", [1, 3, 16, 1000])
def test_windows_change_no_token(monkeypatch, window):
    rng = np.random.default_rng(window)
    texts = [bytes(rng.choice(list(b"aB3 \n.,\xc3\xa9"), int(n))) for n in rng.integers(0, 60, 30)] + [b"x" * 500, b"", b" " * 40, b"end"]
    column = pa.array(texts, pa.binary())
    for classes in (tk.word_classes(), tk.shape_classes()):
        want = tk.tokens(*tk.flat(column), classes, tk.lower_table())
        monkeypatch.setattr(tk, "WINDOW", window)
        got = tk.tokens(*tk.flat(column), classes, tk.lower_table())
        monkeypatch.undo()
        assert all((a == b).all() and a.size == b.size for a, b in zip(got, want, strict=True))


def test_one_text_counts_like_many(monkeypatch):
    monkeypatch.setattr(quality, "STEP", 5)
    for text in (b"", b"one", b"a a a b a b, b!! a" * 7, b"x y"):
        alone = quality.counted(pa.array([text], pa.binary()), 1 << 10)
        owner, index, value = quality.counted(pa.array([text, b"other words"], pa.binary()), 1 << 10)
        first = owner == 0
        assert (alone[1] == index[first]).all() and np.allclose(alone[2], value[first])


def test_memory_of_a_64_mb_text():
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from urbanloom.llm import near_dups, quality
text = b"".join(b"w%d " % i for i in np.random.default_rng(0).integers(0, 10**6, 8_400_000))[: 64 << 20]
column = pa.array([text], pa.binary())
del text
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "dups":
    sets = near_dups.shingle_sets(column, 5)
    near_dups.signatures(sets)
else:
    quality.counted(column, quality.DIMENSIONS)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    for kind, most in (("dups", 700), ("quality", 500)):
        out = subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True, check=True)
        assert int(out.stdout) < most, (kind, out.stdout)
