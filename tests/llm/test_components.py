import hashlib
import random

import pytest

from urbanloom.llm import components as joined
from urbanloom.operators import network

NODES = 4000


@pytest.mark.parametrize("find", [joined.components, network.components])
def test_shuffled_chain(spark, find):
    """Chains whose node numbers are in no order: one of some thousand nodes, one of ten."""
    ids = random.Random(5).sample(range(10 * NODES), NODES + 10)
    long, short = ids[:NODES], ids[NODES:]
    edges = [*zip(long[:-1], long[1:], strict=True), *zip(short[:-1], short[1:], strict=True)]
    got = {r.node: r.comp for r in find(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(chain) for chain in (long, short) for v in chain}


def test_hashed_names_in_a_tree(spark):
    """Binary names, as near-duplicates have them."""
    name = lambda i: hashlib.sha256(str(i).encode()).digest()[:16]
    edges = [(bytearray(name(i)), bytearray(name(i // 2))) for i in range(1, 600)]
    got = {bytes(r.node): bytes(r.comp) for r in joined.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {name(i): min(map(name, range(600))) for i in range(600)}
