import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from urbanloom.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute(docs, target, percent=25, least=20, buckets=10000, seed=7):
    def crc(f):
        return zlib.crc32(f.encode()) % buckets

    each = [(d, *features(t)) for d, t in docs]
    s, t = (Counter(crc(f) for _, _, fs in rows for f in fs) for rows in (each, [(0, *features(x)) for x in target]))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for d, n, fs in each:
        gain = [math.floor(1000 * math.log((t[crc(f)] + 1.0) * (big_s + float(buckets)) / ((s[crc(f)] + 1.0) * (big_t + float(buckets))))) for f in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, target = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in rs.op12_resampling(spark, folder).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == want and sum(x[4] is not None for x in got) > 20


def test_edges(spark):
    long = "Wörd " * 30 + "\x00\x7f!" + "end x" * 9
    rows = [(1, long, "a"), (1, long, "b"), (2, None, "c"), (3, "", "c"), (None, long, None), (4, "one", "d"), (5, long + " Z", "e"), (None, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target = spark.createDataFrame([("wörd one", 1), (None, 2), ("", 3)], "text string, weight int")
    for aim, plain in ((target, ["wörd one"]), (target.limit(0), [])):
        got = sorted((tuple(r) for r in rs.resample(docs, aim, percent=70).drop("n_words").collect()), key=str)
        assert got == brute([r[:2] for r in rows], plain, percent=70)
    assert rs.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_lose_no_feature(size):
    text = ("ab  cd\n" + "!" * 40 + " ef-g" * 9 + " longword" * 3).encode()
    con = rs._duck()
    found = Counter()
    for lead, piece in rs.pieces(text, size):
        words = WORD.findall(piece.decode())
        found.update(words[lead:])
        found.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    assert found == Counter(features(text.decode())[1])
    assert con.sql("SELECT zlib_crc('ab cd')").fetchall() == [(zlib.crc32(b"ab cd"),)]
    assert rs.zlib_crc(pa.array(["x", "", "é"])).to_pylist() == [zlib.crc32(x.encode()) for x in ("x", "", "é")]
