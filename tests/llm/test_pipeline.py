import re
from collections import Counter

import pytest
from test_mixing import check as check_mix
from test_near_dups import brute
from test_packing import check as check_pack
from test_pseudonyms import luhn
from test_quality import q

import corpus_pipeline as cp
from urbanloom.llm import mixing, near_dups, packing

FOLDER = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    steps = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, steps[-1], FOLDER)
        if name != "packing":
            assert out.columns == columns
        steps.append(near_dups.common.store(out))
    rows = [s.collect() for s in steps]
    # Quality: the rows that score at least the threshold.
    scores = {r.doc_id: r.score for r in q.score(docs, q.train(docs, labels), ["doc_id"]).collect()}
    assert {r.doc_id for r in rows[1]} == {d for d, s in scores.items() if s >= q.THRESHOLD}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(good - {r.doc_id for r in rows[1]}) <= 0.01 * len(good)
    # Near-duplicates: the smallest of each group, against union-find over all pairs.
    assert sorted(r.doc_id for r in rows[2]) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in rows[1]], 5)})
    # Pseudonyms: same rows, no valid card numbers or addresses of before.
    assert {r.doc_id for r in rows[3]} == {r.doc_id for r in rows[2]}
    before = {n for r in rows[2] for n in re.findall(r"(?<!\d)\d{16}(?!\d)|\b[a-z]+\.\d\d@mail\d\.example\.com", r.text) if "@" in n or luhn(n)}
    assert before and not any(n in r.text for r in rows[3] for n in before)
    # Mixing: each document as often as the mix says.
    found = mixing.mix(steps[3]).collect()
    check_mix(found, [(r.doc_id, r.source, r.text) for r in rows[3]])
    assert Counter(r.doc_id for r in rows[4]) == +Counter({r.doc_id: r.copies for r in found})
    # Packing: copies of a document are never in one bin.
    distinct = {(r.doc_id, r.source, r.text) for r in rows[4]}
    totals = Counter()
    bins = Counter()
    for r in rows[5]:
        totals[r.doc_id] += r.words
        if r.words < packing.CAPACITY:
            bins[r.bin, r.doc_id] += 1
    copies = Counter(r.doc_id for r in rows[4])
    assert max(bins.values()) == 1
    assert totals == +Counter({d: copies[d] * len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, _, t in distinct})
    assert check_pack  # the packing itself is checked in test_packing


def test_dedup_edges(spark):
    rows = [(None, "a b c d e f g", 1), (None, "a b c d e f g", 2), (None, "A b c d e f g", 3), (5, "x y z", 4), (5, "x y z", 5), (4, "X y z", 6), (9, None, 7), (9, "", 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp int")
    got = near_dups.one_of_each(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, (r.text or "").lower()) for r in got.collect())
    assert kept == Counter({(None, "a b c d e f g"): 1, (4, "x y z"): 1, (9, ""): 3})
    assert near_dups.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("columns", ["doc_id long, text string, source string, score double, bin long, _n int"])
def test_run_on_odd_rows(spark, tmp_path, columns):
    rows = [(None, None, None, None, None, None), (1, "", "a", 0.1, 1, 1), (1, "", "a", 0.1, 1, 1), (2, "w " * 30000, "b", None, None, None), (3, "u v", None, 1.0, 2, 2)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {1, 2, 3, None} and out.columns[:2] == ["doc_id", "source"]
    for r in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{r}.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/e/{r}.parquet")
    assert cp.run(spark, f"{tmp_path}/e").count() == 0
