"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import tokens as tk

#: Length of the weight vector; the model has 8 bytes for each.
DIMENSIONS = 1 << 18
#: At most so many labelled documents train the model; those with the smallest hashes of doc_id are taken.
TRAIN_ROWS = 20_000
#: Bytes of examples that the learning task holds at once, about.
LEARN_BYTES = 16 << 20
#: A document counts as good from this score.
THRESHOLD = 0.3
BATCH = 1 << 20
#: Tokens of a single text that are counted at once.
STEP = 1 << 18


def gram_indices(hashes: np.ndarray, doc: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, document) of every 1- and 2-gram of tokens, given by their hashes and documents.

    Index 0 is the constant; 2-grams of one token twice, and tokens that return after one other, also count under the
    indices 1 and 2.
    """
    pairs, pair_doc = tk.grams(hashes, doc, 2)
    twice, back = ((hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k]) for k in (1, 2))
    size = np.uint64(dimensions - 3)
    fixed = (np.full(int(x.sum()), k, "i8") for k, x in ((1, twice), (2, back)))
    index = [(hashes % size).astype("i8") + 3, (pairs % size).astype("i8") + 3, *fixed]
    return np.concatenate(index), np.concatenate([doc, pair_doc, doc[1:][twice], doc[2:][back]])


def _one_counted(hashes: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, count) of one text's grams, STEP tokens at a time: beside the tokens only a vector of counts is held."""
    counts, size = np.zeros(dimensions, "i8"), np.uint64(dimensions - 3)
    for at in range(0, hashes.size, STEP):
        h = hashes[at : at + STEP + 2]
        n = min(STEP, hashes.size - at)
        pairs = tk.grams(h[: n + 1], np.zeros(min(n + 1, h.size), "i8"), 2)[0]
        for grams in (h[:n], pairs):
            counts += np.bincount((grams % size).astype("i8") + 3, minlength=dimensions)
        for k in (1, 2):
            counts[k] += np.count_nonzero(h[k : n + k] == h[: max(0, min(n, h.size - k))])
    index = np.flatnonzero(counts)
    return index, counts[index]


def counted(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index, value) sorted by document: counts of equal grams, scaled to unit length in each text.

    Tokens are runs of letters and digits, or of other marks, in lower case.
    """
    hashes, _, doc = tk.tokens(*tk.flat(column), tk.shape_classes(), tk.lower_table())
    if len(column) == 1:  # a long text comes alone
        index, counts = _one_counted(hashes, dimensions)
        owner = np.zeros(index.size, "i8")
    else:
        index, owner = gram_indices(hashes, doc, dimensions)
        keys, counts = np.unique(owner * dimensions + index, return_counts=True)
        owner, index = keys // dimensions, keys % dimensions
    norm = np.sqrt(np.bincount(owner, counts.astype("f8") ** 2, len(column)))
    return owner, index, counts / norm[owner]


def features(column: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) for each text of a binary column. A text without tokens has the constant alone."""
    owner, index, value = counted(column, dimensions)
    at = np.searchsorted(owner, np.arange(len(column) + 1))
    for i in range(len(column)):
        yield np.concatenate([[0], index[at[i] : at[i + 1]]]), np.concatenate([[1.0], value[at[i] : at[i + 1]]])


class Leader:
    """Follow-the-regularised-leader for logistic loss, one example after another."""

    def __init__(self, dimensions: int = DIMENSIONS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.z, self.n = np.zeros(dimensions), np.zeros(dimensions)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def at(self, index: np.ndarray) -> np.ndarray:
        z = self.z[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[index])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.at(index)
        error = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label
        g = error * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(self.z.size))


def is_held_out() -> F.Column:
    """crc32 of doc_id, as text, is a multiple of 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The model's weights. Learns from at most `rows` labels whose doc_id is not held out; null labels are left out.

    The sample (16 bytes a row, at most `rows` rows) is broadcast to the documents; their features, made on
    the executors, reach one task in an order fixed by doc_id, which updates the model example by example. Of rows
    that share a doc_id one is learnt from, that with the smallest hash of its text; a doc_id with both labels is
    learnt with both, and each counts. So at most `rows` examples reach the task. Without any label the model scores
    0.5 for all.
    """
    order = F.xxhash64("doc_id", F.lit(8))
    chosen = labels.where(F.col("quality").isin(0, 1) & ~is_held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = chosen.distinct().orderBy(order, "doc_id", "label").limit(rows)
    schema = "doc_id long, label int, index binary, value binary"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "body", BATCH):
            found = [(i.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for i, v in features(batch.column("body"), dimensions)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "label", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Leader(dimensions)
        for batch in common.small_batches(batches, "index", LEARN_BYTES):
            for label, index, value in zip(*(batch.column(c).to_pylist() for c in ("label", "index", "value")), strict=True):
                model.learn(np.frombuffer(index, "<i4"), np.frombuffer(value, "<f4"), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()], pa.binary())], names=["weights"])

    rows_in = docs.select("doc_id", common.text_bytes().alias("body")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "body")
    # One text for each label: rows that share a doc_id are folded before they meet.
    rows_in = rows_in.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("body").alias("h"), "body")).alias("x")).select("doc_id", "label", "x.body")
    examples = common.bound_batches(rows_in).mapInArrow(extract, schema).repartition(1).sortWithinPartitions(order, "doc_id", "label", "index")
    found = examples.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(found[0].weights, "<f8") if found else np.zeros(dimensions)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs and `name`: the model's probability that a text (null: empty) is good.

    The columns that are kept may have any names; one that is called `name` too comes before it in the result.
    """
    dimensions = weights.size
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows, (text, *kept) = common.by_place(docs, "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in common.small_batches(batches, "body", BATCH):
            owner, index, value = counted(batch.column("body"), dimensions)
            logit = w[0] + np.bincount(owner, value * w[index], batch.num_rows)
            out = [batch.column(c) for c in kept] + [pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "p"])

    schema = common.fields(rows, kept).add("p", "double")
    return common.bound_batches(rows.select(*kept, common.text_bytes(text).alias("body"))).mapInArrow(run, schema).toDF(*keep, name)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`, after training on docs and labels; all columns.

    Null texts are scored as empty ones; rows may repeat; without labels nothing is rejected (0.5 for all).
    Further columns may have any names and stay as they are.
    """
    weights = train(docs, labels)
    scored = score(docs, weights, docs.columns).toDF(*[f"c{i}" for i in range(len(docs.columns))], "p")
    return scored.where(F.col("p") >= threshold).drop("p").toDF(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the model that the labels of documents not held out give."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights, ["doc_id"]).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
