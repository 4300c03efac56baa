"""Sharding by balanced label propagation: linked documents move towards their neighbours, shards keep their rows.

Links join documents with equal texts. Every round, each block of linked documents names the shard that holds
most of it, and its other members ask to move there. Moves are exchanges: two documents that ask for each
other's shard swap, and a document that asks for a shard where an unlinked document lives takes its place.
So a shard's quota (rows, at most one apart) holds after each step. A group larger than a part of a quota
counts as several blocks: no shard could hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Rounds in a row that may pass without fewer documents asking to move.
PATIENCE = 3
#: Blocks of a group that no shard can hold have about this part of a shard's rows: they leave so much room.
BLOCK_PART = 0.8


def _start(docs: DataFrame, shards: int) -> DataFrame:
    """Rows with an id of their own, their block (null: unlinked), and a first shard that ignores links.

    The id is the rank by doc_id and text, so it does not depend on files or partitions (equal rows may change
    places).
    """
    body = common.text_bytes()
    rows = docs.select(
        F.monotonically_increasing_id().alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.struct(F.xxhash64(body).alias("a"), F.hash(body).alias("b")).alias("group"),
    )
    rows = common.store(rows)
    n = rows.count()
    ranked = common.store(common.ordered_rank(rows, [], ["doc_id", "text_crc32", "group", "place"], "rid").drop("place"))
    # Stored: the joins with it stand alone, so that Spark can split a group that many rows share.
    groups = common.store(ranked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    quota = max(1, n // shards)
    linked = ranked.join(groups, "group", "left")
    # A group that a shard could hold is one block; a larger one has blocks that leave room in a shard.
    parts = F.when(F.col("n") <= quota, 1).otherwise(F.ceil(F.col("n") / max(1, int(quota * BLOCK_PART))))
    linked = linked.withColumn("block", F.when(F.col("n").isNotNull(), F.xxhash64("group", F.pmod(F.xxhash64("doc_id", "rid"), parts))))
    return common.store(linked.withColumn("shard", F.pmod("rid", F.lit(shards)).cast("int")).drop("group", "n"))


def _round(state: DataFrame) -> tuple[DataFrame, int, int]:
    """One round of moves: the new state, how many documents asked to move and how many moved."""
    # At most shards rows: unlinked documents, whose place can be taken.
    room = state.where("block is null").groupBy("shard").agg(F.count(F.lit(1)).alias("room"))
    held = common.store(state.where("block is not null").groupBy("block", "shard").agg(F.count(F.lit(1)).alias("n")))
    total = held.groupBy("block").agg(F.sum("n").alias("all"))
    votes = held.join(room, "shard", "left").join(total, "block").where("room > 0 or 2 * n >= all")
    wish = common.store(votes.groupBy("block").agg(F.max_by("shard", F.struct("n", F.xxhash64("block", "shard"))).alias("to")))
    wishes = state.where("block is not null").join(wish, "block").where("to <> shard")
    numbered = common.ordered_rank(wishes.select("rid", "block", "shard", "to"), ["shard", "to"], ["block", "rid"], "k")
    numbered = common.store(numbered)
    asked = numbered.count()
    if not asked:
        return state, 0, 0
    # At most shards ** 2 rows: how many ask for the way back.
    ways = numbered.groupBy(F.col("to").alias("shard"), F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("back"))
    numbered = numbered.join(F.broadcast(ways), ["shard", "to"], "left")
    swaps = numbered.where("k < back").select("rid", F.col("to").alias("next"))
    rest = numbered.where("back is null or k >= back").select("rid", "block", "shard", "to")
    asking = common.ordered_rank(rest, ["to"], ["block", "rid"], "k")
    leaving = state.where("block is null").select("rid", "shard")
    leaving = common.ordered_rank(leaving, ["shard"], ["rid"], "k")
    asking = asking.select(F.col("rid").alias("a"), F.col("shard").alias("origin"), F.col("to"), "k")
    leaving = leaving.select(F.col("rid").alias("b"), F.col("shard").alias("to"), "k")
    pairs = asking.join(leaving, ["to", "k"])
    moved = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("to").alias("next")), F.struct(F.col("b").alias("rid"), F.col("origin").alias("next")))).alias("m")).select("m.*")
    moves = common.store(swaps.unionByName(moved))
    count = moves.count()
    after = state.join(moves, "rid", "left").withColumn("shard", F.coalesce("next", "shard")).drop("next")
    return common.store(after), asked, count


def with_apart(state: DataFrame) -> DataFrame:
    """state with apart: whether a linked row is not in the shard that holds most of its block."""
    held = state.where("block is not null").groupBy("block", "shard").agg(F.count(F.lit(1)).alias("n"))
    home = common.store(held.groupBy("block").agg(F.max_by("shard", F.struct("n", "shard")).alias("home")))
    return state.join(home, "block", "left").withColumn("apart", F.coalesce(F.col("home") != F.col("shard"), F.lit(False))).drop("home")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, linked, apart.

    Law `rows`: the shards' row counts are at most one apart. size: UTF-8 bytes of the text (null: none) and
    16. slot: 0, 1, 2, ... within a shard, by doc_id (null first). Null and empty texts are equal texts. Rows
    may repeat; an empty table has no rows; other columns are not read. Rounds go on until no document asks to
    move, none can, or PATIENCE rounds have not lowered the number that ask. linked: another row has the same text;
    apart: it is not where most of its block is, so what the rounds leave cut is in the result.
    """
    state = _start(docs, shards)
    least, since = None, 0
    while since < PATIENCE:
        state, asked, moved = _round(state)
        if not moved:
            break
        least, since = (asked, 0) if least is None or asked < least else (least, since + 1)
    placed = common.ordered_rank(with_apart(state), ["shard"], ["doc_id", "rid"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("block").isNotNull().alias("linked"), "apart")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in SHARDS shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
