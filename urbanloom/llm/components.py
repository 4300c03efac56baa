"""Connected components of an edge table by joins: labels fall to the smallest node of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that it reaches.

    Each round takes the smallest label of the neighbours, lowers the node that was the old label to what its
    members found, then takes the label's own label: whole trees of labels are joined, and a chain of n nodes in
    any order needs about log n rounds. They end when no label changes, not sooner. Labels are written to the
    shared folder each round; the driver sees a count.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    parts = common.parts_for(2 * edges.count())
    both = common.store(both.where("src <> dst").distinct(), parts=parts)
    labels = common.store(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("comp")), parts=parts)
    none = F.lit(None).cast(labels.schema["comp"].dataType)
    while True:
        seen = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("low"))
        step = labels.join(seen, "node").select("node", F.least("comp", "low").alias("near"), F.col("comp").alias("old"))
        hook = F.struct(F.col("old").alias("node"), "near", none.alias("old"))
        step = step.select(F.explode(F.array(F.struct("node", "near", "old"), hook)).alias("s")).select("s.*")
        step = common.store(step.groupBy("node").agg(F.min("near").alias("near"), F.max("old").alias("old")), parts=parts)
        above = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        labels_next = step.join(above, "near").select("node", F.least("near", "far").alias("comp"), "old")
        labels_next = common.store(labels_next, parts=parts)
        changed = labels_next.where("comp <> old").limit(1).count()
        common.drop_stored(step)
        common.drop_stored(labels)
        labels = labels_next.select("node", "comp")
        if not changed:
            common.drop_stored(both)
            return labels
