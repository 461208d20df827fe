"""Connected components over an edge table, by least labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage_counted, stage_table


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (the least node reachable) for every node of ``edges`` (``a, b`` long).

    Each round takes the least label among a node's neighbours, then that label's own label, so paths shorten
    geometrically; it ends when no label changed. Written to the shared folder each round; the caller drops the last."""
    both = stage_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        # both lookups of a label have one form: where it is broadcast, once
        label = labels.select(F.col("node").alias("of"), F.col("comp").alias("up"))
        near = both.join(label, F.col("b") == F.col("of")).groupBy("a").agg(F.min("up").alias("c"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "c").alias("low"))
        new = least.join(label, F.col("low") == F.col("of")).select("node", F.least("low", "up").alias("comp"), (F.least("low", "up") < F.col("comp")).alias("changed"))
        new, seen = stage_counted(new, "labels", F.count_if("changed").alias("moved"))
        drop_stage(labels)
        labels = new
        if not seen["moved"]:
            drop_stage(both)
            found = labels.select("node", "comp")
            found.staged_path = labels.staged_path
            return found


def extend(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components of all edges so far: ``labels`` of the earlier ones, joined by new ``edges``."""
    if labels is None:
        return components(edges)
    a, b = (labels.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in "ab")
    mapped = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a != b")
    more = components(mapped)
    old = labels.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("c2")), "comp", "left").select("node", F.coalesce("c2", "comp").alias("comp"))
    fresh = more.join(labels.select("node"), "node", "left_anti")
    joined = stage_table(old.unionByName(fresh), "components")
    drop_stage(more)
    return joined
