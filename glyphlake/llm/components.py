"""Connected components by repeated hooking to smaller labels; nothing is collected, and lineage is cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import written


#: Up to so many links are worked on as one partition, which needs no exchange; more are dealt by hash.
SMALL = 500_000


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label) for nodes (id): the smallest id that links (a, b) lead to. Each round takes the least label over a node's
    links and then that label's own, so paths shrink by half or more; it ends when no label changes."""
    small = links.count() <= SMALL
    kept = lambda df, what: (lambda out: out.coalesce(1) if small else out)(written(df.coalesce(1) if small else df, what))
    edges = kept(links.select("a", "b").filter("a != b"), "links")
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = kept(edges.distinct() if not small else edges.coalesce(1).distinct(), "links")
    labels = kept(edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("hook"))
        hooked = kept(hooked, "hooked")  # read four times below; edges are gone through once
        # What a node's old label learnt is passed to the whole tree below it.
        roots = hooked.groupBy("old").agg(F.min("hook").alias("root"))
        lifted = hooked.join(roots, "old").select("id", "old", F.least("hook", "root").alias("hook"))
        jump = lifted.select(F.col("id").alias("j"), F.col("hook").alias("jumped"))
        new = kept(lifted.join(jump, F.col("hook") == F.col("j"), "left").select("id", "old", F.least("hook", F.coalesce("jumped", "hook")).alias("label")), "labels")
        if new.filter("label != old").isEmpty():
            break
        labels = new.select("id", "label")
    rest = nodes.join(labels, "id", "left")
    return rest.select("id", F.coalesce("label", "id").alias("label"))
