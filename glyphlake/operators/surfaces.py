"""Document surfaces: form fields, name trees, associated files, and what of a document needs a profile.

Trees are rows (file_id, tree, node, parent, is_dict, field_type, subtype, has_appearance, names_len). They are walked level by
level from the roots; a node that was seen before, or lies more than DEPTH levels down, isn't walked and makes its file
incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.steps import settled

DEPTH = 64


def walk(nodes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(visited, failed): visited rows (file_id, node, level, field_type, ...), with the type inherited, and files (file_id, bad) with what couldn't be walked."""
    rest = [c for c in nodes.columns if c not in ("file_id", "node", "parent", "is_dict", "field_type")]
    tree = nodes.select("file_id", "node", "parent", "is_dict", "field_type", *rest)
    level = settled(tree.filter("parent is null"))
    bad = level.filter(~F.col("is_dict")).select("file_id")
    visited = level.filter("is_dict").select("file_id", "node", F.lit(0).alias("level"), "field_type", *rest)
    front = settled(visited)
    visited = front
    for k in range(1, depth + 2):
        up = front.select("file_id", F.col("node").alias("parent"), F.col("field_type").alias("above"))
        down = tree.join(up, ["file_id", "parent"]).withColumn("field_type", F.coalesce("field_type", "above")).drop("above")
        down = settled(down)
        if down.isEmpty():
            break
        seen = visited.select("file_id", "node").distinct().withColumn("again", F.lit(True))
        down = down.join(seen, ["file_id", "node"], "left")
        wrong = ~F.col("is_dict") | F.coalesce("again", F.lit(False)) | F.lit(k > depth)
        bad = bad.unionByName(down.filter(wrong).select("file_id"))
        front = settled(down.filter(~wrong).dropDuplicates(["file_id", "node"]).select("file_id", "node", F.lit(k).alias("level"), "field_type", *rest))
        visited = visited.unionByName(front)
    return visited, bad.groupBy("file_id").agg(F.count("*").alias("bad"))


def form_fields(nodes: DataFrame) -> DataFrame:
    """By file: fields, signatures and widgets without appearance of the form tree, and whether all of it could be walked."""
    visited, bad = walk(nodes)
    by = visited.groupBy("file_id").agg(F.count("*").alias("acro_form_field_count"), F.count_if(F.col("field_type") == "Sig").alias("signature_field_count"), F.count_if((F.col("subtype") == "Widget") & ~F.col("has_appearance")).alias("widget_without_appearance_count"))
    return by.join(bad, "file_id", "left").withColumn("complete", F.col("bad").isNull()).drop("bad")


def embedded_files(nodes: DataFrame) -> DataFrame:
    """By file: name pairs of the tree; an odd number of entries in a node makes it incomplete."""
    visited, bad = walk(nodes)
    by = visited.groupBy("file_id").agg(F.sum(F.floor(F.coalesce("names_len", F.lit(0)) / 2)).alias("embedded_file_count"), F.count_if(F.col("names_len") % 2 == 1).alias("odd"))
    return by.join(bad, "file_id", "left").withColumn("complete", F.col("bad").isNull() & (F.col("odd") == 0)).drop("bad", "odd")


def associated_files(nodes: DataFrame) -> DataFrame:
    """By file: all entries count; any that is no dictionary makes it incomplete."""
    return nodes.groupBy("file_id").agg(F.count("*").alias("associated_file_reference_count"), F.bool_and("is_dict").alias("complete"))


def requires_profile(complete: Column, fields: Column, xfa: Column, embedded: Column, associated: Column, portfolio: Column) -> Column:
    return ~complete | (fields > 0) | xfa | (embedded > 0) | (associated > 0) | portfolio
