"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order, has a virtual finish time: its source's words up to and including it,
divided by the source's weight. A source may be gone through `epochs` times. Sorted by finish time over all sources and cut
at the total budget, the queue gives each source its share. Running sums are made per hash bucket and offset by the sums of
the buckets before, so no source, however large, goes through one task.

A document is known by its shuffle key, a hash of its identifier and text, by its source, and by its copy: rows that are equal
in all of these are numbered. So null and repeated identifiers lose no row, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import WORD, text_of, written

#: Buckets of one running sum: few enough that one task adds up their totals.
MOST_BUCKETS = 65_536


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """One row per source: source, source_size, weight, target, budget, level (the virtual time at which the budget is used).

    target = least(epochs * source_size, weight * level): the excess of sources that run out is shared by weight. One row for
    each source goes through a single window; documents never do.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("most", F.lit(epochs) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    by = by.withColumn("before", F.sum("most").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("most"))
    by = by.withColumn("heavier", F.sum("weight").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("weight"))
    by = by.withColumn("budget", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    by = by.withColumn("try", (F.col("budget") - F.col("before")) / F.col("heavier"))
    fits = F.when(F.col("try") * F.col("weight") <= F.col("most"), F.col("try"))
    by = by.withColumn("level", F.coalesce(F.max(fits).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0.0)))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))
    return by.select("source", "source_size", "weight", target.alias("target"), "budget", "level")


def running_sum(df: DataFrame, within: list[str], bucket: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the inclusive running sum of value in (within, bucket, order); bucket must ascend with order and not be null."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*within, "_bucket").agg(F.sum(value).alias("_total"))
    past = W.partitionBy(*within).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*within, "_bucket", F.coalesce(F.sum("_total").over(past), F.lit(0)).alias("_past"))
    inside = W.partitionBy(*within, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(totals, [*within, "_bucket"]).withColumn(name, F.col("_past") + F.sum(value).over(inside)).drop("_bucket", "_past")


def shuffle_key(seed: str, id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed), F.md5(text_of(text_col).cast("binary"))).cast("binary"))


def source_key(source_col: str) -> Column:
    """A source without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def document_sizes(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each (key, own, id, source, size), with how many copies there are. A key is the hash of an identifier and a text."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")
    rows = docs.select(shuffle_key(seed, id_col, text_col).alias("key"), source_key(source_col).alias("own"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    return rows.groupBy("key", "own", "id", "source", "size").agg(F.count("*").alias("copies")).withColumn("total", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, queue): a row per document (key, own, copy, id, source, size, source_size, target, taken, weight) and the queue
    that is taken, in order of finish.

    A null text has size 0; a null source is a source of its own, the last. Sizes of 0 take nothing. A null identifier is one like
    any other. Rows that repeat an identifier are documents of their own, shuffled by their texts; of rows that are equal in all
    that is read, the first copies are taken first. An empty table gives no rows.
    """
    sizes = written(document_sizes(docs, seed, id_col, text_col, source_col), "mix-sizes")
    goals = written(targets(sizes.select("source", F.col("total").alias("size")), weights, epochs), "mix-goals")
    n = sizes.count()
    digits = 2 + (n > 1_000_000) + (n > 20_000_000)  # 256 to MOST_BUCKETS buckets by the first hexadecimal digits
    cum = running_sum(sizes, ["own"], F.substring("key", 1, digits), [F.col("key")], "total", "cum")
    goals = goals.select(source_key("source").alias("own"), "source_size", "weight", "target", "budget", "level")
    known = cum.join(goals, "own").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    at = F.col("epoch") * F.col("source_size") + F.col("cum") - (F.col("copies") - F.col("copy")) * F.col("size")
    queue = known.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("finish", at / F.col("weight"))
    queue = queue.select("key", "own", "copy", "id", "source", "size", "budget", "level", "epoch", "finish")
    half = MOST_BUCKETS // 2 if n > 1_000_000 else 512
    early, late = F.floor(F.col("finish") / F.col("level") * half), 2 * half - F.ceil(F.col("level") / F.col("finish") * half)
    slot = F.when(F.col("finish") <= F.col("level"), F.least(early, F.lit(half))).otherwise(late).cast("int")
    queue = running_sum(queue, [], slot, [F.col("finish"), F.col("source").asc_nulls_last(), F.col("key"), F.col("copy")], "size", "used").filter("used <= budget")
    taken = queue.groupBy("key", "own", "copy").agg(F.sum("size").alias("taken"))
    out = known.join(taken, ["key", "own", "copy"], "left")
    return out.select("key", "own", "copy", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), "weight"), queue


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, all columns, with size, taken and target."""
    taken, _ = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    taken = written(taken.filter("taken > 0").select(*(F.col(c).alias(f"_{c}") for c in ("key", "own", "copy")), "size", "taken", "target"), "mix-taken")
    rows = docs.drop("size", "taken", "target").withColumn("_key", shuffle_key(seed, id_col, text_col)).withColumn("_own", source_key(source_col))
    rows = rows.withColumn("_copy", F.row_number().over(W.partitionBy("_key", "_own").orderBy("_key")).cast("bigint"))
    return rows.join(taken, ["_key", "_own", "_copy"]).drop("_key", "_own", "_copy")
