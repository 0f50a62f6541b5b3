"""Exact deduplication by a streaming aggregation whose keyed state lives on disk and never expires.

Each arriving row is reduced to (digest, identifier, content locator). A RocksDB-backed streaming aggregation keeps, per
digest, the identifier that stays, where its content is, and the number of rows seen; a restart goes on from its checkpoint.
Digest hits are then checked on their full bytes, which the locators lead to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import ascii_lower, located, scratch, text_of, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # of all stores of an executor, however many partitions it has
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store takes some MB of disk at once
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


LOCATOR = ["file", "row"]
ARRIVALS = "id bigint, digest binary, file bigint, row bigint"


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: identifier, digest of the normalised text, and locator of the content."""
    return located(docs, F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256)).alias("digest"))


def contents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(file, row, bytes): the normalised content at each locator."""
    return located(docs, ascii_lower(text_of(text_col)).alias("bytes"))


def stream_state(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, files_per_batch: int = 10_000) -> DataFrame:
    """Run the stream over all files in folder that its checkpoint hasn't seen; return the state's rows (digest, stays, n).

    Each micro-batch overwrites its own folder of changed keys, so a batch that is run again after a failure does no harm.
    """
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        state = rows.groupBy("digest").agg(F.max(F.struct("id", *LOCATOR)).alias("stays"), F.count("*").alias("n"))

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changed = spark.read.schema("digest binary, stays struct<id: bigint, file: bigint, row: bigint>, n bigint").parquet(f"{out}/batch=*")
    last = changed.groupBy("digest").agg(F.max(F.struct("n", "stays")).alias("x"))
    return last.select("digest", F.col("x.stays").alias("stays"), F.col("x.n").alias("n"))


def mismatches(contents: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of hits (file, row, stays, digest) whose full bytes differ from those that the locator of the row that stays leads to.

    A hot text's hits are many rows to one, a join that Spark splits: its copies need not meet in one task.
    """
    kept = hits.select("stays.file", "stays.row").distinct().join(contents, LOCATOR).select(F.col("file").alias("kept_file"), F.col("row").alias("kept_row"), F.col("bytes").alias("kept_bytes"))
    both = hits.select(*LOCATOR, "digest", F.col("stays.file").alias("kept_file"), F.col("stays.row").alias("kept_row")).join(contents, LOCATOR).join(kept, ["kept_file", "kept_row"])
    return both.filter(F.col("bytes") != F.col("kept_bytes")).select("digest").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, file, row, digest, stays, n) of each document: stays has the id and the locator of the row that stays."""
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = written(docs, "located")  # once: locators must lead to the same rows
    root = scratch(spark, "exact-dedup")
    arrivals(docs, id_col, text_col).write.parquet(f"{root}/arrivals")
    rows = spark.read.schema(ARRIVALS).parquet(f"{root}/arrivals")
    state = stream_state(spark, f"{root}/arrivals", rows.schema, f"{root}/checkpoint", f"{root}/state")
    out = written(rows.join(state, "digest").select("id", *LOCATOR, "digest", "stays", "n"), "exact-groups")
    hits = out.filter((F.col("n") > 1) & ((F.col("file") != F.col("stays.file")) | (F.col("row") != F.col("stays.row"))))
    bad = written(mismatches(contents(docs, text_col), hits), "exact-mismatches")
    if bad.isEmpty():
        return out
    # Two texts with one digest: those digests are grouped by their bytes.
    own = contents(docs, text_col).join(out.join(bad, "digest", "left_semi").select("id", *LOCATOR, "digest"), LOCATOR)
    by_bytes = own.groupBy("digest", "bytes").agg(F.max(F.struct("id", *LOCATOR)).alias("stays"), F.count("*").alias("n"))
    exact = own.join(by_bytes, ["digest", "bytes"]).select("id", *LOCATOR, "digest", "stays", "n")
    return out.join(bad, "digest", "left_anti").select(exact.columns).unionByName(exact)


def stays() -> Column:
    """Whether a row of `grouped` is the one that stays."""
    return (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones the row with the largest identifier stays, of several
    with that identifier the one with the last locator: one row of each group, whatever identifiers repeat. A null text counts as
    empty, so null and empty texts are one group. A null identifier is less than any other. Other columns are ignored. An empty
    table gives no rows.
    """
    rows = grouped(docs, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), stays().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, less those that do not stay."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = written(docs, "located")
    gone = grouped(docs, id_col, text_col).filter(~stays()).select(F.col("file").alias("_file"), F.col("row").alias("_row"))
    rows = located(docs, F.struct("*").alias("doc"))
    return rows.join(gone, (F.col("file") == F.col("_file")) & (F.col("row") == F.col("_row")), "left_anti").select("doc.*")
