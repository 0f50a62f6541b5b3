"""Batches: which changed files are audited, gates on the workload, counters and conclusion of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class WorkloadError(ValueError):
    pass


def changed_pdfs(files: DataFrame) -> DataFrame:
    """PDF files of (ordinal, filename, status) that weren't removed, each name at its first place."""
    kept = files.filter((F.col("status") != "removed") & F.lower("filename").endswith(".pdf"))
    return kept.groupBy("filename").agg(F.min(F.struct("ordinal", "status")).alias("x")).select(F.col("x.ordinal").alias("ordinal"), "filename", F.col("x.status").alias("status"))


def size_gate(files: DataFrame, most: int) -> DataFrame:
    """Adds error: what is larger is rejected before it is read. Other rows have none."""
    return files.withColumn("error", F.when(F.col("size_bytes") > most, F.concat(F.lit("PDF exceeds the configured size limit of "), F.lit(str(most)), F.lit(" bytes"))))


def workload(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """One row: files, bytes, and the gate that closes, if one does."""
    one = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0).cast("bigint")).alias("bytes"))
    return one.withColumn("gate", F.when(F.col("files") > most_files, "FILE_COUNT").when(F.col("bytes") > most_bytes, "TOTAL_BYTES"))


def check_workload(files: DataFrame, most_files: int = 50, most_bytes: int = 500 << 20) -> None:
    row = workload(files, most_files, most_bytes).first()
    if row["gate"]:
        raise WorkloadError(f"{row['gate']}: {row['files']} files, {row['bytes']} bytes")


def counters(files: DataFrame) -> DataFrame:
    """One row for a run of (error, attention): checked, with findings, failed."""
    return files.agg(F.count("*").alias("files_checked"), F.count_if(F.col("error").isNull() & F.col("attention")).alias("files_with_findings"), F.count_if(F.col("error").isNotNull()).alias("files_failed"))


def exit_code(failed: Column, found: Column, fail_on_findings: Column | bool = True) -> Column:
    policy = fail_on_findings if isinstance(fail_on_findings, Column) else F.lit(fail_on_findings)
    return F.when(failed > 0, 2).when((found > 0) & policy, 1).otherwise(0)


def conclusion(code: Column, found: Column) -> Column:
    return F.when((code == 0) & (found == 0), "passed").when(code == 0, "neutral").when(code == 1, "findings").otherwise("error")
