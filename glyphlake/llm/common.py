"""What the operators share: table paths, shared scratch folders, and fixed word and letter rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: a word is a run of anything but these six ASCII blanks; only A-Z are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local master, which is
    one process, uses a temporary folder, and a cluster, whose executors wouldn't see one, is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/glyphlake-{spark.sparkContext.applicationId}"
    return f"{root}/{what}-{uuid.uuid4().hex}"


def located(docs: DataFrame, *cols: Column) -> DataFrame:
    """The columns, with where each row's content is: `file`, a hash of its file's path, and `row`, its number there. Rows that
    don't come straight from files are written first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = written(docs, "located")
    return docs.select(*cols, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, codec: str | None = None, group_bytes: int = 128 << 20) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs no recomputation. What it shuffled is
    dropped at once. group_bytes: of a row group, which a task holds in memory."""
    spark = df.sparkSession
    path, before = scratch(spark, what), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", group_bytes).parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.glyphlake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once all that is made of them is written too."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.glyphlake_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)
