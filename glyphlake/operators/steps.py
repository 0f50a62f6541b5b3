"""Cutting lineage between the steps of iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df as written to the folder that spark.checkpoint.dir names, which executors share. Where that is unset, a local master,
    which is one process, uses a temporary folder, and a cluster, whose executors wouldn't see one, is refused."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/glyphlake-{spark.sparkContext.applicationId}"
    path = f"{root}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
