"""The list of changed files of a change request, and the event that names it, from JSON files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_EVENT_BYTES, MOST_FILES = 1 << 20, 3000
#: Entries and bytes of one page of the list.
MOST_ENTRIES, MOST_PAGE_BYTES = 100, 5 << 20


class ChangeError(ValueError):
    pass


@dataclass(frozen=True)
class Change:
    repository: str
    number: int
    changed_files: int


def read_event(path: str | Path, repository: str) -> Change:
    """The event's number and count of changed files, both checked."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", repository):
        raise ChangeError("Invalid repository")
    p = Path(path)
    if not p.is_file() or p.stat().st_size > MOST_EVENT_BYTES:
        raise ChangeError("The event must be a regular JSON file no larger than 1 MiB")
    event = json.loads(p.read_text(encoding="utf-8"))
    change = event.get("pull_request")
    if not isinstance(change, dict):
        raise ChangeError("The event does not contain a pull_request object")
    counts = event.get("number"), change.get("changed_files")
    if not all(type(n) is int for n in counts) or counts[0] < 1 or counts[1] < 0:
        raise ChangeError("The event's number and changed_files must be integers in range")
    if counts[1] > MOST_FILES:
        raise ChangeError(f"More than {MOST_FILES} changed files are not supported")
    return Change(repository, *counts)


def read_changed_files(spark: SparkSession, path: str, change: Change | None = None) -> DataFrame:
    """(ordinal, filename, status) of files with one JSON array a page, in the order of the pages' names.

    Checked are the size of each page, before it is read, its entries, and that all files are there.
    """
    large = spark.read.format("binaryFile").load(path).filter(F.col("length") > MOST_PAGE_BYTES)
    if not large.select("path").isEmpty():
        raise ChangeError(f"A page of the list has more than {MOST_PAGE_BYTES} bytes")
    pages = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("page"), F.from_json("value", "array<struct<filename: string, status: string>>").alias("x"))
    if not pages.filter(F.col("x").isNull() | (F.size("x") > MOST_ENTRIES)).isEmpty():
        raise ChangeError(f"A page of the list is no JSON array of at most {MOST_ENTRIES} files")
    rows = pages.select("page", F.posexplode("x").alias("at", "f"))
    files = rows.select(F.struct("page", "at").alias("ordinal"), "f.filename", "f.status")
    if change is not None and (n := files.count()) != change.changed_files:
        raise ChangeError(f"The list has {n} files; the event says {change.changed_files}")
    return files
