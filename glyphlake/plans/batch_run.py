"""A batch from its list of changed files to its reports: selection, gate, audit, counters, combined report, annotations, summary."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.config import BatchOptions, place, write_report
from glyphlake.functions import text
from glyphlake.operators import batch, reports
from glyphlake.operators.steps import settled
from glyphlake.plans import audit as audits
from glyphlake.sources import changes, pdf


@dataclass(frozen=True)
class Outcome:
    exit_code: int
    conclusion: str
    annotations: list[str]
    summary: str
    outputs: list[str]


def workspace_files(spark: SparkSession, workspace: str | Path) -> DataFrame:
    """(path, filename, size_bytes) of the PDF files below a workspace, from their listing; filename is relative to it."""
    root = Path(workspace).resolve().as_uri()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(str(workspace))
    plain = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select("path", F.url_decode(F.replace(F.substring(plain, len(root) + 2, 100_000), F.lit("+"), F.lit("%2B"))).alias("filename"), F.col("length").alias("size_bytes"))


def selected(spark: SparkSession, changed: DataFrame, workspace: str | Path) -> DataFrame:
    """Changed PDF files with their place in the workspace: a left join by path, so one that is missing is a row with an error.

    The list of a change has 3,000 files at most, so each name is also checked on the driver: none may lead outside.
    """
    wanted = batch.changed_pdfs(changed)
    bad = [(r["filename"], p.problem) for r in wanted.select("filename").collect() if (p := place(workspace, r["filename"], "input")).problem]
    problems = spark.createDataFrame(bad, "filename string, problem string")
    rows = wanted.join(workspace_files(spark, workspace), "filename", "left").join(F.broadcast(problems), "filename", "left")  # 3,000 rows at most
    error = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("path").isNull(), F.concat(F.lit("input: "), "filename", F.lit(" is missing, or no regular file")))
    return rows.select("ordinal", "filename", "path", "size_bytes", error.alias("error"))


def audited(spark: SparkSession, files: DataFrame, options: BatchOptions) -> DataFrame:
    """One row for each file of `selected`: ordinal, path, error, attention, json (its report), page_count, need, inspected, pages. The
    files of all rows are read and audited at once."""
    paths = [r["path"] for r in files.filter("error IS NULL").select("path").collect()]  # 50 files at most
    if paths:
        content = spark.read.format("binaryFile").load(paths)
        fit, large = content.filter(F.col("length") <= options.most_bytes), content.filter(F.col("length") > options.most_bytes)
        events = fit.select("path", "content").mapInArrow(pdf._decoding(None, options.most_pages), pdf.EVENTS)
        said = F.concat(F.lit("PDF exceeds the configured size limit of "), F.lit(str(options.most_bytes)), F.lit(" bytes"))
        none = lambda t: F.lit(None).cast(t)
        events = events.unionByName(large.select("path", F.lit(0).alias("page_number"), F.lit("error").alias("kind"), F.lit(0).cast("bigint").alias("seq"), none("string").alias("payload"), said.alias("error")))
    else:
        events = spark.createDataFrame([], pdf.EVENTS)
    events = settled(events)
    pages = settled(audits.page_audit(events, options.tiny))
    done = audits.file_rows(events, pages, options.tiny)
    done = done.join(files.select(F.col("path").alias("file_id"), "filename", "ordinal"), "file_id").withColumn("file", F.col("filename"))
    told = reports.report_json(done.filter("error IS NULL")).withColumnRenamed("file_id", "f")
    rows = done.join(told, F.col("file_id") == F.col("f"), "left")
    kept = F.transform("pages", lambda p: F.struct(p["pageNumber"].alias("number"), p["findings"].alias("findings")))
    rows = rows.select("ordinal", F.col("filename").alias("path"), text.error_text(F.col("error")).alias("error"), "attention", "json", F.col("pageCount").alias("page_count"), F.col("pages_needing_attention").alias("need"), F.size("pages").alias("inspected"), kept.alias("pages"))
    missing = files.filter("error IS NOT NULL").select("ordinal", F.col("filename").alias("path"), text.error_text(F.col("error")).alias("error"), F.lit(None).cast("boolean").alias("attention"))
    return settled(rows.unionByName(missing, allowMissingColumns=True))


def annotation_rows(files: DataFrame) -> DataFrame:
    """Rows of reports.annotation_lines: one for each failed file, and one for each page with findings."""
    failed = files.filter("error IS NOT NULL").select("ordinal", F.lit(0).alias("page_number"), "path", F.lit(True).alias("failed"), F.col("error").alias("message"))
    pages = files.filter("error IS NULL").select("ordinal", "path", F.explode("pages").alias("p")).filter(F.size("p.findings") > 0)
    said = F.concat(F.lit("Page "), F.col("p.number").cast("string"), F.lit(": "), F.array_join("p.findings", ", "))
    return failed.unionByName(pages.select("ordinal", F.col("p.number").alias("page_number"), "path", F.lit(False).alias("failed"), said.alias("message")))


def run(spark: SparkSession, changed: DataFrame, change: changes.Change, options: BatchOptions) -> Outcome:
    """Audits a change and writes its combined report; raises WorkloadError before any file is read if the change is too large."""
    rank = F.row_number().over(W.orderBy("ordinal"))  # 3,000 rows at most
    files = settled(selected(spark, changed, options.workspace).withColumn("ordinal", rank))
    batch.check_workload(files, options.most_files, options.most_total_bytes)
    rows = audited(spark, files, options)
    counters = batch.counters(rows)
    code = batch.exit_code(F.col("files_failed"), F.col("files_with_findings"), options.fail_on_findings)
    one = counters.select("*", code.alias("code"), batch.conclusion(code, F.col("files_with_findings")).alias("conclusion")).first()
    combined = json.loads(reports.action_report(rows, counters, change.repository, change.number, options.fail_on_findings).first()["json"])
    write_report(options.workspace, options.report_path, json.dumps(combined, indent=2, ensure_ascii=False))
    name = str(options.report_path.relative_to(options.workspace))
    table = rows.select("ordinal", reports.summary_row(F.col("path"), F.col("error"), F.col("attention"), F.col("page_count"), F.col("need"), F.col("inspected")).alias("row"))
    lines = [r["line"] for r in reports.annotation_lines(annotation_rows(rows), options.most_annotations).orderBy("n").collect()]
    outputs = [r["line"] for r in reports.outputs(counters, name).orderBy("n").collect()]
    return Outcome(one["code"], one["conclusion"], lines, reports.summary(table, name).first()["summary"], outputs)


def main(spark: SparkSession, environment: Mapping[str, str], out, err) -> int:
    """A batch by its environment: WORKSPACE, EVENT_PATH, CHANGED_FILES (a folder of JSON lists), REPOSITORY, SUMMARY, OUTPUT, and options
    named INPUT_*. Exit code 2 if it could not be done."""
    try:
        inputs = {k[6:].lower(): v for k, v in environment.items() if k.startswith("INPUT_")}
        options = BatchOptions.of(inputs, environment["WORKSPACE"])
        change = changes.read_event(environment["EVENT_PATH"], environment["REPOSITORY"])
        done = run(spark, changes.read_changed_files(spark, environment["CHANGED_FILES"], change), change, options)
        for line in done.annotations:
            print(line, file=out)
        for key, content in (("SUMMARY", done.summary), ("OUTPUT", "\n".join(done.outputs) + "\n")):
            if environment.get(key, "").strip():
                with open(environment[key], "a", encoding="utf-8") as f:
                    f.write(content)
        return done.exit_code
    except (ValueError, OSError, KeyError) as e:
        print("The audit of the change failed:", " ".join(str(e).split()), file=err)
        return 2
