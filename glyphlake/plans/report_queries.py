"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import reports
from glyphlake.operators import text as ops
from glyphlake.plans import text_queries
from glyphlake.schema import PAGE
from glyphlake.sources import evidence as ev

QUERIES: dict = {}
ORACLE: dict = {}


def report_files(spark, sf_dir):
    """Files with nested pages, from the text evidence: one aggregation of glyphs for all counters, one by font object."""
    c, s = F.col, F.col("semantic")
    active, missing = c("active"), c("missing")
    more = [
        F.count_if("in_form").alias("in_forms"), F.count_if(~c("in_form")).alias("page_content"), F.count_if(active).alias("under_actual"), F.sum(F.when(active, text.code_points(s)).otherwise(0)).alias("actual_chars"),
        F.count_if(~missing).alias("mapped"), F.count_if(missing).alias("unmapped"), F.count_if(active & missing).alias("resolved"),
        *(F.sum(text.count_of(s, p)).alias(k) for k, p in (("combining", text.COMBINING), ("non_bmp", text.NON_BMP), ("variation", text.VARIATION), ("joiners", text.JOINER), ("bidi", text.BIDI_CONTROL))),
    ]
    fonts = ops.fonts_by_page(ops.font_rollup(ops.with_semantics(ev.text_glyphs(spark, sf_dir)), F.broadcast(ev.fonts(spark)), ["font_obj"]))  # five fonts
    counts = text_queries.with_findings(text_queries.page_text(spark, sf_dir, more))
    rows = counts.join(fonts, PAGE, "left").withColumn("fonts", reports.font_structs(F.col("fonts"))).withColumn("bad_fonts", c("malformed") + c("invalid")).drop("union_share", "image_cells", "overlap_ratio", "paths", "annotation_missing", "annotation_replacement")
    page = reports.page_struct(rows.columns)
    by = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))  # a document's pages: one row of its report
    docs = ev.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source", "n_chars")
    yes, none = F.lit(True), F.lit(None)
    flags = ("pageContent", "formXObjects", "semanticMappings", "readingOrder", "geometryVisibility", "annotations", "optionalContent")
    return docs.join(by, "file_id").select(
        "file_id", F.concat("source", F.lit("/"), F.col("file_id").cast("string"), F.lit(".pdf")).alias("file"), F.col("n_chars").alias("fileSizeBytes"), F.size("pages").alias("pageCount"), F.lit(False).alias("encrypted"), yes.alias("extractionAllowed"), F.lit(3.0).cast("float").alias("tinyTextThresholdPoints"),
        F.struct(yes.alias("complete"), F.lit(False).alias("recovered"), F.lit(0).alias("parserWarningCount"), F.array().cast("array<struct<code:string,pageNumber:int,fontName:string>>").alias("diagnostics")).alias("parseHealth"),
        F.struct(*((F.lit(f in flags[:3])).alias(f) for f in flags)).alias("completeness"),
        F.struct(F.lit(False).alias("assessed"), yes.alias("complete"), *(none.cast("int").alias(k) for k in ("acroFormFieldCount", "signatureFieldCount", "widgetWithoutAppearanceCount")), F.lit(False).alias("xfaPresent"), none.cast("int").alias("embeddedFileCount"), none.cast("int").alias("associatedFileReferenceCount"), F.lit(False).alias("portfolioPresent")).alias("documentSurfaces"),
        "pages",
    )


def report_json(spark, sf_dir):
    return reports.report_json(report_files(spark, sf_dir))


def report_text(spark, sf_dir):
    return reports.text_report(report_files(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (report_json, report_text)}
