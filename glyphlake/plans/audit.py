"""The audit of a folder of PDF files: events to page rows with all evidence, classes and findings, to file rows with surfaces and
errors, and to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions import numbers, text
from glyphlake.operators import reports, rules, surfaces, visual
from glyphlake.operators import text as ops
from glyphlake.operators.steps import settled
from glyphlake.schema import ORDINAL, PAGE
from glyphlake.sources import pdf

TINY = 3.0


def _pages(events: DataFrame) -> DataFrame:
    """A row for each page: crop, rotation, and the size that is displayed; nulls where the geometry can't be assessed."""
    pages = pdf.rows_of(events, "page", pdf.PAGE).drop("seq")
    turned, ok = F.col("rotation").isin(90, 270), F.col("assessed")
    size = lambda a, b: F.when(ok, F.when(turned, F.col(b)).otherwise(F.col(a)))
    return pages.select(
        *PAGE, "rotation", F.struct(F.col("crop_x").alias("x"), F.col("crop_y").alias("y"), F.col("crop_w").alias("w"), F.col("crop_h").alias("h")).alias("crop"), ok.alias("geometry_assessed"),
        size("crop_w", "crop_h").alias("page_width"), size("crop_h", "crop_w").alias("page_height"), F.when(ok, F.col("rotation")).alias("page_rotation"), F.when(ok, reports.COORDINATES).alias("space"),
    )


def _text(glyphs: DataFrame, tiny: float) -> DataFrame:
    """All counters of a page's text, by one aggregation of its glyphs (of with_semantics, with their font)."""
    s, c = F.col("semantic"), F.col
    active, missing, t = c("active"), c("missing"), F.coalesce(s, F.lit(""))
    total = lambda pattern, name: F.sum(text.count_of(s, pattern)).alias(name)
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, t.alias("t")))), lambda x: x["t"]), "")
    return glyphs.groupBy(*PAGE).agg(
        F.count("*").alias("glyphs"), F.count_if("in_form").alias("in_forms"), F.count_if(~c("in_form")).alias("page_content"), F.count_if(active).alias("under_actual"), F.sum(F.when(active, text.code_points(s)).otherwise(0)).alias("actual_chars"),
        F.count_if(~active & missing).alias("missing"), F.count_if(~missing).alias("mapped"), F.count_if(missing).alias("unmapped"), F.count_if(active & missing).alias("resolved"),
        F.sum(text.code_points(s)).alias("chars"), total(r"\x{FFFD}", "replacement"), total(text.rtl(), "rtl"), total(text.COMBINING, "combining"), total(text.NON_BMP, "non_bmp"), total(text.VARIATION, "variation"), total(text.JOINER, "joiners"), total(text.BIDI_CONTROL, "bidi"),
        F.count_if(ops.tiny(c("font_size_pt"), tiny)).alias("tiny"), F.count_if(_implicit()).alias("implicit"),
        # The text of a page in both orders is one row, as a page's text is. Position order: lines from the top, then from the left.
        joined("glyph_no").alias("stream"), joined((-F.round("y")).alias("line"), "x", "glyph_no").alias("position"),
    )


def _implicit():
    return F.coalesce(ops.implicit(F.col("subtype"), F.col("to_unicode_present"), F.col("mapping_untrusted")), F.lit(False))


def _locations(glyphs: DataFrame, pages: DataFrame, tiny: float) -> DataFrame:
    """By page: locations (first samples of each finding, in report order), location_total, locations_truncated. Pages whose geometry isn't assessed have none."""
    s = F.col("semantic")
    found = {"MISSING_UNICODE": ~F.col("active") & F.col("missing"), "REPLACEMENT_CHARACTERS": s.contains("\ufffd"), "TINY_TEXT": ops.tiny(F.col("font_size_pt"), tiny), "IMPLICIT_COMPOSITE_UNICODE_MAPPING": _implicit(), "RTL_TEXT_REQUIRES_EXTRACTION_PROFILE": text.count_of(s, text.rtl()) > 0}
    codes = F.filter(F.array(*(F.when(found[c], c) for c in sorted(found, key=ORDINAL.get))), lambda c: c.isNotNull())
    rows = glyphs.withColumn("code", F.explode(codes)).join(pages.filter("geometry_assessed").select(*PAGE, "crop", "rotation"), PAGE)
    spot = numbers.display_point(F.col("rotation"), F.col("crop"), F.col("x"), F.col("y"))
    rows = rows.select(*PAGE, "code", "glyph_no", spot["x"].alias("x_dir"), spot["y"].alias("y_dir"), F.col("w").alias("w_dir"), F.col("h").alias("h_dir"))
    one = F.struct("ordinal", "n", F.col("code"), F.col("x").alias("xPoints"), F.col("y").alias("yPoints"), F.col("w").alias("widthPoints"), F.col("h").alias("heightPoints"))
    samples = ops.locations(rows).groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("l"))  # 8 for each of 5 findings at most
    samples = samples.select(*PAGE, F.transform("l", lambda x: x.dropFields("ordinal", "n")).alias("locations"))
    return samples.join(ops.location_totals(rows).select(*PAGE, F.col("total").alias("location_total"), F.col("truncated").alias("locations_truncated")), PAGE)


def _regions(events: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, page_number, visual_regions) of pages whose geometry is assessed."""
    box = [F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")]
    image = pdf.rows_of(events, "image", pdf.BOX).filter("shown").select(*PAGE, F.lit("IMAGE").alias("type"), "seq", *box)
    path = pdf.rows_of(events, "path", pdf.BOX).filter("shown").select(*PAGE, F.lit("VECTOR_PATH").alias("type"), "seq", *box)
    a = pdf.rows_of(events, "annotation", pdf.ANNOTATION)
    shown = visual.annotation_shown({c: F.col(c) for c in ("hidden", "invisible", "no_view", "w", "h", "oc_hidden", "oc_unknown")})
    note = a.filter(shown).select(*PAGE, F.when(F.col("is_widget"), "FORM_FIELD").otherwise("ANNOTATION").alias("type"), "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    boxes = image.unionByName(path).unionByName(note).join(pages.filter("geometry_assessed").select(*PAGE, "crop", "rotation"), PAGE)
    regions = visual.regions(boxes.withColumnRenamed("seq", "paint_no"))
    order = F.array_position(F.array(*(F.lit(t) for t in visual.REGION_TYPES)), F.col("type")).alias("o")
    one = F.struct(order, "n", "type", F.col("x").alias("xPoints"), F.col("y").alias("yPoints"), F.col("w").alias("widthPoints"), F.col("h").alias("heightPoints"))
    samples = visual.region_samples(regions).groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("r"))  # 32 of each of 4 types at most
    n = lambda c: F.col(c).cast("int")
    counts = F.struct(n("image_regions").alias("imageCount"), n("annotation_regions").alias("annotationCount"), n("form_field_regions").alias("formFieldCount"), n("vector_path_regions").alias("vectorPathCount"))
    out = F.struct(n("total_region_count").alias("totalRegionCount"), F.col("truncated").alias("regionsTruncated"), counts.alias("counts"), F.transform("r", lambda x: x.dropFields("o", "n")).alias("regions"))
    return visual.region_counts(regions).join(samples, PAGE).select(*PAGE, out.alias("visual_regions"))


def page_audit(events: DataFrame, tiny: float = TINY) -> DataFrame:
    """A row for each page: all counters of the report, class and findings. All come from groupings by the same key."""
    pages = _pages(events)
    fonts = pdf.rows_of(events, "font", pdf.FONT).drop("seq")
    semantic = ops.with_semantics(pdf.text_glyphs(events))
    glyphs = semantic.join(fonts.select(*PAGE, "font_obj", "subtype", "to_unicode_present"), [*PAGE, "font_obj"], "left")
    bad = ops.diagnostics(fonts).groupBy(*PAGE).agg(F.count_if(F.col("code") == "MALFORMED_TOUNICODE_CMAP").alias("malformed"), F.count_if(F.col("code") == "INVALID_TOUNICODE_CMAP").alias("invalid"))
    used = fonts.select(*PAGE, "font_obj", *ops.FONT_KEYS)
    malformed = semantic.filter("mapping_untrusted").select(*PAGE, "font_obj").distinct().join(used.select(*PAGE, "font_obj"), [*PAGE, "font_obj"], "left_anti")
    none = malformed.select(*PAGE, "font_obj", F.lit("<malformed-font>").alias("name"), F.lit("<unknown>").alias("subtype"), F.lit("<implicit>").alias("encoding"), *(F.lit(k == "damaged").alias(k) for k in ops.FONT_KEYS[3:]))
    rolled = ops.fonts_by_page(ops.font_rollup(semantic, used.unionByName(none), [*PAGE, "font_obj"])).withColumn("fonts", reports.font_structs(F.col("fonts")))
    painted = pdf.rows_of(events, "glyph", pdf.GLYPH).join(pages.select(*PAGE, "crop"), PAGE)
    drawn = pdf.rows_of(events, "image", pdf.BOX).join(pages.select(*PAGE, "crop"), PAGE)
    of_annotations = painted.filter("in_annotation").groupBy(*PAGE).agg(
        F.count("*").alias("annotation_glyphs"), F.sum(text.code_points(F.col("raw_unicode"))).alias("annotation_chars"), F.count_if(F.col("mapping_untrusted") | ~text.usable(F.col("raw_unicode"))).alias("annotation_missing"), F.sum(text.count_of(F.col("raw_unicode"), r"\x{FFFD}")).alias("annotation_replacement"),
    )
    streams = pdf.rows_of(events, "appearance", "annot_no int, stream_obj bigint").groupBy(*PAGE).agg(F.count("*").alias("appearance_streams"))
    noted = pdf.rows_of(events, "annotation", pdf.ANNOTATION).groupBy(*PAGE).agg(F.count("*").alias("annotation_count"), F.count_if("is_widget").alias("widget_count"))
    paths = pdf.rows_of(events, "path", pdf.BOX).groupBy(*PAGE).agg(F.count("*").alias("paths"))
    shown = visual.visibility({c: F.col(c) for c in ("fill", "stroke", "fill_alpha", "stroke_alpha", "x", "y", "crop", "in_clip")})["visible"]
    spots = painted.filter(~F.col("in_annotation")).filter(shown)
    rows = pages
    for other in (_text(glyphs, tiny), ops.scripts(semantic), rolled, bad, of_annotations, streams, noted, paths, _references(events), visual.visibility_counters(painted), visual.duplicate_glyphs(painted), visual.coverage(drawn), visual.union_share(drawn).drop("area"), visual.grid_overlap(drawn, spots), _locations(glyphs, pages, tiny), _regions(events, pages)):
        rows = rows.join(other, PAGE, "left")
    keep = ("page_width", "page_height", "page_rotation")
    zero = [f.name for f in rows.schema if f.dataType.typeName() in ("integer", "long", "double") and f.name not in (*PAGE, *keep)]
    rows = rows.fillna(0, zero).withColumn("union_share", F.greatest("union_share", "max_coverage"))
    rows = rows.fillna(True, ["layers_complete"]).fillna(False, ["layers_present"])
    rows = rows.withColumn("classification", visual.classification(*(F.col(c) for c in ("glyphs", "image_count", "paths", "chars", "union_share", "image_cells", "overlap_ratio"))))
    one, two = text.canonical(F.coalesce("stream", F.lit(""))), text.canonical(F.coalesce("position", F.lit("")))
    rows = rows.withColumn("diverges", one != two).withColumn("stream_chars", text.code_points(one)).withColumn("position_chars", text.code_points(two))
    rows = rows.withColumn("order_assessed", F.lit(True)).withColumn("visual_assessed", F.lit(True)).withColumn("bad_fonts", F.col("malformed") + F.col("invalid"))
    keys = ("glyphs", "missing", "replacement", "tiny", "malformed", "invalid", "implicit", "diverges", "classification", "rtl", "annotation_missing", "annotation_replacement")
    return rows.withColumn("findings", rules.findings(rules.triggers({k: F.col(k) for k in keys}))).drop("stream", "position")


def _references(events: DataFrame) -> DataFrame:
    """Counters by page of references to optional content; one to nothing adds three failures, and isn't counted as a reference."""
    r = pdf.rows_of(events, "reference", pdf.REFERENCE)
    real = F.col("node").isNotNull()
    failures = sum(F.col(d).isNull().cast("int") for d in ("view", "print", "export"))
    noted = pdf.rows_of(events, "annotation", pdf.ANNOTATION).groupBy(*PAGE).agg(F.bool_or("oc_present").alias("on_annotations"))
    by = r.groupBy(*PAGE).agg(
        F.count_if(real).alias("reference_count"), F.count_if("membership").alias("membership_reference_count"), *(F.count_if(F.coalesce(d, F.lit(False))).alias(f"hidden_in_{d}_count") for d in ("view", "print", "export")),
        F.sum(failures).alias("evaluation_failure_count"), F.count_if(~real).alias("null_reference_count"),
    )
    present = (F.col("reference_count") > 0) | F.coalesce("on_annotations", F.lit(False))
    return by.join(noted, PAGE, "left").withColumn("layers_complete", F.col("evaluation_failure_count") == 0).withColumn("layers_present", present).drop("on_annotations")


def document_surfaces(events: DataFrame) -> DataFrame:
    """By file: the counters and flags of the report's document surfaces."""
    nodes = pdf.rows_of(events, "node", pdf.NODE).drop("page_number", "seq")
    catalog = pdf.rows_of(events, "catalog", pdf.CATALOG).drop("page_number", "seq")
    forms = surfaces.form_fields(nodes.filter("tree = 'form'")).withColumnRenamed("complete", "forms_walked")
    names = surfaces.embedded_files(nodes.filter("tree = 'names'")).withColumnRenamed("complete", "names_walked")
    related = surfaces.associated_files(nodes.filter("tree = 'af'")).withColumnRenamed("complete", "related_walked")
    rows = catalog.join(forms, "file_id", "left").join(names, "file_id", "left").join(related, "file_id", "left")
    walked = F.col("form_complete")
    for c in ("forms_walked", "names_walked", "related_walked"):
        walked = walked & F.coalesce(c, F.lit(True))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    out = F.struct(
        F.lit(True).alias("assessed"), walked.alias("complete"), n("acro_form_field_count").alias("acroFormFieldCount"), n("signature_field_count").alias("signatureFieldCount"), n("widget_without_appearance_count").alias("widgetWithoutAppearanceCount"),
        F.col("xfa").alias("xfaPresent"), n("embedded_file_count").alias("embeddedFileCount"), n("associated_file_reference_count").alias("associatedFileReferenceCount"), F.col("portfolio").alias("portfolioPresent"),
    )
    return rows.select("file_id", out.alias("documentSurfaces"))


def report_files(events: DataFrame, pages: DataFrame, tiny: float = TINY) -> DataFrame:
    """The rows of operators.reports.report_json for every file that has a report."""
    page = reports.page_struct([c for c in pages.columns if c != "findings"])
    by = pages.withColumnRenamed("findings", "codes").groupBy("file_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.bool_and("layers_complete").alias("layers"))  # a file's pages: one row of its report
    told = ops.diagnostics(pdf.rows_of(events, "font", pdf.FONT)).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("p"), F.col("font_name").alias("f"), "code"))).alias("d"))
    told = told.select("file_id", F.transform("d", lambda x: F.struct(x["code"].alias("code"), x["p"].cast("int").alias("pageNumber"), x["f"].alias("fontName"))).alias("diagnostics"))
    rows = pdf.rows_of(events, "file", pdf.FILE).drop("page_number", "seq").join(by, "file_id").join(document_surfaces(events), "file_id").join(told, "file_id", "left")
    found = F.coalesce("diagnostics", F.array().cast("array<struct<code: string, pageNumber: int, fontName: string>>"))
    yes = F.lit(True)
    health = F.struct(yes.alias("complete"), ((F.col("recovered") > 0) | (F.size(found) > 0)).alias("recovered"), F.col("recovered").alias("parserWarningCount"), found.alias("diagnostics"))
    flags = ("pageContent", "formXObjects", "semanticMappings", "readingOrder", "geometryVisibility", "annotations")
    return rows.select(
        "file_id", F.col("file_id").alias("file"), F.col("size").alias("fileSizeBytes"), F.col("page_count").alias("pageCount"), "encrypted", F.col("extraction_allowed").alias("extractionAllowed"), F.lit(tiny).cast("float").alias("tinyTextThresholdPoints"),
        health.alias("parseHealth"), F.struct(*(yes.alias(f) for f in flags), F.col("layers").alias("optionalContent")).alias("completeness"), "documentSurfaces", "pages",
    )


def audit(spark: SparkSession, folder: str, page_selection: str | None = None, tiny: float = TINY, most_bytes: int = 100 << 20, most_pages: int = 1000, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, files) of all PDF files below folder. A file has either its report, in the columns of report_files, or an error, with
    the code of the limit that it went beyond, if it did; files with an error have no pages."""
    events = settled(pdf.decode(spark, folder, page_selection, most_bytes, most_pages, limits))
    pages = settled(page_audit(events, tiny))
    return pages, file_rows(events, pages, tiny)


def file_rows(events: DataFrame, pages: DataFrame, tiny: float = TINY) -> DataFrame:
    """One row for each file: report_files with attention and pages_needing_attention, or an error with the limit that it went beyond."""
    files = report_files(events, pages, tiny)
    surfaces_ = F.col("documentSurfaces")
    need = F.size(F.filter("pages", lambda p: F.size(p["findings"]) > 0))
    attention = rules.report_attention(F.col("parseHealth.recovered"), F.col("parseHealth.complete"), surfaces.requires_profile(surfaces_["complete"], surfaces_["acroFormFieldCount"], surfaces_["xfaPresent"], surfaces_["embeddedFileCount"], surfaces_["associatedFileReferenceCount"], surfaces_["portfolioPresent"]), need > 0)
    files = files.withColumn("attention", attention).withColumn("pages_needing_attention", need).withColumn("error", F.lit(None).cast("string")).withColumn("limit_code", F.lit(None).cast("string"))
    failed = events.filter("kind = 'error'").select(F.col("path").alias("file_id"), "error", F.get_json_object("payload", "$.limit").alias("limit_code"))
    return files.unionByName(failed, allowMissingColumns=True)
