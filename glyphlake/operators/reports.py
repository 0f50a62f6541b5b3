"""Report rows: JSON by a fixed schema and its versions, plain text, annotation lines, summary rows and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.schema import FINDINGS

SCHEMA_VERSION = 6

#: Members of a page that came with a version, and members of fonts and kinds of regions by version.
SINCE = {"classification": 2, "textSurfaces": 2, "semanticMapping": 2, "readingOrder": 2, "geometryVisibility": 2, "visualContent": 2, "annotationAppearances": 2, "optionalContent": 2, "unicodeProfile": 2, "spatialEvidence": 3}
FIRST_FONT = ["name", "embedded", "damaged", "glyphCount"]
REGION_KINDS = {"IMAGE": ("imageCount", 4), "ANNOTATION": ("annotationCount", 5), "FORM_FIELD": ("formFieldCount", 5), "VECTOR_PATH": ("vectorPathCount", 6)}


def annotation_lines(rows: DataFrame, most: int) -> DataFrame:
    """(n, line): an error line for each failed file and a warning for each page with findings, the first `most` in the order
    (ordinal, page_number), then one notice of how many more there are.

    rows: ordinal, page_number, path, failed, message. The first rows are a top-k by two keys, never one sorted table.
    """
    order = ["ordinal", "page_number"]
    level, title = F.when(F.col("failed"), "error").otherwise("warning"), F.when(F.col("failed"), "PDF audit failed").otherwise("PDF text-layer finding")
    line = F.concat(F.lit("::"), level, F.lit(" file="), text.escape_property(F.col("path")), F.lit(",title="), text.escape_property(title), F.lit("::"), text.escape_data(F.col("message")))
    first = rows.select(*order, line.alias("line")).orderBy(*order).limit(most)
    first = first.select(F.row_number().over(W.orderBy(*order)).cast("bigint").alias("n"), "line")
    more = rows.agg((F.count("*") - most).alias("more")).filter("more > 0")
    notice = F.concat(F.lit("::notice title=PDF audit annotations limited::"), F.col("more").cast("string"), F.lit(" additional annotation(s) are available in the JSON report."))
    return first.unionByName(more.select(F.lit(most + 1).cast("bigint").alias("n"), notice.alias("line")))


def summary_row(path: Column, error: Column, attention: Column, page_count: Column, need: Column, inspected: Column) -> Column:
    """A row of the markdown table for one file."""
    said = F.when(error.isNotNull(), F.concat(F.lit("Error | "), text.escape_html(error))).when(~attention, F.concat(F.lit("Passed | "), page_count.cast("string"), F.lit(" page(s)")))
    said = said.otherwise(F.concat(F.lit("Needs attention | "), need.cast("string"), F.lit(" of "), inspected.cast("string"), F.lit(" inspected page(s)")))
    return F.concat(F.lit("| <code>"), text.escape_html(path), F.lit("</code> | "), said, F.lit(" |"))


#: What stands around a summary's rows.
SUMMARY_HEAD = "## PDF Text Layer Audit\n\n| PDF | Result | Details |\n| --- | --- | --- |\n"
SUMMARY_EMPTY = "| — | Passed | No changed PDF files |\n"
SUMMARY_TAIL = "\nFull machine-readable report: <code>{}</code>\n"


def summary(rows: DataFrame, report_path: str) -> DataFrame:
    """One row (summary): the markdown of a run, of rows (ordinal, row). A run's rows are one text, as the format wants; a run holds
    50 files at most."""
    body = rows.agg(F.array_sort(F.collect_list(F.struct("ordinal", "row"))).alias("x")).select(F.when(F.size("x") == 0, SUMMARY_EMPTY).otherwise(F.array_join(F.transform("x", lambda x: F.concat(x["row"], F.lit("\n"))), "")).alias("body"))
    head, tail = SUMMARY_HEAD, SUMMARY_TAIL.split("{}")
    return body.select(F.concat(F.lit(head), "body", F.lit(tail[0]), text.escape_html(F.lit(report_path)), F.lit(tail[1])).alias("summary"))


def outputs(counters: DataFrame, report_path: str) -> DataFrame:
    """(n, line): the four outputs of a run."""
    lines = [F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("files_checked", "files_with_findings", "files_failed")]
    return counters.select(F.posexplode(F.array(*lines, F.lit(f"report_path={report_path}"))).alias("n", "line"))


#: Members of a page's blocks in report order, as (member, counter, type); a block without evidence isn't assessed.
BLOCKS = {
    "textSurfaces": [("pageContentGlyphCount", "page_content", "int"), ("formXObjectGlyphCount", "in_forms", "int"), ("actualTextGlyphCount", "under_actual", "int"), ("actualTextCharacterCount", "actual_chars", "int")],
    "semanticMapping": [("rawMappedGlyphCount", "mapped", "int"), ("rawUnmappedGlyphCount", "unmapped", "int"), ("actualTextResolvedGlyphCount", "resolved", "int"), ("malformedToUnicodeFontCount", "bad_fonts", "int"), ("implicitCompositeMappingGlyphCount", "implicit", "int")],
    "readingOrder": [("assessed", "order_assessed", "boolean"), ("diverges", "diverges", "boolean"), ("streamCharacterCount", "stream_chars", "int"), ("positionCharacterCount", "position_chars", "int")],
    "geometryVisibility": [("assessed", "visual_assessed", "boolean"), ("visibleGlyphCount", "visible_count", "int"), ("invisibleGlyphCount", "invisible_count", "int"), ("offPageGlyphCount", "off_page_count", "int"), ("clippedGlyphCount", "clipped_count", "int"), ("transparentGlyphCount", "transparent_count", "int"), ("duplicateOverlapGlyphCount", "duplicate_count", "int"), ("rotatedGlyphCount", "rotated_count", "int"), ("verticalGlyphCount", "vertical_count", "int")],
    "visualContent": [("assessed", "visual_assessed", "boolean"), ("imageCount", "image_count", "int"), ("maxImageCoverageRatio", "max_coverage", "double"), ("combinedImageCoverageRatio", "union_share", "double"), ("imageOccupiedGridCellCount", "image_cells", "int"), ("imageTextOverlapGridCellCount", "overlap_cells", "int"), ("imageTextOverlapRatio", "overlap_ratio", "double"), ("paintedVectorPathCount", "paths", "int"), ("annotationCount", "annotation_count", "int"), ("widgetAnnotationCount", "widget_count", "int"), ("optionalContentPresent", "layers_present", "boolean")],
    "annotationAppearances": [("assessed", "visual_assessed", "boolean"), ("appearanceStreamCount", "appearance_streams", "int"), ("glyphCount", "annotation_glyphs", "int"), ("unicodeCharacterCount", "annotation_chars", "int"), ("missingUnicodeGlyphCount", "annotation_missing", "int"), ("replacementCharacterCount", "annotation_replacement", "int")],
    "optionalContent": [("complete", "layers_complete", "boolean"), ("referenceCount", "reference_count", "int"), ("membershipReferenceCount", "membership_reference_count", "int"), ("hiddenInViewReferenceCount", "hidden_in_view_count", "int"), ("hiddenInPrintReferenceCount", "hidden_in_print_count", "int"), ("hiddenInExportReferenceCount", "hidden_in_export_count", "int"), ("evaluationFailureCount", "evaluation_failure_count", "int")],
    "unicodeProfile": [("scripts", "scripts", "array<string>"), ("rightToLeftCharacterCount", "rtl", "int"), ("combiningMarkCount", "combining", "int"), ("nonBmpCharacterCount", "non_bmp", "int"), ("variationSelectorCount", "variation", "int"), ("zeroWidthJoinerCount", "joiners", "int"), ("bidiControlCount", "bidi", "int")],
    "spatialEvidence": [("assessed", "geometry_assessed", "boolean"), ("pageWidthPoints", "page_width", "double"), ("pageHeightPoints", "page_height", "double"), ("rotationDegrees", "page_rotation", "int"), ("coordinateSpace", "space", "string"), ("totalLocationCount", "location_total", "bigint"), ("locationsTruncated", "locations_truncated", "boolean"), ("locations", "locations", None), ("visualRegions", "visual_regions", None)],
}
#: The five counters of a page; flags that are false, counters that are 0 and lists that are empty where nothing was assessed.
COUNTERS = [("glyphCount", "glyphs"), ("unicodeCharacterCount", "chars"), ("missingUnicodeGlyphCount", "missing"), ("replacementCharacterCount", "replacement"), ("tinyTextGlyphCount", "tiny")]
NEVER_NULL = {"assessed", "complete", "locationsTruncated", "totalLocationCount", *(m for b in ("textSurfaces", "semanticMapping", "readingOrder", "optionalContent", "unicodeProfile") for m, _, _ in BLOCKS[b])}
LOCATION = "array<struct<code: string, xPoints: double, yPoints: double, widthPoints: double, heightPoints: double>>"
REGIONS = "struct<totalRegionCount: int, regionsTruncated: boolean, counts: struct<imageCount: int, annotationCount: int, formFieldCount: int, vectorPathCount: int>, regions: array<struct<type: string, xPoints: double, yPoints: double, widthPoints: double, heightPoints: double>>>"
COORDINATES = "TOP_LEFT_DISPLAY_POINTS"


def page_struct(columns: list[str]) -> Column:
    """A page's struct in report order, of rows with page_number, classification, codes, fonts and the counters that columns has. A
    counter that isn't there is null, for not assessed, or 0, false or empty where the report has no null."""

    def member(name: str, counter: str, kind: str | None) -> Column:
        if name == "locations":
            kind, zero = LOCATION, F.array()
        elif name == "visualRegions":
            kind, zero = REGIONS, F.struct(F.lit(0).alias("totalRegionCount"), F.lit(False).alias("regionsTruncated"), F.struct(*(F.lit(0).alias(k) for k in ("imageCount", "annotationCount", "formFieldCount", "vectorPathCount"))).alias("counts"), F.array().cast("array<struct<type: string, xPoints: double, yPoints: double, widthPoints: double, heightPoints: double>>").alias("regions"))
        else:
            zero = {"boolean": F.lit(False), "array<string>": F.array()}.get(kind, F.lit(0))
        own = F.col(counter) if counter in columns else F.lit(None)
        never = name in NEVER_NULL or name in ("locations", "visualRegions")
        return (F.coalesce(own.cast(kind), zero.cast(kind)) if never else own.cast(kind)).alias(name)

    blocks = [F.struct(*(member(*m) for m in members)).alias(b) for b, members in BLOCKS.items()]
    counters = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(m) for m, c in COUNTERS]
    fonts = F.coalesce("fonts", F.array().cast("array<struct<name: string, subtype: string, encoding: string, embedded: boolean, damaged: boolean, vertical: boolean, toUnicodePresent: boolean, subset: boolean, glyphCount: int, rawUnmappedGlyphCount: int>>"))
    return F.struct(F.col("page_number").cast("int").alias("pageNumber"), *counters, F.col("classification"), *blocks, fonts.alias("fonts"), F.col("codes").alias("findings"))


def font_structs(fonts: Column) -> Column:
    """The fonts of operators.text.fonts_by_page under their names in the report."""
    names = [("name", "name"), ("subtype", "subtype"), ("encoding", "encoding"), ("embedded", "embedded"), ("damaged", "damaged"), ("vertical", "vertical"), ("to_unicode_present", "toUnicodePresent"), ("subset", "subset")]
    counts = [("glyph_count", "glyphCount"), ("raw_unmapped_glyph_count", "rawUnmappedGlyphCount")]
    return F.transform(fonts, lambda f: F.struct(*(f[a].alias(b) for a, b in names), *(f[a].cast("int").alias(b) for a, b in counts)))


def finding_structs(codes: Column) -> Column:
    told = F.create_map(*(F.lit(x) for c, d, _ in FINDINGS for x in (c, d)))
    return F.transform(codes, lambda c: F.struct(c.alias("code"), told[c].alias("description")))


def older_spatial(spatial: Column, version: int) -> Column:
    """Spatial evidence as a version has it: no regions before 4, no counts of them before 5, and only the kinds that it knows."""
    if version >= SCHEMA_VERSION:
        return spatial
    if version < 4:
        return spatial.dropFields("visualRegions")
    known = {k: c for k, (c, since) in REGION_KINDS.items() if since <= version}
    regions = spatial["visualRegions"]
    kept = F.filter(regions["regions"], lambda r: r["type"].isin(*known))
    total = sum((regions["counts"][c] for c in known.values()), F.lit(0))
    counts = [F.struct(*(regions["counts"][c].alias(c) for c in known.values())).alias("counts")] if version >= 5 else []
    return spatial.withField("visualRegions", F.struct(total.alias("totalRegionCount"), (total > F.size(kept)).alias("regionsTruncated"), *counts, kept.alias("regions")))


def report_json(files: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """(file_id, json) of files: file, fileSizeBytes, pageCount, encrypted, extractionAllowed, tinyTextThresholdPoints, parseHealth, completeness, documentSurfaces and pages (array of page structs).

    Nulls are kept, for null means not assessed. Derived members (inspectedPageCount, needsAttention, pagesNeedingAttention)
    are made here. Older versions leave out what came later: page structs, members of fonts, kinds of regions. A page's struct has
    its members in report order.
    """
    pages = F.col("pages")
    fields = [f.name for f in files.schema["pages"].dataType.elementType.fields]
    kept = [f for f in fields if SINCE.get(f, 1) <= version]

    def page(p: Column) -> Column:
        cols = [(older_spatial(p[f], version) if f == "spatialEvidence" else p[f]).alias(f) for f in kept if f not in ("fonts", "findings")]
        fonts = p["fonts"] if version >= 2 else F.transform(p["fonts"], lambda x: F.struct(*(x[m].alias(m) for m in FIRST_FONT)))
        tail = [fonts.alias("fonts")] if "fonts" in kept else []
        return F.struct(*cols, (F.size(p["findings"]) > 0).alias("needsAttention"), *tail, finding_structs(p["findings"]).alias("findings"))

    need = F.size(F.filter(pages, lambda p: F.size(p["findings"]) > 0))
    s = F.col("documentSurfaces")
    profile = ~s["complete"] | (s["acroFormFieldCount"] > 0) | s["xfaPresent"] | (s["embeddedFileCount"] > 0) | (s["associatedFileReferenceCount"] > 0) | s["portfolioPresent"]
    h = F.col("parseHealth")
    attention = F.coalesce(h["recovered"] | ~h["complete"] | profile, F.lit(True)) | (need > 0)
    later = ["parseHealth", "completeness", "documentSurfaces"] if version >= 2 else []
    out = F.struct(
        F.lit(version).alias("schemaVersion"), "file", "fileSizeBytes", "pageCount", F.size(pages).alias("inspectedPageCount"), "encrypted", "extractionAllowed", "tinyTextThresholdPoints", *later,
        attention.alias("needsAttention"), need.alias("pagesNeedingAttention"), F.transform(pages, page).alias("pages"),
    )
    return files.select("file_id", F.to_json(out, {"ignoreNullFields": "false"}).alias("json"))


def text_report(files: DataFrame) -> DataFrame:
    """(file_id, report) in plain text, of the files of report_json; names are escaped for terminals."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    line = lambda *x: F.concat(*(v if isinstance(v, Column) else F.lit(v) for v in x), F.lit("\n"))
    h, s, pages = F.col("parseHealth"), F.col("documentSurfaces"), F.col("pages")
    flags = [F.col(f"completeness.{f}") for f in ("pageContent", "formXObjects", "semanticMappings", "readingOrder", "geometryVisibility", "annotations", "optionalContent")]
    direct = flags[0]
    for f in flags[1:]:
        direct = direct & f
    threshold = F.when(F.col("tinyTextThresholdPoints") == 0, "disabled").otherwise(F.format_string("%.2f pt", F.col("tinyTextThresholdPoints").cast("double")))
    head = F.concat(
        line("PDF Text Layer Audit"), line("File: ", text.escape_terminal(F.col("file"))), line("Size: ", F.format_string("%.2f MiB", F.col("fileSizeBytes") / 1048576.0)), line("Pages in document: ", shown(F.col("pageCount"))), line("Pages inspected: ", shown(F.size(pages))),
        line("Encrypted: ", shown(F.col("encrypted"))), line("Tiny text threshold: ", threshold), line("Parse complete: ", shown(h["complete"])), line("Parse recovered: ", shown(h["recovered"])), line("Parser recovery warnings: ", shown(h["parserWarningCount"])),
        line("Typed parse diagnostics: ", shown(F.size(h["diagnostics"]))), line("Evidence complete for direct routing: ", shown(direct)),
        line("Document surfaces: complete=", shown(s["complete"]), ", form fields=", shown(s["acroFormFieldCount"]), ", signatures=", shown(s["signatureFieldCount"]), ", embedded files=", shown(s["embeddedFileCount"]), ", associated files=", shown(s["associatedFileReferenceCount"]), ", XFA=", shown(s["xfaPresent"]), ", portfolio=", shown(s["portfolioPresent"])),
        line(""),
    )
    told = F.create_map(*(F.lit(x) for c, d, _ in FINDINGS for x in (c, d)))

    def page(p: Column) -> Column:
        n = F.size(p["fonts"])
        fonts = F.array_join(F.transform(p["fonts"], lambda f: line("  Font: ", text.escape_terminal(f["name"]), " | embedded=", shown(f["embedded"]), " | damaged=", shown(f["damaged"]), " | glyphs=", shown(f["glyphCount"]))), "")
        found = F.when(F.size(p["findings"]) == 0, line("  OK: no problems found in the assessed evidence")).otherwise(F.array_join(F.transform(p["findings"], lambda c: line("  WARN ", c, ": ", told[c])), ""))
        return F.concat(
            line("Page ", shown(p["pageNumber"]), ": ", shown(p["glyphCount"]), " glyphs, ", shown(p["unicodeCharacterCount"]), " Unicode characters, ", shown(n), F.when(n == 1, " font").otherwise(" fonts")), line("  Classification: ", p["classification"]),
            line("  Text surfaces: page=", shown(p["textSurfaces"]["pageContentGlyphCount"]), ", forms=", shown(p["textSurfaces"]["formXObjectGlyphCount"]), ", ActualText glyphs=", shown(p["textSurfaces"]["actualTextGlyphCount"])),
            line("  Raw Unicode mapping: mapped=", shown(p["semanticMapping"]["rawMappedGlyphCount"]), ", unmapped=", shown(p["semanticMapping"]["rawUnmappedGlyphCount"]), ", ActualText-resolved=", shown(p["semanticMapping"]["actualTextResolvedGlyphCount"]), ", implicit-composite=", shown(p["semanticMapping"]["implicitCompositeMappingGlyphCount"])),
            line("  Reading order: assessed=", shown(p["readingOrder"]["assessed"]), ", diverges=", shown(p["readingOrder"]["diverges"])), fonts, found,
        )

    n, need = F.size(pages), F.size(F.filter(pages, lambda p: F.size(p["findings"]) > 0))
    profile = ~s["complete"] | (s["acroFormFieldCount"] > 0) | s["xfaPresent"] | (s["embeddedFileCount"] > 0) | (s["associatedFileReferenceCount"] > 0) | s["portfolioPresent"]
    result = F.when(need > 0, F.concat(F.lit("Result: "), shown(need), F.lit(" of "), shown(n), F.when(n == 1, " page needs attention").otherwise(" pages need attention")))
    result = result.when(h["recovered"] | ~h["complete"], "Result: document parsing requires review").when(F.coalesce(profile, F.lit(True)), "Result: document-level surfaces require a downstream profile").otherwise("Result: no inspected text-layer problems were found")
    return files.select("file_id", F.concat(head, F.array_join(F.transform(pages, page), ""), line(""), line(result)).alias("report"))


def action_report(files: DataFrame, counters: DataFrame, repository: str, number: int, fail_on_findings: bool = True) -> DataFrame:
    """One row (json): a run's counters, conclusion and files (ordinal, path, error, attention, json: of the report).

    The files of one run meet in one row, as the format wants; a run holds 50 at most (batch.check_workload).
    """
    from glyphlake.operators import batch

    status = F.when(F.col("error").isNotNull(), "error").when(F.col("attention"), "attention").otherwise("passed")
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    value = lambda c: F.regexp_extract(quoted(c), r"(?s)^\{\"v\":(.*)\}$", 1)
    tail = F.when(F.col("error").isNotNull(), F.concat(F.lit(',"error":'), value(F.col("error")))).otherwise(F.concat(F.lit(',"report":'), F.coalesce("json", F.lit("null"))))
    one = F.concat(F.lit('{"path":'), value(F.col("path")), F.lit(',"status":"'), status, F.lit('"'), tail, F.lit("}"))
    rows = files.select("ordinal", one.alias("one")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "one"))).alias("x")).select(F.array_join(F.transform("x", lambda x: x["one"]), ",").alias("files"))
    code = batch.exit_code(F.col("files_failed"), F.col("files_with_findings"), fail_on_findings)
    head = counters.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(repository).alias("repository"), F.lit(number).alias("pullRequestNumber"), F.col("files_checked").alias("filesChecked"), F.col("files_with_findings").alias("filesWithFindings"), F.col("files_failed").alias("filesFailed"), batch.conclusion(code, F.col("files_with_findings")).alias("conclusion"))).alias("head"))
    return head.crossJoin(rows).select(F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"files":['), "files", F.lit("]}")).alias("json"))  # one row each
