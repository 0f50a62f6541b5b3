"""Expectations on literal rows, operator by operator."""

import json

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import numbers, pages, text
from glyphlake.operators import batch, optional_content, reports, rules, surfaces, visual
from glyphlake.operators import text as ops

CROP = "named_struct('x', 0D, 'y', 0D, 'w', 612D, 'h', 792D) AS crop"
GLYPH = "file_id string, page_number int, glyph_no bigint, raw_unicode string, code_unicodes array<string>, mapping_untrusted boolean, in_form boolean, actual_text_frame bigint, actual_text string"


def glyphs(spark, *raw, untrusted=False, frame=None, actual=None):
    return spark.createDataFrame([("f", 1, i, u, None, untrusted, False, frame, actual) for i, u in enumerate(raw)], GLYPH)


def test_display_of_a_box_under_all_rotations(spark):
    crop = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(200.0).alias("w"), F.lit(100.0).alias("h"))
    box = {"x0": F.lit(40.0), "y0": F.lit(50.0), "x1": F.lit(60.0), "y1": F.lit(60.0), "crop": crop}
    rows = spark.createDataFrame([(r,) for r in (0, 90, 180, 270, 45, -90)], "rotation int").withColumns(box)
    got = {x["rotation"]: (x["x"], x["y"], x["w"], x["h"]) for x in numbers.displayed(rows).collect()}
    assert got.pop(-90) == got[270]
    assert got == {0: (30, 60, 20, 10), 90: (30, 30, 10, 20), 180: (150, 30, 20, 10), 270: (60, 150, 10, 20)}


def test_one_control_glyph_is_counted_and_missing(spark):
    row = ops.mapping_counters(ops.with_semantics(glyphs(spark, "\x01"))).first()
    chars = ops.character_counters(ops.with_semantics(glyphs(spark, "\x01"))).first()
    assert (row["missing_count"], chars["unicode_character_count"]) == (1, 1)


def test_replacement_text_resolves_an_unmapped_glyph(spark):
    rows = ops.with_semantics(glyphs(spark, None, frame=0, actual="क"))
    m, c = ops.mapping_counters(rows).first(), ops.character_counters(rows).first()
    assert (m["missing_count"], m["unmapped_count"], m["resolved_count"], m["actual_text_glyph_count"], c["unicode_character_count"]) == (0, 1, 1, 1, 1)


@pytest.mark.parametrize(("string", "usable"), [("A", True), ("é", True), ("", False), (None, False), ("\x00", False), ("�", False), ("", False), ("͸", False), ("﷐", False), ("\U0010ffff", False), ("\U0001f600", True)])
def test_usable_text(spark, string, usable):
    assert spark.createDataFrame([(string,)], "t string").select(text.usable(F.col("t"))).first()[0] is usable


@pytest.mark.parametrize(("string", "rtl"), [("مرحبا", True), ("שלום", True), ("ܫܠܡܐ", True), ("hello", False), ("٠", False), ("漢字", False), ("नमस्ते", False)])
def test_right_to_left(spark, string, rtl):
    assert (spark.createDataFrame([(string,)], "t string").select(text.count_of(F.col("t"), text.rtl())).first()[0] > 0) is rtl


@pytest.mark.parametrize(("string", "names"), [("hello é", ["LATIN"]), ("привет", ["CYRILLIC"]), ("שלום ab", ["HEBREW", "LATIN"]), ("漢字かなカナ", ["HAN", "HIRAGANA", "KATAKANA"]), ("한국어", ["HANGUL"]), ("नमस्ते", ["DEVANAGARI"]), ("ไทย", ["THAI"]), ("12, .", []), ("ქართული", ["GEORGIAN"]), ("አማርኛ", ["ETHIOPIC"])])
def test_scripts(spark, string, names):
    assert ops.scripts(ops.with_semantics(glyphs(spark, *string))).first()["scripts"] == names


def test_tiny_text_thresholds(spark):
    one = spark.createDataFrame([(2.5,)], "s float")
    assert one.select(*(ops.tiny(F.col("s"), t).alias(f"t{i}") for i, t in enumerate((3.0, 2.0, 0.0)))).first()[:] == (True, False, False)


def test_reading_order(spark):
    page = lambda t: spark.createDataFrame([("f", 1, t)], "file_id string, page_number int, text string")
    row = ops.reading_order(page("BA"), page("AB")).first()
    assert (row["diverges"], row["stream_character_count"], row["position_character_count"]) == (True, 2, 2)
    assert not ops.reading_order(page("a b"), page(" a b\n")).first()["diverges"]


def test_locations_are_capped_and_counted(spark):
    rows = spark.range(12).select(F.lit("f").alias("file_id"), F.lit(1).alias("page_number"), F.col("id").alias("glyph_no"), F.lit("MISSING_UNICODE").alias("code"), *(F.lit(v).alias(k) for k, v in (("x_dir", 1.0), ("y_dir", 20.0), ("w_dir", -3.0), ("h_dir", 10.0))))
    got = ops.locations(rows).orderBy("n").collect()
    assert len(got) == 8 and (got[0]["x"], got[0]["y"], got[0]["w"], got[0]["h"]) == (1.0, 10.0, 3.0, 10.0)
    assert ops.location_totals(rows).first()[2:] == (12, True)


def test_visibility_kinds(spark):
    rows = [("f", 1, 0, True, False, 1.0, 1.0, 10.0, 10.0, True, 65), ("f", 1, 1, True, False, 1.0, 1.0, 10.0, 10.0, True, 65), ("f", 1, 2, False, False, 1.0, 1.0, 30.0, 10.0, True, 66), ("f", 1, 3, True, False, 0.0, 1.0, 40.0, 10.0, True, 67), ("f", 1, 4, True, False, 1.0, 1.0, -5.0, 10.0, True, 68), ("f", 1, 5, True, False, 1.0, 1.0, 60.0, 10.0, False, 69)]
    df = spark.createDataFrame(rows, "file_id string, page_number int, glyph_no int, fill boolean, stroke boolean, fill_alpha double, stroke_alpha double, x double, y double, in_clip boolean, code int")
    df = df.select("*", F.expr(CROP), F.lit(1.0).alias("scale_x"), F.lit(0.0).alias("shear_y"), F.lit(False).alias("vertical"), F.lit("F").alias("font_name"))
    row = visual.visibility_counters(df).first()
    assert [row[f"{k}_count"] for k in ("invisible", "transparent", "off_page", "clipped", "visible", "vertical")] == [1, 1, 1, 1, 2, 0]
    assert visual.duplicate_glyphs(df).first()["duplicate_count"] == 1


def test_two_half_page_images(spark):
    rows = spark.createDataFrame([("f", 1, 0.0, 0.0, 306.0, 792.0), ("f", 1, 306.0, 0.0, 612.0, 792.0)], "file_id string, page_number int, x0 double, y0 double, x1 double, y1 double").select("*", F.expr(CROP))
    assert visual.coverage(rows).first()["max_coverage"] < 0.51 and visual.union_share(rows).first()["union_share"] > 0.99


def test_classes_of_pages(spark):
    rows = [(0, 0, 1, 0, 0.0, 0, 0.0), (0, 1, 0, 0, 1.0, 64, 0.0), (9, 0, 0, 9, 0.0, 0, 0.0), (9, 1, 0, 9, 0.1, 4, 0.0), (3, 1, 0, 3, 0.9, 64, 0.0), (90, 1, 0, 90, 0.9, 64, 0.1), (0, 0, 0, 0, 0.0, 0, 0.0), (90, 1, 0, 90, 0.9, 64, 0.5)]
    df = spark.createDataFrame(rows, "g int, i int, p int, c int, s double, n int, o double")
    got = [r[0] for r in df.select(visual.classification(*(F.col(c) for c in "gipcsno"))).collect()]
    assert got == ["VECTOR_ONLY", "IMAGE_ONLY", "NATIVE_TEXT", "MIXED", "SPARSE_OCR", "PARTIAL_OCR", "BLANK", "MIXED"]


def test_regions_are_capped(spark):
    rows = spark.range(33).select(F.lit("f").alias("file_id"), F.lit(1).alias("page_number"), F.lit("VECTOR_PATH").alias("type"), F.col("id").alias("paint_no"), F.lit(1.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(2.0).alias("x1"), F.lit(2.0).alias("y1"), F.expr(CROP), F.lit(90).alias("rotation"))
    shown = visual.regions(rows)
    row = visual.region_counts(shown).first()
    assert (row["total_region_count"], row["vector_path_regions"], row["truncated"], visual.region_samples(shown).count()) == (33, 33, True, 32)


def test_unknown_operands_are_strict(spark):
    nodes = [("f", 1, "group", None, None, True, "OFF", "ON", None), ("f", 2, "expr", None, "Not", None, None, None, None), ("f", 3, "expr", None, "And", None, None, None, None), ("f", 4, "membership", None, None, None, None, None, None), ("f", 5, "expr", None, "Not", None, None, None, None)]
    nodes = spark.createDataFrame(nodes, "file_id string, node bigint, kind string, policy string, op string, enabled boolean, view_state string, print_state string, export_state string")
    edges = spark.createDataFrame([("f", 3, 0, 1), ("f", 3, 1, 2), ("f", 5, 0, 1)], "file_id string, parent bigint, ordinal int, child bigint")
    got = {(r["node"], r["destination"]): r["hidden"] for r in optional_content.evaluate(nodes, edges).collect()}
    assert got[1, "view"] is True and got[1, "print"] is False and got[1, "export"] is False
    assert got[2, "view"] is None and got[3, "view"] is None and got[4, "view"] is False and got[5, "view"] is False and got[5, "print"] is True


def test_null_references_add_three_failures(spark):
    nodes = spark.createDataFrame([("f", 1, "group", None, None, True, "ON", "OFF", "ON")], "file_id string, node bigint, kind string, policy string, op string, enabled boolean, view_state string, print_state string, export_state string")
    edges = spark.createDataFrame([], "file_id string, parent bigint, ordinal int, child bigint")
    refs = spark.createDataFrame([("f", 1, 1, 1), ("f", 1, 2, None)], "file_id string, page_number int, ref_no bigint, node bigint")
    row = optional_content.reference_counters(refs, nodes, optional_content.evaluate(nodes, edges)).first()
    assert (row["reference_count"], row["hidden_in_view_count"], row["hidden_in_print_count"], row["hidden_in_export_count"], row["evaluation_failure_count"], row["complete"]) == (1, 0, 1, 0, 3, False)


def test_a_tree_with_a_cycle_is_incomplete(spark):
    rows = spark.createDataFrame([("f", 1, None, True, None, None, False, 4), ("f", 2, 1, True, None, None, False, 2), ("f", 2, 2, True, None, None, False, 2), ("g", 1, None, True, "Sig", None, False, 3)], "file_id string, node bigint, parent bigint, is_dict boolean, field_type string, subtype string, has_appearance boolean, names_len int")
    got = {r["file_id"]: (r["embedded_file_count"], r["complete"]) for r in surfaces.embedded_files(rows).collect()}
    assert got == {"f": (3, False), "g": (1, False)}
    assert {r["file_id"]: (r["acro_form_field_count"], r["signature_field_count"], r["complete"]) for r in surfaces.form_fields(rows).collect()} == {"f": (2, 0, False), "g": (1, 1, True)}


def test_limits_report_the_first_in_working_order(spark):
    got = spark.range(1).select(rules.limit_code({"IMAGE_COUNT": F.lit(9), "GLYPH_COUNT": F.lit(9)}, {"IMAGE_COUNT": 1, "GLYPH_COUNT": 2}).alias("c")).withColumn("m", rules.limit_message(F.col("c"), {"GLYPH_COUNT": 2})).first()
    assert got[:] == ("GLYPH_COUNT", "PDF exceeds the configured glyph-count limit of 2")


def test_page_selections():
    assert pages.resolve("7,3-5,1,4", 10) == [1, 3, 4, 5, 7]
    assert pages.resolve(None, 3) == [1, 2, 3]
    with pytest.raises(pages.PageSelectionError, match="Requested page 2 exceeds document page count of 1"):
        pages.resolve("2", 1)
    for bad in ("", "0", "3-1", "a", "1-2-3", "1,"):
        with pytest.raises(pages.PageSelectionError):
            pages.resolve(bad, 5)


def test_changed_files(spark):
    rows = spark.createDataFrame([(0, "one.pdf", "added"), (1, "TWO.PDF", "renamed"), (2, "deleted.pdf", "removed"), (3, "README.md", "added"), (4, "one.pdf", "modified")], "ordinal int, filename string, status string")
    assert [r["filename"] for r in batch.changed_pdfs(rows).orderBy("ordinal").collect()] == ["one.pdf", "TWO.PDF"]


def test_workload(spark):
    two = spark.createDataFrame([(1,), (2,)], "size_bytes bigint")
    with pytest.raises(batch.WorkloadError):
        batch.check_workload(two, 1)
    batch.check_workload(two, 2)


def test_exit_codes_and_conclusions(spark):
    rows = spark.createDataFrame([(0, 0), (0, 2), (1, 2)], "failed int, found int")
    got = [r[:] for r in rows.select(batch.exit_code(F.col("failed"), F.col("found"), True), batch.exit_code(F.col("failed"), F.col("found"), False)).collect()]
    assert got == [(0, 0), (1, 0), (2, 2)]


def test_escapes(spark):
    row = spark.createDataFrame([("docs/a,b%file|x.pdf", "a\x1b\n‮b")], "p string, f string").select(text.escape_property(F.col("p")), text.escape_html(F.col("p")), text.escape_terminal(F.col("f"))).first()
    assert row[:] == ("docs/a%2Cb%25file|x.pdf", "docs/a,b%file&#124;x.pdf", "a\\u001B\\u000A\\u202Eb")


def test_no_annotations_but_a_notice(spark):
    rows = spark.createDataFrame([(1, 1, "a.pdf", False, "Page 1: TINY_TEXT")], "ordinal int, page_number int, path string, failed boolean, message string")
    assert [r["line"] for r in reports.annotation_lines(rows, 0).collect()] == ["::notice title=PDF audit annotations limited::1 additional annotation(s) are available in the JSON report."]


def test_json_report_keeps_nulls_and_derives(spark):
    from support import DATA

    from glyphlake.plans.report_queries import report_files

    files = report_files(spark, f"{DATA}/sf0.001").filter("file_id < 3").cache()
    for version, struct in ((6, True), (1, False)):
        x = json.loads(reports.report_json(files, version).first()["json"])
        assert x["schemaVersion"] == version and ("textSurfaces" in x["pages"][0]) is struct and x["inspectedPageCount"] == len(x["pages"])
        assert x["pagesNeedingAttention"] == sum(p["needsAttention"] for p in x["pages"])
    assert '"visibleGlyphCount":null' in reports.report_json(files).first()["json"]
    counters = spark.createDataFrame([(1, 1, 0)], "files_checked bigint, files_with_findings bigint, files_failed bigint")
    one = reports.report_json(files).limit(1).select(F.lit(1).alias("ordinal"), F.lit('a"b.pdf').alias("path"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("attention"), "json")
    x = json.loads(reports.action_report(one, counters, "o/r", 7).first()["json"])
    assert x["conclusion"] == "findings" and x["files"][0]["path"] == 'a"b.pdf' and x["files"][0]["status"] == "attention" and x["files"][0]["report"]["schemaVersion"] == 6
