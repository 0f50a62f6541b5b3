"""Queries of the text pass, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import rules, visual
from glyphlake.operators import text as ops
from glyphlake.schema import FINDINGS, PAGE
from glyphlake.sources import evidence as ev

QUERIES: dict = {}
ORACLE: dict = {}
TINY = 3.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH d AS (SELECT doc_id AS file_id, coalesce(text, '') AS text, unnest(range(1, 1 + greatest(1, ceil(length(coalesce(text, '')) / {ev.PAGE_CHARS}))::BIGINT)) AS page_number FROM documents) SELECT file_id, page_number::INT AS page_number, length(substring(text, (page_number - 1) * {ev.PAGE_CHARS} + 1, {ev.PAGE_CHARS})) AS glyph_count FROM d")
def page_glyph_counts(spark, sf_dir):
    return ev.pages(spark, sf_dir).select("file_id", "page_number", F.char_length("text").cast("bigint").alias("glyph_count"))


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, sum(length(semantic))::BIGINT AS unicode_character_count, sum(CASE WHEN active THEN length(semantic) ELSE 0 END)::BIGINT AS actual_text_character_count FROM s GROUP BY ALL")
def page_unicode_char_counts(spark, sf_dir):
    rows = ops.with_semantics(ev.text_glyphs(spark, sf_dir))
    n = text.code_points(F.col("semantic"))
    return rows.groupBy(*PAGE).agg(F.sum(n).alias("unicode_character_count"), F.sum(F.when(F.col("active"), n).otherwise(0)).alias("actual_text_character_count"))


#: What runs right to left among what is injected.
_RTL = "sum(length(semantic) - length(translate(semantic, chr(1488) || chr(8207) || chr(65165) || chr(1563), '')))::BIGINT"
_CLASS = "CASE WHEN glyph_count = 0 THEN CASE WHEN images > 0 THEN 'IMAGE_ONLY' WHEN paths > 0 THEN 'VECTOR_ONLY' ELSE 'BLANK' END WHEN images = 0 THEN 'NATIVE_TEXT' WHEN union_share >= 0.75 AND chars <= 32 THEN 'SPARSE_OCR' WHEN union_share >= 0.75 AND image_cells > 0 AND overlap_ratio < 0.25 THEN 'PARTIAL_OCR' ELSE 'MIXED' END"
_PAGES = f"""WITH {ev.TEXT_GLYPHS}, k AS (SELECT file_id, page_number, count(*) AS glyph_count, count(*) FILTER (NOT active AND missing) AS missing, sum(length(semantic) - length(replace(semantic, chr(65533), ''))) AS repl,
 count(*) FILTER (font_size_pt < 3.0::FLOAT) AS tiny, count(*) FILTER (font_obj = 0 AND NOT mapping_untrusted) AS implicit, {_RTL} AS rtl, sum(length(semantic)) AS chars FROM s GROUP BY ALL
  UNION ALL SELECT doc_id, 1, 0, 0, 0, 0, 0, 0, 0 FROM documents WHERE coalesce(text, '') = ''),
 e AS (SELECT *, {", ".join(f"{x.replace('.0D', '.0::DOUBLE')} AS {n}" for n, x in ev.PAGE_EVIDENCE)} FROM k), c AS (SELECT *, {_CLASS} AS class FROM e)"""


def page_text(spark, sf_dir, more: list | None = None):
    """All counters of a page's text, by one aggregation of its glyphs, with pages that have none."""
    rows = ops.with_semantics(ev.text_glyphs(spark, sf_dir)).join(F.broadcast(ev.fonts(spark)), "font_obj")  # five fonts
    s = F.col("semantic")
    c = rows.groupBy(*PAGE).agg(
        F.count("*").alias("glyphs"), F.count_if(~F.col("active") & F.col("missing")).alias("missing"), F.sum(text.count_of(s, r"\x{FFFD}")).alias("replacement"), F.count_if(ops.tiny(F.col("font_size_pt"), TINY)).alias("tiny"),
        F.count_if(ops.implicit(F.col("subtype"), F.col("to_unicode_present"), F.col("mapping_untrusted"))).alias("implicit"), F.sum(text.count_of(s, text.rtl())).alias("rtl"), F.sum(text.code_points(s)).alias("chars"), *(more or []),
    )
    none = ev.empty_pages(spark, sf_dir).select(*PAGE, *(F.lit(0).cast("bigint").alias(n) for n in c.columns if n not in PAGE))
    return c.unionByName(none)


def with_findings(counters):
    """Page counters with the other evidence of the page, its class and the codes of its findings."""
    c = ev.with_page_evidence(counters)
    kind = visual.classification(*(F.col(k) for k in ("glyphs", "images", "paths", "chars", "union_share", "image_cells", "overlap_ratio")))
    c = c.withColumn("classification", kind)
    keys = ("glyphs", "missing", "replacement", "tiny", "malformed", "invalid", "implicit", "diverges", "classification", "rtl", "annotation_missing", "annotation_replacement")
    return c.withColumn("codes", rules.findings(rules.triggers({k: F.col(k) for k in keys})))


def _findings(spark, sf_dir):
    return with_findings(page_text(spark, sf_dir))


_TRIGGERS = ["glyph_count = 0", "missing > 0", "repl > 0", "tiny > 0", "malformed > 0", "invalid > 0", "implicit > 0", "diverges", "class = 'SPARSE_OCR'", "class = 'PARTIAL_OCR'", "rtl > 0", "annotation_missing > 0", "annotation_replacement > 0"]
_CODES = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{c}' END" for t, (c, _, _) in zip(_TRIGGERS, FINDINGS, strict=True)) + "], lambda x: x IS NOT NULL)"


@query(f"{_PAGES} SELECT file_id, page_number, array_to_string({_CODES}, ', ') AS findings, len({_CODES})::INT AS n_findings FROM c")
def page_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select(*PAGE, F.array_join("codes", ", ").alias("findings"), F.size("codes").alias("n_findings"))


@query(f"{_PAGES}, r AS (SELECT unnest({_CODES}) AS code, file_id FROM c), dim(ordinal, code, description) AS (VALUES " + ", ".join(f"({i}, '{c}', '{d}')" for i, (c, d, _) in enumerate(FINDINGS)) + ") SELECT ordinal, code, description, count(*) AS pages, count(DISTINCT file_id) AS files FROM r JOIN dim USING (code) GROUP BY ALL")
def finding_rollup(spark, sf_dir):
    rows = _findings(spark, sf_dir).select("file_id", F.explode("codes").alias("code")).groupBy("code", "file_id").agg(F.count("*").alias("n"))
    by = rows.groupBy("code").agg(F.sum("n").alias("pages"), F.count("*").alias("files"))
    dim = rules.finding_table(spark).drop("located")
    return by.join(F.broadcast(dim), "code").select("ordinal", "code", "description", "pages", "files")  # 13 findings


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, count(*) FILTER (font_size_pt < 3.0::FLOAT) AS tiny_count, count(*) FILTER (font_size_pt < 2.0::FLOAT) AS tiny_count_2, 0::BIGINT AS tiny_count_off FROM g GROUP BY ALL")
def tiny_text_by_page(spark, sf_dir):
    n = lambda t, k: F.count_if(ops.tiny(F.col("font_size_pt"), t)).alias(k)
    return ev.text_glyphs(spark, sf_dir).groupBy(*PAGE).agg(n(3.0, "tiny_count"), n(2.0, "tiny_count_2"), n(0.0, "tiny_count_off"))


@query(f"{_PAGES} SELECT file_id, count(*) AS pages, count(*) FILTER (len({_CODES}) > 0) AS pages_needing_attention, bool_or(len({_CODES}) > 0) AS needs_attention FROM c GROUP BY ALL")
def doc_needs_attention(spark, sf_dir):
    need = F.size("codes") > 0
    return _findings(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("pages"), F.count_if(need).alias("pages_needing_attention"), F.bool_or(need).alias("needs_attention"))


#: Texts that do and don't carry usable text.
LITERALS = [("latin", "A", True), ("nfd", "é", True), ("han", "漢", True), ("arabic", "ع", True), ("emoji", "\U0001f600", True), ("zwj", "\U0001f468‍\U0001f469", True), ("variation", "❤️", True), ("empty", "", False), ("control", "\x01", False), ("replacement", "�", False), ("private", "", False), ("unassigned", "͸", False), ("nonchar-fdd0", "﷐", False), ("nonchar-fffe", "￾", False), ("max", "\U0010ffff", False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {u}, {len(t)}::BIGINT)" for k, t, u in LITERALS) + ") v(label, usable, code_points)")
def usable_unicode_flags(spark, sf_dir):
    rows = spark.createDataFrame([(k, t) for k, t, _ in LITERALS], "label string, t string")
    return rows.select("label", text.usable(F.col("t")).alias("usable"), text.code_points(F.col("t")).alias("code_points"))


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, count(*) AS glyph_count, count(*) FILTER (in_form) AS form_glyph_count, count(*) FILTER (NOT in_form) AS page_content_glyph_count, count(*) FILTER (NOT missing) AS mapped_count, count(*) FILTER (missing) AS unmapped_count, count(*) FILTER (active AND missing) AS resolved_count, count(*) FILTER (NOT active AND missing) AS missing_count, count(*) FILTER (active) AS actual_text_glyph_count FROM s GROUP BY ALL")
def mapping_counters(spark, sf_dir):
    return ops.mapping_counters(ops.with_semantics(ev.text_glyphs(spark, sf_dir)))


@query(f"WITH {ev.TEXT_GLYPHS}, {ev.FONT_TABLE} SELECT file_id, page_number, count(*) FILTER (subtype = 'Type0' AND NOT to_unicode_present AND NOT mapping_untrusted) AS implicit_count FROM g JOIN f USING (font_obj) GROUP BY ALL")
def implicit_composite(spark, sf_dir):
    rows = ev.text_glyphs(spark, sf_dir).join(F.broadcast(ev.fonts(spark)), "font_obj")  # five fonts
    return rows.groupBy(*PAGE).agg(F.count_if(ops.implicit(F.col("subtype"), F.col("to_unicode_present"), F.col("mapping_untrusted"))).alias("implicit_count"))


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, sum(length(semantic) - length(replace(semantic, chr(65533), '')))::BIGINT AS replacement_count FROM s GROUP BY ALL")
def replacement_chars(spark, sf_dir):
    return ops.with_semantics(ev.text_glyphs(spark, sf_dir)).groupBy(*PAGE).agg(F.sum(text.count_of(F.col("semantic"), r"\x{FFFD}")).alias("replacement_count"))


def _times(code: str) -> str:
    return f"sum(length(semantic) - length(replace(semantic, {code}, '')))::BIGINT"


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, sum(length(semantic))::BIGINT AS unicode_character_count, {_times('chr(65533)')} AS replacement_character_count, {_RTL} AS right_to_left_count, sum(length(semantic) - length(translate(semantic, chr(769) || chr(65039), '')))::BIGINT AS combining_mark_count, {_times('chr(128512)')} AS non_bmp_count, {_times('chr(65039)')} AS variation_selector_count, {_times('chr(8205)')} AS zero_width_joiner_count, sum(length(semantic) - length(translate(semantic, chr(8207), '')))::BIGINT AS bidi_control_count FROM s GROUP BY ALL")
def unicode_profile(spark, sf_dir):
    return ops.character_counters(ops.with_semantics(ev.text_glyphs(spark, sf_dir)))


@query(rf"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, concat_ws(',', CASE WHEN bool_or(contains(semantic, chr(65165))) THEN 'ARABIC' END, CASE WHEN bool_or(contains(semantic, chr(1488))) THEN 'HEBREW' END, CASE WHEN bool_or(regexp_matches(semantic, '\p{{Latin}}')) THEN 'LATIN' END) AS scripts FROM s GROUP BY ALL")
def scripts_by_page(spark, sf_dir):
    rows = ops.scripts(ops.with_semantics(ev.text_glyphs(spark, sf_dir)))
    return rows.select(*PAGE, F.array_join("scripts", ",").alias("scripts"))


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, {_RTL} AS rtl_count FROM s GROUP BY ALL HAVING {_RTL} > 0")
def rtl_pages(spark, sf_dir):
    rows = ops.with_semantics(ev.text_glyphs(spark, sf_dir))
    return rows.groupBy(*PAGE).agg(F.sum(text.count_of(F.col("semantic"), text.rtl())).alias("rtl_count")).filter("rtl_count > 0")


@query("SELECT ascii(ch) AS code_point, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text != '') GROUP BY ALL")
def codepoint_histogram(spark, sf_dir):
    rows = ev.table(spark, sf_dir, "documents").filter("text != ''").select(F.explode(F.split("text", "")).alias("ch"))
    return rows.groupBy("ch").agg(F.count("*").alias("n")).select(F.ascii("ch").alias("code_point"), "n")


@query(f"WITH {ev.TEXT_GLYPHS} SELECT file_id, page_number, frame, string_agg(semantic, '' ORDER BY glyph_no) AS semantic, count(*) AS glyphs FROM s WHERE active GROUP BY ALL")
def actual_text_semantic(spark, sf_dir):
    rows = ops.with_semantics(ev.text_glyphs(spark, sf_dir).drop("frame_first")).filter("active")
    by = rows.groupBy(*PAGE, F.col("actual_text_frame").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("glyph_no", "semantic"))).alias("x"))
    return by.select(*PAGE, "frame", F.array_join(F.transform("x", lambda x: x["semantic"]), "").alias("semantic"), F.size("x").cast("bigint").alias("glyphs"))


_FONT_KEYS = "name, subtype, coalesce(encoding, '') AS encoding, embedded, damaged, vertical, to_unicode_present, subset"


@query(f"WITH {ev.TEXT_GLYPHS}, {ev.FONT_TABLE} SELECT file_id, page_number, {_FONT_KEYS}, count(*) AS glyph_count, count(*) FILTER (missing) AS raw_unmapped_glyph_count FROM s JOIN f USING (font_obj) GROUP BY ALL")
def font_rollup(spark, sf_dir):
    fonts = ev.fonts(spark).withColumn("encoding", F.coalesce("encoding", F.lit("")))
    return ops.font_rollup(ops.with_semantics(ev.text_glyphs(spark, sf_dir)), F.broadcast(fonts), ["font_obj"])  # five fonts


@query("SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN 'ABCDEF+' WHEN p_partkey % 3 = 1 THEN 'ABCdEF+' ELSE '' END, p_name) AS font_name, p_partkey % 3 = 0 AS subset FROM part")
def subset_fonts(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "ABCDEF+").when(k % 3 == 1, "ABCdEF+").otherwise(""), F.col("p_name"))
    return ev.table(spark, sf_dir, "part").select("p_partkey", name.alias("font_name"), text.is_subset(name).alias("subset"))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '<implicit>' WHEN 1 THEN 'Identity-H' WHEN 2 THEN p_brand WHEN 3 THEN 'WinAnsiEncoding' WHEN 4 THEN '<other>' WHEN 5 THEN '<stream>' ELSE '<dictionary>' END AS label FROM part")
def font_encoding_label(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("none", "name", "stream", "dict", "other", "stream", "dict"))), (k % 7 + 1).cast("int"))
    named = F.when(k % 7 == 1, "Identity-H").when(k % 7 == 2, F.col("p_brand")).when(k % 7 == 3, "WinAnsiEncoding").when(k % 7 == 5, " ")
    return ev.table(spark, sf_dir, "part").select("p_partkey", ops.encoding_label(kind, named).alias("label"))


@query("SELECT file_id, page_number, font_name, code FROM (SELECT DISTINCT p_partkey % 7 AS file_id, (p_size % 5)::INT AS page_number, p_brand AS font_name, CASE p_partkey % 3 WHEN 0 THEN 'MALFORMED_TOUNICODE_CMAP' ELSE 'INVALID_TOUNICODE_CMAP' END AS code, p_partkey AS o FROM part WHERE p_partkey % 3 < 2)")
def tounicode_diagnostics(spark, sf_dir):
    k = F.col("p_partkey")
    fonts = ev.table(spark, sf_dir, "part").select((k % 7).alias("file_id"), (F.col("p_size") % 5).cast("int").alias("page_number"), k.alias("font_obj"), F.col("p_brand").alias("name"), F.when(k % 3 == 0, "MALFORMED_TOUNICODE_CMAP").when(k % 3 == 1, "INVALID_TOUNICODE_CMAP").alias("to_unicode_verdict"))
    return ops.diagnostics(fonts.unionByName(fonts)).drop("font_obj")


@query(r"SELECT doc_id, CASE WHEN trim(substring(regexp_replace(t, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), 1, 128)) = '' OR t IS NULL THEN '<unnamed>' ELSE substring(regexp_replace(t, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), 1, 128) END AS name FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 1 THEN '  ' || chr(10) || ' ' WHEN doc_id % 17 = 2 THEN '' ELSE text END AS t FROM documents)")
def bounded_font_name(spark, sf_dir):
    return ev.table(spark, sf_dir, "documents").select("doc_id", text.bounded_name(F.when(F.col("doc_id") % 17 == 1, "  \n ").when(F.col("doc_id") % 17 == 2, "").otherwise(F.col("text")), "<unnamed>").alias("name"))


@query(rf"WITH p AS (SELECT doc_id AS file_id, coalesce(text, '') AS text, unnest(range(1, 1 + greatest(1, ceil(length(coalesce(text, '')) / {ev.PAGE_CHARS}))::BIGINT))::INT AS page_number FROM documents), s AS (SELECT file_id, page_number, substring(text, (page_number - 1) * {ev.PAGE_CHARS} + 1, {ev.PAGE_CHARS}) AS t FROM p), c AS (SELECT *, regexp_replace(t, '[\s\x0B\x1C-\x1F\p{{Z}}]', '', 'g') AS a, regexp_replace(CASE WHEN file_id % 4 = 0 THEN reverse(t) ELSE t || '  ' END, '[\s\x0B\x1C-\x1F\p{{Z}}]', '', 'g') AS b FROM s) SELECT file_id, page_number, a != b AS diverges, length(a) AS stream_character_count, length(b) AS position_character_count FROM c")
def reading_order_divergence(spark, sf_dir):
    pages = ev.pages(spark, sf_dir)
    moved = F.when(F.col("file_id") % 4 == 0, F.reverse("text")).otherwise(F.concat("text", F.lit("  ")))
    return ops.reading_order(pages, pages.withColumn("text", moved))


@query(f"""WITH {ev.TEXT_GLYPHS}, r AS (SELECT file_id, page_number, glyph_no, x_dir, y_dir, unnest(list_filter([CASE WHEN NOT active AND missing THEN 'MISSING_UNICODE' END, CASE WHEN contains(semantic, chr(65533)) THEN 'REPLACEMENT_CHARACTERS' END, CASE WHEN font_size_pt < 3.0::FLOAT THEN 'TINY_TEXT' END], lambda x: x IS NOT NULL)) AS code FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_number, code ORDER BY glyph_no) AS n FROM r)
SELECT file_id, page_number, CASE code WHEN 'MISSING_UNICODE' THEN 1 WHEN 'REPLACEMENT_CHARACTERS' THEN 2 ELSE 3 END AS ordinal, code, n::INT AS n, x_dir AS x, y_dir - 10.0::DOUBLE AS y, 5.0::DOUBLE AS w, 10.0::DOUBLE AS h FROM n WHERE n <= 8""")
def finding_location_samples(spark, sf_dir):
    return ops.locations(_located(spark, sf_dir))


def _located(spark, sf_dir):
    rows = ops.with_semantics(ev.text_glyphs(spark, sf_dir, by_file=True))
    codes = F.array(F.when(~F.col("active") & F.col("missing"), "MISSING_UNICODE"), F.when(F.col("semantic").contains("�"), "REPLACEMENT_CHARACTERS"), F.when(ops.tiny(F.col("font_size_pt"), TINY), "TINY_TEXT"))
    return rows.select(*PAGE, "glyph_no", "x_dir", "y_dir", "w_dir", "h_dir", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


@query(f"""WITH {ev.TEXT_GLYPHS}, r AS (SELECT file_id, page_number, unnest(list_filter([CASE WHEN NOT active AND missing THEN 1 END, CASE WHEN contains(semantic, chr(65533)) THEN 2 END, CASE WHEN font_size_pt < 3.0::FLOAT THEN 3 END], lambda x: x IS NOT NULL)) AS code FROM s),
n AS (SELECT file_id, page_number, code, count(*) AS m FROM r GROUP BY ALL) SELECT file_id, page_number, sum(m)::BIGINT AS total, sum(m) > sum(least(m, 8)) AS truncated FROM n GROUP BY ALL""")
def finding_location_totals(spark, sf_dir):
    return ops.location_totals(_located(spark, sf_dir))
