"""The text pass: glyph rows to page counters, Unicode profiles, fonts, diagnostics and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions import numbers, text
from glyphlake.schema import LOCATION_SAMPLES, ORDINAL, PAGE


def with_semantics(glyphs: DataFrame) -> DataFrame:
    """Adds `semantic` (the text a glyph stands for), `missing` (no usable mapping) and `active` (under replacement text).

    Under replacement text the first glyph of a frame has all of it, without soft hyphens, and later ones are empty. Which is
    first, the source says (`frame_first`), for it has a frame's glyphs in order; without that, `first_in_frame` finds it.
    """
    if "frame_first" not in glyphs.columns:
        glyphs = first_in_frame(glyphs)
    active = F.col("actual_text").isNotNull()
    override = F.when(F.col("frame_first"), F.replace("actual_text", F.lit("­"), F.lit(""))).otherwise("")
    codes = F.col("code_unicodes")
    unmapped = F.when(codes.isNull() | (F.size(codes) == 0), ~text.usable(F.col("raw_unicode"))).otherwise(~text.all_usable(codes))
    return glyphs.withColumn("active", active).withColumn("semantic", F.when(active, override).otherwise(F.col("raw_unicode"))).withColumn("missing", F.col("mapping_untrusted") | unmapped)


def first_in_frame(glyphs: DataFrame) -> DataFrame:
    """Adds `frame_first`: whether a glyph is its frame's first. Only glyphs under replacement text are sorted."""
    under = glyphs.filter(F.col("actual_text").isNotNull())
    rank = F.row_number().over(W.partitionBy(*PAGE, "actual_text_frame").orderBy("glyph_no"))
    return under.withColumn("frame_first", rank == 1).unionByName(glyphs.filter(F.col("actual_text").isNull()).withColumn("frame_first", F.lit(False)))


def mapping_counters(glyphs: DataFrame) -> DataFrame:
    """Counts by page of mapped, unmapped, resolved and missing glyphs; of with_semantics."""
    return glyphs.groupBy(*PAGE).agg(
        F.count("*").alias("glyph_count"), F.count_if("in_form").alias("form_glyph_count"), F.count_if(~F.col("in_form")).alias("page_content_glyph_count"),
        F.count_if(~F.col("missing")).alias("mapped_count"), F.count_if("missing").alias("unmapped_count"),
        F.count_if(F.col("active") & F.col("missing")).alias("resolved_count"), F.count_if(~F.col("active") & F.col("missing")).alias("missing_count"),
        F.count_if("active").alias("actual_text_glyph_count"),
    )


def implicit(subtype: Column, to_unicode: Column, untrusted: Column) -> Column:
    """A composite font without an explicit map, whose mapping is trusted all the same."""
    return (subtype == "Type0") & ~to_unicode & ~untrusted


def tiny(size: Column, threshold: float) -> Column:
    """Compared as 32-bit floats; a threshold of 0 finds nothing."""
    return F.lit(threshold > 0) & (size < F.lit(threshold).cast("float"))


def character_counters(glyphs: DataFrame, column: str = "semantic") -> DataFrame:
    """The Unicode profile of each page, counted inside the texts: glyphs aren't exploded to code points."""
    c = F.col(column)
    total = lambda pattern, name: F.sum(text.count_of(c, pattern)).alias(name)
    return glyphs.groupBy(*PAGE).agg(
        F.sum(text.code_points(c)).alias("unicode_character_count"), total(r"\x{FFFD}", "replacement_character_count"), total(text.rtl(), "right_to_left_count"),
        total(text.COMBINING, "combining_mark_count"), total(text.NON_BMP, "non_bmp_count"), total(text.VARIATION, "variation_selector_count"), total(text.JOINER, "zero_width_joiner_count"), total(text.BIDI_CONTROL, "bidi_control_count"),
    )


def scripts(glyphs: DataFrame, column: str = "semantic") -> DataFrame:
    """The scripts of each page, sorted, without those that say nothing. A page's distinct characters are looked up, once each, in the JVM's tables."""
    chars = glyphs.select(*PAGE, F.explode(F.split(F.coalesce(column, F.lit("")), "")).alias("ch")).filter("ch != ''").distinct()
    script = F.call_function("reflect", F.lit("java.lang.Character$UnicodeScript"), F.lit("of"), F.ascii("ch"))
    named = chars.select(*PAGE, script.alias("script")).filter(~F.col("script").isin("COMMON", "INHERITED", "UNKNOWN"))
    by = named.groupBy(*PAGE).agg(F.array_sort(F.collect_set("script")).alias("scripts"))
    return glyphs.select(*PAGE).distinct().join(by, PAGE, "left").select(*PAGE, F.coalesce("scripts", F.array().cast("array<string>")).alias("scripts"))


def encoding_label(kind: Column, name: Column) -> Column:
    """The label of a font's encoding: kind is none, name, stream (name: its map's), dict (name: its base) or other."""
    out = F.when(kind == "none", "<implicit>")
    for k, fallback in (("name", "<unnamed>"), ("stream", "<stream>"), ("dict", "<dictionary>")):
        out = out.when(kind == k, text.bounded_name(name, fallback))
    return out.otherwise("<other>")


FONT_KEYS = ["name", "subtype", "encoding", "embedded", "damaged", "vertical", "to_unicode_present", "subset"]


def font_rollup(glyphs: DataFrame, fonts: DataFrame, on: list[str]) -> DataFrame:
    """One row per page and distinct font description, with its glyphs and unmapped glyphs. Glyphs are counted by font object;
    descriptions (fonts: FONT_KEYS by the columns `on`) come to the counts, and not to each glyph."""
    by = glyphs.groupBy(*PAGE, "font_obj").agg(F.count("*").alias("n"), F.count_if("missing").alias("m"))
    return by.join(fonts, on).groupBy(*PAGE, *FONT_KEYS).agg(F.sum("n").alias("glyph_count"), F.sum("m").alias("raw_unmapped_glyph_count"))


def fonts_by_page(fonts: DataFrame) -> DataFrame:
    """Fonts of a page as one array, by their eight keys in ascending order."""
    cols = [c for c in fonts.columns if c not in PAGE]
    return fonts.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("fonts"))


def diagnostics(fonts: DataFrame) -> DataFrame:
    """Fonts (file_id, page_number, font_obj, name, to_unicode_verdict) with a malformed or invalid map, once for each font object of a page."""
    bad = fonts.filter(F.col("to_unicode_verdict").isin("MALFORMED_TOUNICODE_CMAP", "INVALID_TOUNICODE_CMAP"))
    return bad.dropDuplicates([*PAGE, "font_obj"]).select(*PAGE, "font_obj", F.col("name").alias("font_name"), F.col("to_unicode_verdict").alias("code"))


def reading_order(stream: DataFrame, position: DataFrame) -> DataFrame:
    """Compares the texts (file_id, page_number, text) of both orders without blanks."""
    one = stream.select(*PAGE, text.canonical(F.coalesce("text", F.lit(""))).alias("a"))
    two = position.select(*PAGE, text.canonical(F.coalesce("text", F.lit(""))).alias("b"))
    both = one.join(two, PAGE, "full_outer").select(*PAGE, F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))
    return both.select(*PAGE, (F.col("a") != F.col("b")).alias("diverges"), text.code_points(F.col("a")).alias("stream_character_count"), text.code_points(F.col("b")).alias("position_character_count"))


def ordered_text(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """The texts of a page joined in an order."""
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(column, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"))


def locations(rows: DataFrame) -> DataFrame:
    """The first samples of each page and finding, of rows (file_id, page_number, code, glyph_no, x_dir, y_dir, w_dir, h_dir), with their box and the page's total."""
    by = W.partitionBy(*PAGE, "code").orderBy("glyph_no")
    ordinal = F.coalesce(*(F.when(F.col("code") == c, i) for c, i in ORDINAL.items()))
    w, h = F.abs("w_dir"), F.abs("h_dir")
    box = [numbers.rounded(F.col("x_dir")).alias("x"), numbers.rounded(F.col("y_dir") - h).alias("y"), numbers.rounded(w).alias("w"), numbers.rounded(h).alias("h")]
    first = rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= LOCATION_SAMPLES)
    return first.select(*PAGE, ordinal.alias("ordinal"), "code", F.col("n").cast("int").alias("n"), *box)


def location_totals(rows: DataFrame) -> DataFrame:
    by = rows.groupBy(*PAGE, "code").agg(F.count("*").alias("m")).groupBy(*PAGE)
    return by.agg(F.sum("m").alias("total"), (F.sum("m") > F.sum(F.least("m", F.lit(LOCATION_SAMPLES)))).alias("truncated"))
