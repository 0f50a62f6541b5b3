"""Evidence tables over the driver's tables: deterministic projections with integer arithmetic, one function for each table.

They carry the semantics of the audit without any PDF: a document's text is cut in pages of PAGE_CHARS code points, line items
are images on the page of their order, orders are annotations, and so on. The same projections in SQL are beside them, for the
oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_CHARS = 1800
CROP_W, CROP_H = 612.0, 792.0

#: Characters put in place of some glyphs: (modulus, remainder, character).
INJECTED = [(251, 7, "\ufffd"), (263, 9, "\ue000"), (307, 11, "\u05d0"), (401, 13, "\u0301"), (503, 17, "\U0001f600"), (509, 19, "\u200d"), (521, 21, "\ufe0f"), (523, 22, "\u200f"), (541, 27, "\ufe8d"), (547, 29, "\u061b")]
ACTUAL_TEXT = "f\u00adi\u05d0"
FONTS = ["ABCDEF+Serif", "Sans", "", "XYZABC+Mono", "Hand"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    """(file_id, text): null texts are empty.

    A file's row groups decide how many tasks get rows of a scan. Where these are fewer than the cores, texts are dealt anew before
    they become glyph rows, which are many times larger. by_file: by file_id, so that no glyph is dealt again by its page.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    if by_file:
        return docs.repartition("file_id")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < 4 * cores else docs


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, page_number, text) without exploding to glyphs. A document without text has one page without glyphs."""
    docs = documents(spark, sf_dir)
    last = F.greatest(F.lit(1), F.ceil(F.char_length("text") / PAGE_CHARS).cast("int"))
    rows = docs.select("file_id", "text", F.explode(F.sequence(F.lit(1), last)).alias("page_number"))
    return rows.select("file_id", "page_number", F.substring("text", (F.col("page_number") - 1) * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"))


def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, page_number) of pages without glyphs: counters don't see them."""
    return table(spark, sf_dir, "documents").filter("coalesce(text, '') = ''").select(F.col("doc_id").alias("file_id"), F.lit(1).alias("page_number"))


def text_glyphs(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    docs = documents(spark, sf_dir, by_file).filter("text != ''").select("file_id", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    pos, file = F.col("pos"), F.col("file_id")
    raw = F.col("ch")
    for m, r, c in reversed(INJECTED):
        raw = F.when(pos % m == r, c).otherwise(raw)
    font = ((file * 7 + F.floor(pos / 300)) % 5).cast("int")
    return docs.select(
        "file_id", (1 + F.floor(pos / PAGE_CHARS)).cast("int").alias("page_number"), pos.cast("bigint").alias("glyph_no"), raw.alias("raw_unicode"), F.when(pos % 601 == 31, F.array(raw, F.when(pos % 2 == 0, "\ue000").otherwise("i"))).when(pos % 607 == 33, F.array().cast("array<string>")).alias("code_unicodes"),
        font.alias("font_obj"), (((pos * 7 + file) % 23) / 2 + 1).cast("float").alias("font_size_pt"), (pos % 97 == 3).alias("in_form"), ((pos * 31 + file) % 1009 == 0).alias("mapping_untrusted"),
        F.when(pos % 200 < 6, F.floor(pos / 200)).alias("actual_text_frame"), F.when(pos % 200 < 6, ACTUAL_TEXT).alias("actual_text"), (pos % 200 == 0).alias("frame_first"),
        (72.0 + (pos % 90) * 5).cast("double").alias("x_dir"), (72.0 + F.floor((pos % PAGE_CHARS) / 90) * 30).cast("double").alias("y_dir"), F.lit(5.0).alias("w_dir"), F.lit(10.0).alias("h_dir"),
    )


TEXT_GLYPHS = f"""d AS (SELECT doc_id AS file_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE text != ''),
g AS (SELECT file_id, (1 + pos // {PAGE_CHARS})::INT AS page_number, pos AS glyph_no, {"CASE " + " ".join(f"WHEN pos % {m} = {r} THEN chr({ord(c)})" for m, r, c in INJECTED) + " ELSE ch END"} AS raw_unicode,
  ((file_id * 7 + pos // 300) % 5)::INT AS font_obj, (((pos * 7 + file_id) % 23) / 2 + 1)::FLOAT AS font_size_pt, pos % 97 = 3 AS in_form, (pos * 31 + file_id) % 1009 = 0 AS mapping_untrusted,
  CASE WHEN pos % 200 < 6 THEN pos // 200 END AS frame, 72.0::DOUBLE + (pos % 90) * 5 AS x_dir, 72.0::DOUBLE + ((pos % {PAGE_CHARS}) // 90) * 30 AS y_dir FROM d),
s AS (SELECT *, frame IS NOT NULL AS active, mapping_untrusted OR (glyph_no % 601 = 31 AND glyph_no % 2 = 0) OR raw_unicode IN (chr(65533), chr(57344)) OR regexp_matches(raw_unicode, '[\\x00-\\x1F\\x7F-\\x{{9F}}]') AS missing,
  CASE WHEN frame IS NULL THEN raw_unicode WHEN glyph_no = min(glyph_no) OVER (PARTITION BY file_id, page_number, frame) THEN 'fi' || chr(1488) ELSE '' END AS semantic FROM g)"""


def fonts(spark: SparkSession) -> DataFrame:
    """The five fonts of the projection: a fixed small table."""
    rows = [(i, FONTS[i] or "<unnamed>", ["Type0", "TrueType", "Type1"][i % 3], ["Identity-H", "WinAnsiEncoding", None, "Identity-V", "other"][i], i % 2 == 0, i == 4, i == 3, i != 0, i in (0, 3)) for i in range(5)]
    return spark.createDataFrame(rows, "font_obj int, name string, subtype string, encoding string, embedded boolean, damaged boolean, vertical boolean, to_unicode_present boolean, subset boolean")


FONT_TABLE = """f(font_obj, name, subtype, encoding, embedded, damaged, vertical, to_unicode_present, subset) AS (VALUES
  (0, 'ABCDEF+Serif', 'Type0', 'Identity-H', true, false, false, false, true), (1, 'Sans', 'TrueType', 'WinAnsiEncoding', false, false, false, true, false), (2, '<unnamed>', 'Type1', NULL, true, false, false, true, false),
  (3, 'XYZABC+Mono', 'Type0', 'Identity-V', false, false, true, true, true), (4, 'Hand', 'TrueType', 'other', true, true, false, true, false))"""


def crop():
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(CROP_W).alias("w"), F.lit(CROP_H).alias("h"))


def paint_glyphs(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    docs = documents(spark, sf_dir, by_file).filter("text != ''").select("file_id", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    pos, file = F.col("pos"), F.col("file_id")
    return docs.select(
        "file_id", (1 + F.floor(pos / PAGE_CHARS)).cast("int").alias("page_number"), pos.cast("bigint").alias("glyph_no"), (pos % 11).cast("int").alias("code"), F.concat(F.lit("F"), (file % 3).cast("string")).alias("font_name"),
        ((pos * 37 + file) % 700 - 40).cast("double").alias("x"), ((pos * 91 + file * 3) % 900 - 50).cast("double").alias("y"), F.lit(1.0).alias("scale_x"), F.when(pos % 73 == 0, 0.01).otherwise(0.0).alias("shear_y"),
        (pos % 53 != 0).alias("fill"), (pos % 59 == 0).alias("stroke"), F.when(pos % 61 == 0, 0.0).otherwise(1.0).alias("fill_alpha"), F.when(pos % 67 == 0, 0.0).otherwise(1.0).alias("stroke_alpha"), (pos % 71 != 0).alias("in_clip"), (pos % 79 == 0).alias("vertical"), crop().alias("crop"),
    )


PAINT_GLYPHS = f"""d AS (SELECT doc_id AS file_id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE text != ''),
p AS (SELECT file_id, (1 + pos // {PAGE_CHARS})::INT AS page_number, pos, pos % 11 AS code, file_id % 3 AS font_name, ((pos * 37 + file_id) % 700 - 40) AS x, ((pos * 91 + file_id * 3) % 900 - 50) AS y,
  pos % 53 != 0 AS fill, pos % 59 = 0 AS stroke, pos % 61 != 0 AS fa, pos % 67 != 0 AS sa, pos % 71 != 0 AS in_clip FROM d),
v AS (SELECT *, NOT fill AND NOT stroke AS invisible, (fill OR stroke) AND (NOT fill OR NOT fa) AND (NOT stroke OR NOT sa) AS transparent, x < 0 OR x > 612 OR y < 0 OR y > 792 AS off_page FROM p),
w AS (SELECT *, NOT off_page AND NOT in_clip AS clipped FROM v)"""


#: Counters of a page that aren't the text's, as (name, SQL).
PAGE_EVIDENCE = [
    ("malformed", "CASE WHEN (file_id * 5 + page_number) % 29 = 3 THEN 1 ELSE 0 END"), ("invalid", "CASE WHEN (file_id * 3 + page_number) % 31 = 4 THEN 2 ELSE 0 END"), ("diverges", "(file_id + page_number * 7) % 37 = 5"),
    ("images", "(file_id + page_number) % 3"), ("paths", "(file_id * 7 + page_number) % 5"), ("union_share", "((file_id * 13 + page_number * 11) % 8) / 8.0D"), ("image_cells", "((file_id + page_number) % 3) * 20"), ("overlap_ratio", "((file_id * 3 + page_number) % 4) / 4.0D"),
    ("annotation_missing", "CASE WHEN (file_id * 11 + page_number) % 41 = 6 THEN 1 ELSE 0 END"), ("annotation_replacement", "CASE WHEN (file_id * 2 + page_number) % 43 = 7 THEN 1 ELSE 0 END"),
]


def with_page_evidence(pages: DataFrame) -> DataFrame:
    """Pages with the counters of PAGE_EVIDENCE."""
    return pages.select("*", *(F.expr(e).alias(k) for k, e in PAGE_EVIDENCE))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") * 53) % 612, (F.col("l_suppkey") * 37) % 792
    w, h = 40 + (F.col("l_partkey") * 29 + F.col("l_linenumber") * 17) % 560, 40 + (F.col("l_suppkey") * 61 + F.col("l_linenumber") * 23) % 740
    return t.select(F.lit(0).cast("bigint").alias("file_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").cast("bigint").alias("paint_no"), "l_partkey", *(v.cast("double").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x0 + w), ("y1", y0 + h))), crop().alias("crop"))


IMAGES = """i AS (SELECT 0::BIGINT AS file_id, l_orderkey AS page_number, l_linenumber::BIGINT AS paint_no, l_partkey, ((l_partkey * 53) % 612)::DOUBLE AS x0, ((l_suppkey * 37) % 792)::DOUBLE AS y0,
  least(612, (l_partkey * 53) % 612 + 40 + (l_partkey * 29 + l_linenumber * 17) % 560)::DOUBLE AS x1, least(792, (l_suppkey * 37) % 792 + 40 + (l_suppkey * 61 + l_linenumber * 23) % 740)::DOUBLE AS y1 FROM lineitem)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit(0).cast("bigint").alias("file_id"), F.col("o_custkey").alias("page_number"), k.alias("annot_no"), (F.col("o_orderpriority").startswith("1")).alias("is_widget"), (k % 13 == 0).alias("hidden"), (k % 17 == 0).alias("invisible"), (k % 19 == 0).alias("no_view"),
        ((k * 7) % 700).cast("double").alias("x"), ((k * 11) % 900).cast("double").alias("y"), (k % 50).cast("double").alias("w"), (k % 40).cast("double").alias("h"), F.when(k % 5 == 0, k % 7 == 0).alias("oc_hidden"), (k % 23 == 0).alias("oc_unknown"),
    )


ANNOTATIONS = """a AS (SELECT 0::BIGINT AS file_id, o_custkey AS page_number, o_orderkey AS k, starts_with(o_orderpriority, '1') AS is_widget,
  NOT (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0) OR o_orderkey % 23 = 0) AND o_orderkey % 50 > 0 AND o_orderkey % 40 > 0 AS shown,
  o_orderkey % 5 = 0 AS has_oc FROM orders)"""


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, filename, status, size_bytes) over the pages' paths: some repeat, some are PDFs."""
    k = F.col("page_id")
    name = F.concat(F.lit("docs/"), (k % 90).cast("string"), F.when(k % 4 == 0, ".PDF").when(k % 4 < 3, ".pdf").otherwise(".md"))
    return table(spark, sf_dir, "pages").select(k.cast("bigint").alias("ordinal"), name.alias("filename"), F.when(k % 7 == 0, "removed").when(k % 3 == 0, "added").otherwise("modified").alias("status"), F.octet_length("html").cast("bigint").alias("size_bytes"))


CHANGED_FILES = """c AS (SELECT page_id AS ordinal, 'docs/' || (page_id % 90)::VARCHAR || CASE WHEN page_id % 4 = 0 THEN '.PDF' WHEN page_id % 4 < 3 THEN '.pdf' ELSE '.md' END AS filename,
  CASE WHEN page_id % 7 = 0 THEN 'removed' WHEN page_id % 3 = 0 THEN 'added' ELSE 'modified' END AS status, strlen(html)::BIGINT AS size_bytes FROM pages)"""


def form_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form tree of regions, nations and customers in one file for each region; some customers aren't dictionaries, and one nation of each region is its own kid too."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("file_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("is_dict"), F.when(F.col("r_regionkey") % 2 == 0, "Sig").alias("field_type"))
    nation = table(spark, sf_dir, "nation")
    node = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    n = nation.select(F.col("n_regionkey").cast("bigint").alias("file_id"), node.alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(True).alias("is_dict"), F.when(F.col("n_nationkey") % 3 == 0, "Tx").alias("field_type"))
    cycle = nation.filter("n_nationkey = 7").select(F.col("n_regionkey").cast("bigint").alias("file_id"), node.alias("node"), node.alias("parent"), F.lit(True).alias("is_dict"), F.lit(None).cast("string").alias("field_type"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    c = c.select(F.col("n_regionkey").cast("bigint").alias("file_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), node.alias("parent"), (F.col("c_custkey") % 1000 != 999).alias("is_dict"), F.lit(None).cast("string").alias("field_type"))
    return r.unionByName(n).unionByName(cycle).unionByName(c).select("*", F.when(F.col("node").startswith("c"), "Widget").alias("subtype"), (F.length("node") % 2 == 0).alias("has_appearance"), F.length("node").alias("names_len"))


FORM_TREE = """n AS (SELECT n_regionkey AS file_id, 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 3 = 0 THEN 'Tx' WHEN n_regionkey % 2 = 0 THEN 'Sig' END AS field_type, n_nationkey FROM nation),
t AS (SELECT r_regionkey AS file_id, 'r' || r_regionkey AS node, CASE WHEN r_regionkey % 2 = 0 THEN 'Sig' END AS field_type, true AS is_dict FROM region
  UNION ALL SELECT file_id, node, field_type, true FROM n UNION ALL SELECT n.file_id, 'c' || c_custkey, n.field_type, c_custkey % 1000 != 999 FROM customer JOIN n ON c_nationkey = n_nationkey)"""
