"""Queries of optional content, document surfaces, limits, invariants and batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import pages, text
from glyphlake.operators import batch, optional_content, rules, surfaces
from glyphlake.sources import evidence as ev

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _oc(spark, sf_dir):
    """Nations are groups; regions are memberships of their nations; each pair of regions is an expression; expression 99 is on a cycle."""
    nation, region = ev.table(spark, sf_dir, "nation"), ev.table(spark, sf_dir, "region")
    k, none = F.col("n_nationkey").cast("bigint"), F.lit(None).cast("string")
    state = lambda m: F.when(k % m == 0, "OFF").when(k % m == 1, "ON")
    groups = nation.select(F.lit(0).cast("bigint").alias("file_id"), k.alias("node"), F.lit("group").alias("kind"), none.alias("policy"), none.alias("op"), (k % 2 == 0).alias("enabled"), state(3).alias("view_state"), state(4).alias("print_state"), state(5).alias("export_state"))
    r = F.col("r_regionkey").cast("bigint")
    policy = F.element_at(F.array(*map(F.lit, ("AnyOn", "AllOn", "AnyOff", "AllOff"))), (r % 4 + 1).cast("int"))
    blank = [F.lit(None).cast("boolean").alias("enabled"), *(none.alias(f"{d}_state") for d in optional_content.DESTINATIONS)]
    members = region.select(F.lit(0).cast("bigint").alias("file_id"), (100 + r).alias("node"), F.lit("membership").alias("kind"), F.when(r < 4, policy).alias("policy"), none.alias("op"), *blank)
    op = F.element_at(F.array(*map(F.lit, ("And", "Or", "Not"))), (r % 3 + 1).cast("int"))
    exprs = region.select(F.lit(0).cast("bigint").alias("file_id"), (200 + r).alias("node"), F.lit("expr").alias("kind"), none.alias("policy"), op.alias("op"), *blank)
    nodes = groups.unionByName(members).unionByName(exprs)
    zero = F.lit(0).cast("bigint").alias("file_id")
    edges = nation.select(zero, (100 + F.col("n_regionkey").cast("bigint")).alias("parent"), k.cast("int").alias("ordinal"), k.alias("child"))
    edges = edges.unionByName(region.select(zero, (200 + r).alias("parent"), F.lit(0).alias("ordinal"), (100 + r).alias("child")))
    edges = edges.unionByName(region.filter("r_regionkey % 3 < 2").select(zero, (200 + r).alias("parent"), F.lit(1).alias("ordinal"), F.when(r == 4, 204).otherwise(100 + (r + 1) % 5).cast("bigint").alias("child")))
    return nodes, edges


_OC = """st AS (SELECT n_nationkey AS node, n_regionkey, d, CASE WHEN n_nationkey % m = 0 THEN true WHEN n_nationkey % m = 1 THEN false ELSE n_nationkey % 2 != 0 END AS hidden FROM nation, (VALUES ('view', 3), ('print', 4), ('export', 5)) v(d, m)),
mb AS (SELECT 100 + n_regionkey AS node, d, CASE n_regionkey WHEN 0 THEN bool_and(hidden) WHEN 1 THEN bool_or(hidden) WHEN 2 THEN NOT bool_or(hidden) WHEN 3 THEN NOT bool_and(hidden) ELSE bool_and(hidden) END AS hidden FROM st GROUP BY n_regionkey, d),
ex AS (SELECT 200 + a.node - 100 AS node, a.d, CASE (a.node - 100) % 3 WHEN 0 THEN a.hidden OR b.hidden WHEN 1 THEN a.hidden AND b.hidden ELSE NOT a.hidden END AS hidden FROM mb a JOIN mb b ON a.d = b.d AND b.node = 100 + (a.node - 99) % 5 WHERE a.node != 104
  UNION ALL SELECT 204, d, NULL FROM mb WHERE node = 104)"""


@query(f"WITH {_OC} SELECT node::BIGINT AS node, d AS destination, hidden FROM mb")
def oc_membership(spark, sf_dir):
    nodes, edges = _oc(spark, sf_dir)
    return optional_content.evaluate(nodes, edges).filter("node between 100 and 199").select("node", "destination", "hidden")


@query(f"WITH {_OC} SELECT node::BIGINT AS node, d AS destination, hidden FROM ex")
def oc_expression(spark, sf_dir):
    nodes, edges = _oc(spark, sf_dir)
    return optional_content.evaluate(nodes, edges).filter("node >= 200").select("node", "destination", "hidden")


@query(f"""WITH {_OC}, al AS (SELECT node, d, hidden FROM st UNION ALL SELECT * FROM mb UNION ALL SELECT * FROM ex),
r AS (SELECT c_nationkey AS page_number, c_custkey AS ref_no, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 < 3 THEN c_custkey % 25 WHEN c_custkey % 6 < 5 THEN 100 + c_custkey % 5 ELSE 200 + c_custkey % 5 END AS node FROM customer),
w AS (SELECT r.page_number, r.ref_no, r.node, max(CASE WHEN d = 'view' THEN hidden::INT END) AS v, max(CASE WHEN d = 'print' THEN hidden::INT END) AS p, max(CASE WHEN d = 'export' THEN hidden::INT END) AS e FROM r LEFT JOIN al USING (node) GROUP BY ALL)
SELECT page_number, count(node) AS reference_count, count(*) FILTER (node BETWEEN 100 AND 199) AS membership_reference_count, count(*) FILTER (v = 1) AS hidden_in_view_count, count(*) FILTER (p = 1) AS hidden_in_print_count, count(*) FILTER (e = 1) AS hidden_in_export_count,
  sum((v IS NULL)::INT + (p IS NULL)::INT + (e IS NULL)::INT)::BIGINT AS evaluation_failure_count, count(*) FILTER (node IS NULL) AS null_reference_count, sum((v IS NULL)::INT + (p IS NULL)::INT + (e IS NULL)::INT) = 0 AS complete FROM w GROUP BY page_number""")
def oc_reference_counts(spark, sf_dir):
    nodes, edges = _oc(spark, sf_dir)
    k = F.col("c_custkey")
    node = F.when(k % 6 == 0, None).when(k % 6 < 3, k % 25).when(k % 6 < 5, 100 + k % 5).otherwise(200 + k % 5)
    refs = ev.table(spark, sf_dir, "customer").select(F.lit(0).cast("bigint").alias("file_id"), F.col("c_nationkey").alias("page_number"), k.alias("ref_no"), node.cast("bigint").alias("node"))
    return optional_content.reference_counters(refs, nodes, optional_content.evaluate(nodes, edges)).drop("file_id")


_FORMS = f"{ev.FORM_TREE}, f AS (SELECT file_id::BIGINT AS file_id, count(*) FILTER (is_dict) AS fields, count(*) FILTER (is_dict AND field_type = 'Sig') AS signatures, count(*) FILTER (is_dict AND starts_with(node, 'c') AND length(node) % 2 = 1) AS bare, bool_and(is_dict) AND file_id != (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AS complete FROM t GROUP BY file_id)"


@query(f"WITH {_FORMS} SELECT file_id, fields AS acro_form_field_count, signatures AS signature_field_count, bare AS widget_without_appearance_count, complete FROM f")
def form_tree(spark, sf_dir):
    return surfaces.form_fields(ev.form_nodes(spark, sf_dir))


_NAMES = f"{ev.FORM_TREE}, e AS (SELECT file_id::BIGINT AS file_id, sum(length(node) // 2) FILTER (is_dict)::BIGINT AS embedded, bool_and(is_dict AND length(node) % 2 = 0) AND file_id != (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AS complete FROM t GROUP BY file_id)"


@query(f"WITH {_NAMES} SELECT file_id, embedded AS embedded_file_count, complete FROM e")
def name_tree(spark, sf_dir):
    return surfaces.embedded_files(ev.form_nodes(spark, sf_dir))


def _surfaces(spark, sf_dir):
    nodes = ev.form_nodes(spark, sf_dir)
    forms = surfaces.form_fields(nodes)
    af = surfaces.associated_files(ev.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("bigint").alias("file_id"), (F.col("s_suppkey") % 2 >= 0).alias("is_dict")))
    rows = forms.join(af.withColumnRenamed("complete", "af_complete"), "file_id", "left")
    return rows.select("file_id", "acro_form_field_count", "signature_field_count", "widget_without_appearance_count", F.coalesce("associated_file_reference_count", F.lit(0).cast("bigint")).alias("associated_file_reference_count"), (F.col("complete") & F.coalesce("af_complete", F.lit(True))).alias("complete"))


_SURFACES = f"WITH {_FORMS}, af AS (SELECT (s_nationkey % 5)::BIGINT AS file_id, count(*) AS n FROM supplier GROUP BY ALL), s AS (SELECT f.*, coalesce(n, 0) AS associated FROM f LEFT JOIN af USING (file_id))"


@query(f"{_SURFACES} SELECT file_id, fields AS acro_form_field_count, signatures AS signature_field_count, bare AS widget_without_appearance_count, associated AS associated_file_reference_count, complete FROM s")
def document_surfaces(spark, sf_dir):
    return _surfaces(spark, sf_dir)


@query(f"{_SURFACES} SELECT file_id, NOT complete OR fields > 400 OR associated > 1000 AS requires_profile FROM s")
def requires_profile(spark, sf_dir):
    s = _surfaces(spark, sf_dir)
    need = surfaces.requires_profile(F.col("complete"), F.col("acro_form_field_count") - 400, F.lit(False), F.lit(0), F.col("associated_file_reference_count") - 1000, F.lit(False))
    return s.select("file_id", need.alias("requires_profile"))


@query("""WITH c AS (SELECT doc_id AS file_id, count(*) AS n, length(text) AS chars FROM documents GROUP BY ALL)
SELECT file_id, CASE WHEN chars > 5000 THEN 'GLYPH_COUNT' WHEN chars * 2 > 6000 THEN 'SEMANTIC_CHARACTER_COUNT' WHEN file_id % 100 > 97 THEN 'FONT_COUNT' END AS limit_code,
 CASE WHEN chars > 5000 THEN 'PDF exceeds the configured glyph-count limit of 5000' WHEN chars * 2 > 6000 THEN 'PDF exceeds the configured semantic-character-count limit of 6000' WHEN file_id % 100 > 97 THEN 'PDF exceeds the configured font-count limit of 97' END AS message FROM c""")
def work_limits(spark, sf_dir):
    limits = {"GLYPH_COUNT": 5000, "SEMANTIC_CHARACTER_COUNT": 6000, "FONT_COUNT": 97}
    chars = F.char_length("text").cast("bigint")
    rows = ev.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), rules.limit_code({"GLYPH_COUNT": chars, "SEMANTIC_CHARACTER_COUNT": chars * 2, "FONT_COUNT": F.col("doc_id") % 100}, limits).alias("limit_code"))
    return rows.withColumn("message", rules.limit_message(F.col("limit_code"), limits))


@query("""WITH c AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 > o_orderkey % 5 THEN 'signatures_within_fields' END, CASE WHEN o_orderkey % 11 > o_orderkey % 13 THEN 'resolved_within_unmapped' END) AS violations FROM orders)
SELECT * FROM c WHERE violations != ''""")
def invariant_violations(spark, sf_dir):
    k = F.col("o_orderkey")
    checks = rules.invariants({"signatures": k % 7, "fields": k % 5, "resolved": k % 11, "unmapped": k % 13})
    bad = F.filter(F.array(*(F.when(~v, F.lit(n)) for n, v in checks.items())), lambda x: x.isNotNull())
    return ev.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(bad, ",").alias("violations")).filter("violations != ''")


@query(f"WITH d AS (SELECT doc_id AS file_id, unnest(range(1, 1 + greatest(1, ceil(length(coalesce(text, '')) / {ev.PAGE_CHARS}))::BIGINT))::INT AS page_number FROM documents) SELECT * FROM d WHERE page_number IN (1, 3, 4, 5, 7)")
def selected_pages(spark, sf_dir):
    chosen = spark.createDataFrame([(p,) for p in pages.resolve("7,3-5,1,4", 10)], "page_number int")
    return ev.pages(spark, sf_dir).select("file_id", "page_number").join(F.broadcast(chosen), "page_number", "left_semi").select("file_id", "page_number")  # at most a document's pages


@query(f"WITH {ev.CHANGED_FILES} SELECT ordinal, CASE WHEN size_bytes > 5000 THEN 'PDF exceeds the configured size limit of 5000 bytes' END AS error FROM c")
def size_gate(spark, sf_dir):
    return batch.size_gate(ev.changed_files(spark, sf_dir), 5000).select("ordinal", "error")


_CHANGED = f"WITH {ev.CHANGED_FILES}, k AS (SELECT filename, min(ordinal) AS ordinal, arg_min(status, ordinal) AS status FROM c WHERE status != 'removed' AND lower(filename) LIKE '%.pdf' GROUP BY ALL)"


@query(f"{_CHANGED.replace('GROUP BY ALL', 'GROUP BY filename')} SELECT ordinal, filename, status FROM k")
def changed_pdf_selection(spark, sf_dir):
    return batch.changed_pdfs(ev.changed_files(spark, sf_dir))


@query(f"WITH {ev.CHANGED_FILES} SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, CASE WHEN count(*) > 50 THEN 'FILE_COUNT' WHEN sum(size_bytes) > 524288000 THEN 'TOTAL_BYTES' END AS gate FROM c")
def workload_gate(spark, sf_dir):
    return batch.workload(ev.changed_files(spark, sf_dir), 50, 500 << 20)


def _run(spark, sf_dir):
    """Files of a batch: some failed, some need attention."""
    k = F.col("ordinal")
    return ev.changed_files(spark, sf_dir).select("ordinal", "filename", F.when(k % 11 == 0, F.concat(F.lit("cannot read 100% of\n"), "filename")).alias("error"), (k % 4 == 1).alias("attention"), (k % 5).alias("pages"))


_RUN = f"WITH {ev.CHANGED_FILES}, r AS (SELECT ordinal, filename, CASE WHEN ordinal % 11 = 0 THEN 'cannot read 100% of' || chr(10) || filename END AS error, ordinal % 4 = 1 AS attention, ordinal % 5 AS pages FROM c)"


@query(f"{_RUN} SELECT count(*) AS files_checked, count(*) FILTER (error IS NULL AND attention) AS files_with_findings, count(error) AS files_failed FROM r")
def batch_counts(spark, sf_dir):
    return batch.counters(_run(spark, sf_dir))


@query(f"{_RUN}, g AS (SELECT ordinal % 20 AS run, count(*) FILTER (error IS NULL AND attention) AS found, count(error) AS failed FROM r GROUP BY 1), p AS (SELECT *, CASE WHEN failed > 0 THEN 2 WHEN found > 0 AND run % 2 = 0 THEN 1 ELSE 0 END AS exit_code FROM g) SELECT run, found, failed, exit_code, CASE exit_code WHEN 0 THEN CASE WHEN found = 0 THEN 'passed' ELSE 'neutral' END WHEN 1 THEN 'findings' ELSE 'error' END AS conclusion FROM p")
def batch_conclusion(spark, sf_dir):
    by = _run(spark, sf_dir).groupBy((F.col("ordinal") % 20).alias("run")).agg(F.count_if(F.col("error").isNull() & F.col("attention")).alias("found"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    by = by.withColumn("exit_code", batch.exit_code(F.col("failed"), F.col("found"), F.col("run") % 2 == 0))
    return by.withColumn("conclusion", batch.conclusion(F.col("exit_code"), F.col("found")))


@query(f"""{_RUN}, l AS (SELECT ordinal, CASE WHEN error IS NOT NULL THEN '::error file=' || replace(replace(filename, ':', '%3A'), ',', '%2C') || ',title=PDF audit failed::' || replace(replace(error, '%', '%25'), chr(10), '%0A') ELSE '::warning file=' || replace(replace(filename, ':', '%3A'), ',', '%2C') || ',title=PDF text-layer finding::Page ' || pages || ': TINY_TEXT' END AS line FROM r WHERE error IS NOT NULL OR attention),
n AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS n, count(*) OVER () AS total FROM l)
SELECT n::BIGINT AS n, line FROM n WHERE n <= 20 UNION ALL SELECT 21, '::notice title=PDF audit annotations limited::' || (total - 20) || ' additional annotation(s) are available in the JSON report.' FROM n WHERE n = 1 AND total > 20""")
def annotation_lines(spark, sf_dir):
    from glyphlake.operators import reports

    rows = _run(spark, sf_dir).filter(F.col("error").isNotNull() | F.col("attention"))
    told = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.concat(F.lit("Page "), F.col("pages").cast("string"), F.lit(": TINY_TEXT")))
    rows = rows.select("ordinal", F.lit(1).alias("page_number"), F.col("filename").alias("path"), F.col("error").isNotNull().alias("failed"), told.alias("message"))
    return reports.annotation_lines(rows, 20)


def _html(column: str) -> str:
    for a, b in text.HTML_ESCAPES:
        column = f"replace({column}, " + {"\r": "chr(13)", "\n": "chr(10)", "'": "chr(39)"}.get(a, f"'{a}'") + f", '{b}')"
    return column


@query(f"{_RUN} SELECT ordinal, '| <code>' || {_html('filename')} || '</code> | ' || CASE WHEN error IS NOT NULL THEN 'Error | ' || {_html('error')} WHEN NOT attention THEN 'Passed | ' || (pages + 1) || ' page(s)' ELSE 'Needs attention | ' || pages || ' of ' || (pages + 1) || ' inspected page(s)' END || ' |' AS row FROM r")
def summary_rows(spark, sf_dir):
    from glyphlake.operators import reports

    return _run(spark, sf_dir).select("ordinal", reports.summary_row(F.col("filename"), F.col("error"), F.col("attention"), F.col("pages") + 1, F.col("pages"), F.col("pages") + 1).alias("row"))


@query("SELECT c_nationkey AS file_id, bool_and(c_custkey % 400 != 3) AS optional_content, bool_and(c_custkey % 400 != 3) AND c_nationkey % 2 = 0 AS complete_for_direct_routing FROM customer GROUP BY c_nationkey")
def completeness(spark, sf_dir):
    by = ev.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("file_id")).agg(F.bool_and(F.col("c_custkey") % 400 != 3).alias("optional_content"))
    return by.withColumn("complete_for_direct_routing", rules.direct_routing([F.col("optional_content"), F.col("file_id") % 2 == 0, *[F.lit(True)] * 5]))
