"""The registered queries of this subpackage: each applies one operator to its whole table. ORACLE has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import chat, decontaminate, exact_dedup, jaccard, mixing, mixing_lm, quality, repeats, secrets, urls
from glyphlake.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), percent=90, words=3)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(rows.unionByName(more).withColumn("parts", chat.text_part(F.col("text"))))
    turns = chat.read_back(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = chat.masked_text(F.col("formatted"), F.col("mask"))
    return chats.select("conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(masked).cast("bigint").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), F.size("attachments").cast("bigint").alias("n_attachments"), "media_tokens")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(table(spark, sf_dir, "documents"), online=True)


#: The patterns of op3 in SQL's dialect, which finds the same matches; runs are the longest ones there as here.
_KINDS = [("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, "length(v) >= 6"), ("access", 1, "AKIA[A-Z0-9]{16,}", 0, "true"), ("hex", 2, "[0-9a-f]{24,}", 0, "true"), ("mixed", 3, "[A-Za-z0-9+/_-]{20,}", 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, owner, repo, '{k}' AS kind, {o} AS ord, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {g}) AS vs FROM d WHERE regexp_matches(t, '{p}')" for k, o, p, g, _ in _KINDS)
_GOOD = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, _, _, _, c in _KINDS) + " END"

ORACLE = {
    "op3_secret_scans": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents),
m AS ({_FOUND}), i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
x AS (SELECT doc_id, owner, repo, kind, ord, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS a, length(ms[i]) AS n, vs[i] AS v FROM i),
s AS (SELECT * FROM x WHERE {_GOOD}), w AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM s GROUP BY v),
k AS (SELECT s.*, ord < 3 AS base, kind || ':' || a || ':' || (a + n) AS said FROM s JOIN w USING (v) WHERE ord < 3 OR owners = 1 AND repos <= 2 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.ord < 3 AND b.a < s.a + s.n AND s.a < b.a + b.n)),
r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY a, ord) FILTER (base) AS b, string_agg(said, ',' ORDER BY a, ord) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)""",
    "op6_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g') AS er, regexp_replace(text, '(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g') AS et FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + 24)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS media_tokens
FROM e GROUP BY conv_id""",
    "op7_exact_dedup": r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most, sum(source_size) OVER ()::BIGINT AS budget FROM s),
o AS (SELECT *, sum(most) OVER (ORDER BY most / weight, source NULLS LAST)::BIGINT - most AS before, sum(weight) OVER () - sum(weight) OVER (ORDER BY most / weight, source NULLS LAST) + weight AS heavier FROM w),
l AS (SELECT max(CASE WHEN (budget - before) / heavier * weight <= most THEN (budget - before) / heavier END) AS level FROM o),
g AS (SELECT source, source_size, weight, budget, level, least(most::DOUBLE, weight * level) AS target FROM o, l),
c AS (SELECT d.*, g.source_size, g.weight, g.budget, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS cum FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT c.*, (e * source_size + cum) / weight AS finish FROM c, range(3) r(e) WHERE size > 0),
u AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY finish, source NULLS LAST, key ROWS UNBOUNDED PRECEDING) AS used FROM q),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM u WHERE used <= budget GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0) AS taken FROM c LEFT JOIN k USING (doc_id)""",
}

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_secret_scans, op4_url_filters, op5_jaccard_join, op6_chat_formatting, op7_exact_dedup, op8_mixing, op9_quality_classifier, op10_lm_scoring)}
