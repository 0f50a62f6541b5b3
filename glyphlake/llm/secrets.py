"""Secret scans: spans of likely credentials, and how widely each value is owned over the whole corpus.

Candidates' digests are counted by distinct repositories and owners. A value that many owners share is a copied example; one
that a single owner holds looks live. Spans are found without a regular expression that reports positions: a text split at
the matches has the pieces between them, and lengths add up to offsets.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of, written

#: Kind -> (pattern, group that is the value, least length of the value), in listed order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": (ASSIGN, 1, 6), "access": (r"AKIA[A-Z0-9]{16,}", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: What a text must hold for a kind's pattern to match: found faster than the pattern.
MARKS = {"assign": [":", "="], "access": ["AKIA"], "hex": [], "mixed": []}
#: Further candidates, whose spans count only when few owners hold the value: long strings that mix digits and letters of both cases.
MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"


def spans_of(text: Column, kind: str, pattern: str, group: int, good) -> Column:
    """Array of (start, end, kind, value) of the pattern's leftmost non-overlapping matches whose value is good; code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, kind: string, value: string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(good(x["value"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    marks = [text.contains(m) for m in MARKS[kind]]
    return F.when(reduce(or_, marks, F.lit(not marks)) & text.rlike(pattern), F.aggregate(zipped, zero, step)["out"]).otherwise(zero["out"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> DataFrame:
    """One row per document: row (a number of its own), id, owner, repo, found (array of spans)."""
    text = text_of(text_col)
    found = [spans_of(text, kind, pattern, group, lambda v, least=least: F.length(v) >= least) for kind, (pattern, group, least) in KINDS.items()]
    found.append(spans_of(text, "mixed", MIXED, 0, lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat(owner, F.lit("/"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), F.concat(*found).alias("found"))


def ownership(spans: DataFrame, most_owners: int = 1, most_repos: int = 2) -> DataFrame:
    """Per value digest: n (rows), repos, owners, live: held by few owners, and in few of their repositories.

    Rows are first summed by (digest, owner, repo), so a value with any number of copies arrives as one row for each of its
    repositories.
    """
    by = spans.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    by = by.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    by = by.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count("*").alias("owners"))
    return by.withColumn("live", (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang", most_owners: int = 1, most_repos: int = 2) -> DataFrame:
    """One row per document: id, base and spans, arrays of (start, order, end, kind, value, owners, repos, live).

    A null or empty text has no spans. A null owner or repository is the one without a name; a repository is one of its owner.
    Copies of a document count as rows of one owner and repository each. `spans` holds every base span, and each mixed span that
    overlaps no base span and whose value is live: at most `most_owners` owners hold it, in at most `most_repos` repositories.
    A value that is in more is a copied example. Null and repeated identifiers are rows like any other. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = written(candidates(docs, id_col, text_col, owner_col, repo_col), "secret-spans")
    each = rows.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s")).withColumn("digest", F.xxhash64("s.value"))
    known = ownership(each, most_owners, most_repos).select("digest", "owners", "repos", "live")
    order = F.when(F.col("s.kind") == "assign", 0).when(F.col("s.kind") == "access", 1).when(F.col("s.kind") == "hex", 2).otherwise(3)
    one = each.join(known, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", order.alias("order"), "s.end", "s.kind", "s.value", "owners", "repos", "live"))).alias("all"))
    one = rows.select("row", "id").join(one, "row", "left").select("id", F.coalesce("all", F.array().cast(one.schema["all"].dataType)).alias("all"))
    one = one.withColumn("base", F.filter("all", lambda s: s["order"] < 3))
    added = lambda s: s["live"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return one.select(F.col("id").alias(id_col), "base", F.filter("all", lambda s: (s["order"] < 3) | added(s)).alias("spans"))
