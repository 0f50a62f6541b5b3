"""URL filters: host and path rules, and for urls that no rule fits a ratio of two character language models.

The models are variable-order Markov chains over a reduced alphabet of 32 symbols: counts of all grams of one to ORDER + 1
symbols, in urls that the rules accept and in those that they reject. A symbol's probability is that of its longest context,
smoothed by the next shorter one. A url's score is the difference of the two log-likelihoods divided by its length; the
threshold is calibrated on the urls with a rule's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import ascii_lower, written

#: Fixed values of the contract: (host, path prefix, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: 31 symbols; digits are one ('0'), and everything else is the last symbol ('~').
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-?"
ORDER = 3
#: Grams of at most 4 symbols of 5 bits, each with its length: the model can't have more rows, so it can be broadcast.
MOST_GRAMS = sum(32**n for n in range(1, ORDER + 2))
BINS = 4096


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host, then its path. Null where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def reduced(url: Column) -> Column:
    """The url over the model's alphabet."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), r"[^a-z0/.\-?]", "~")


def grams(df: DataFrame) -> DataFrame:
    """A row for each symbol of column s: id, gram (the symbol with up to ORDER symbols before it), with df's other columns."""
    at = F.explode(F.sequence(F.lit(1), F.length("s")))
    rows = df.filter("s != ''").select("*", at.alias("i"))
    first = F.greatest(F.lit(1), F.col("i") - ORDER)
    return rows.select(*[c for c in df.columns if c != "s"], F.substring("s", first, F.col("i") - first + 1).alias("gram"))


def model(urls: DataFrame, smoothing: float = 2.0) -> DataFrame:
    """Rows (gram, ratio): ln P(last symbol | the rest) among accepted urls less that among rejected ones, for each gram seen in either.

    urls: s, accepted (boolean). Interpolated over all orders: P_n = (count + smoothing * P_(n-1)) / (context's count + smoothing).
    """
    seen = grams(urls.select("s", "accepted")).groupBy("gram").agg(F.count_if("accepted").alias("a1"), F.count_if(~F.col("accepted")).alias("r1"))
    suffix = seen.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda i: F.substring("gram", i, F.length("gram")))).alias("gram"), "a1", "r1")
    counts = written(suffix.groupBy("gram").agg(F.sum("a1").alias("a"), F.sum("r1").alias("r")), "url-grams")
    contexts = counts.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
    both = counts.withColumn("context", F.expr("left(gram, length(gram) - 1)")).join(contexts, "context")
    known = both.select("gram", F.struct("a", "ca").alias("a"), F.struct("r", "cr").alias("r"))
    out = None
    lower = {c: F.lit(1 / 32) for c in "ar"}
    for n in range(1, ORDER + 2):
        level = known.filter(F.length("gram") == n)
        if out is not None:
            level = level.join(out.select(F.col("gram").alias("short"), F.col("pa").alias("la"), F.col("pr").alias("lr")), F.expr("right(gram, length(gram) - 1)") == F.col("short"))
            lower = {"a": F.col("la"), "r": F.col("lr")}
        p = {c: (F.col(f"{c}.{c}") + smoothing * lower[c]) / (F.col(f"{c}.c{c}") + smoothing) for c in "ar"}
        level = level.select("gram", p["a"].alias("pa"), p["r"].alias("pr"))
        made = level if n == 1 else made.unionByName(level)  # noqa: F821
        out = level
    return made.select("gram", (F.ln("pa") - F.ln("pr")).alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(id, score) of urls (id, s): the mean ratio of its symbols, each by its longest suffix gram in the model; 0 without symbols."""
    rows = grams(urls.select("id", "s"))
    table = F.broadcast(ratios)  # at most MOST_GRAMS rows
    for n in range(ORDER + 1, 0, -1):
        own = table.select(F.col("gram").alias(f"g{n}"), F.col("ratio").alias(f"r{n}")).filter(F.length(f"g{n}") == n)
        rows = rows.withColumn(f"g{n}", F.expr(f"right(gram, {n})")).join(F.broadcast(own), f"g{n}", "left")
    best = F.coalesce(*(F.col(f"r{n}") for n in range(ORDER + 1, 0, -1)), F.lit(0.0))
    by = rows.groupBy("id").agg((F.sum(F.floor(best * 1e6).cast("bigint")) / F.count("*") / 1e6).alias("score"))
    return urls.select("id").join(by, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold(judged: DataFrame) -> float:
    """The score, of BINS steps over [-4, 4], that best separates judged (score, accepted): most balanced accuracy, the middle of ties; 0 without both kinds."""
    bins = judged.groupBy(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + 4) / 8 * BINS))).cast("int").alias("bin"))
    rows = sorted((r["bin"], r["a"], r["r"]) for r in bins.agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect())  # BINS rows at most
    n_a, n_r = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not n_a or not n_r:
        return 0.0
    below_a = below_r = 0
    best, at = -1.0, []
    own = {b: (a, r) for b, a, r in rows}
    for b in range(BINS):
        good = (1 - below_a / n_a) + below_r / n_r
        if good > best + 1e-12:
            best, at = good, [b]
        elif good > best - 1e-12:
            at.append(b)
        a, r = own.get(b, (0, 0))
        below_a, below_r = below_a + a, below_r + r
    return at[len(at) // 2] / BINS * 8 - 4


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, score.

    A null url, or one without `://`, has empty host and path, fits no rule and is judged by its symbols (none: score 0). A
    url at or above the threshold is allowed. Repeated urls count each in training. Without urls of both kinds all are
    allowed. Rows with a null or repeated identifier are scored together. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    base = written(parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), reduced(F.col("url")).alias("s")), "urls")
    ratios = written(model(base.filter("by_rule is not null").select("s", (F.col("by_rule") == "allow").alias("accepted"))), "url-model")
    scored = written(scores(base, ratios).dropDuplicates(["id"]), "url-scores")
    judged = base.filter("by_rule is not null").join(scored, "id").select("score", (F.col("by_rule") == "allow").alias("accepted"))
    least = threshold(judged)
    out = base.join(scored, base["id"].eqNullSafe(scored["id"]), "left").drop(scored["id"])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.when(F.coalesce("score", F.lit(0.0)) >= least, "allow").otherwise("block")).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))
