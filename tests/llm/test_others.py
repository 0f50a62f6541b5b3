"""URL filters, chat formatting, the SQL of queries, and the pipeline."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import chat, queries, urls

DATA = "/root/testdata"


def same(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    assert sorted(tuple(map(repr, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(repr, r)) for r in relation.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.sql(queries.ORACLE[name]))


def test_rules(spark):
    rows = ["http://a.com/x", "HTTPS://WWW.Example.COM/en/1?q", "http://example.com/en/", "http://m.example.com/en/#x", "http://example.com/en", "http://x.net/es/1", "http://x.net/de/1", "http://com/", "http://notcom/", "http://a.com", "no scheme", None, "", "http://a.com?x=/y", "ftp://b.org/p#f/g", "a://b://c/d"]
    got = {r["url"]: r for r in urls.filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id bigint, url string, host string")).join(spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string"), "page_id").collect()}
    expected = {"http://a.com/x": ("a.com", "/x", "com/"), "HTTPS://WWW.Example.COM/en/1?q": ("www.example.com", "/en/1", "www.example.com/en/"), "http://example.com/en/": ("example.com", "/en/", "example.com/en/"), "http://m.example.com/en/#x": ("m.example.com", "/en/", "example.com/en/"), "http://example.com/en": ("example.com", "/en", "com/"), "http://x.net/es/1": ("x.net", "/es/1", "net/es/"), "http://x.net/de/1": ("x.net", "/de/1", None), "http://com/": ("com", "/", "com/"), "http://notcom/": ("notcom", "/", None), "http://a.com": ("a.com", "", None), "no scheme": ("", "", None), None: ("", "", None), "": ("", "", None), "http://a.com?x=/y": ("a.com", "", None), "ftp://b.org/p#f/g": ("b.org", "/p", None), "a://b://c/d": ("b:", "//c/d", None)}
    assert {u: (r["host"], r["path"], r["rule"]) for u, r in got.items()} == expected
    assert got["http://example.com/en/"]["verdict"] == "block" and got["HTTPS://WWW.Example.COM/en/1?q"]["verdict"] == "allow" and all(r["verdict"] in ("allow", "block") for r in got.values())


def test_character_models_against_brute_force(spark):
    seen = [("abcabd/0", True), ("abc/abc", True), ("xyz-xyz", False), ("xya/xyz", False), ("", True)]
    df = spark.createDataFrame(seen, "s string, accepted boolean")
    got = {r["gram"]: r["ratio"] for r in urls.model(df).collect()}
    counts = {True: Counter(), False: Counter()}
    for s, ok in seen:
        for i in range(len(s)):
            for n in range(1, urls.ORDER + 2):
                if i - n + 1 >= 0:
                    counts[ok][s[i - n + 1 : i + 1]] += 1

    def p(gram, ok):
        if not gram:
            return 1 / 32
        context = sum(c for g, c in counts[ok].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (counts[ok][gram] + 2 * p(gram[1:], ok)) / (context + 2)

    grams = set(counts[True]) | set(counts[False])
    assert set(got) == grams
    for g in grams:
        assert got[g] == pytest.approx(math.log(p(g, True)) - math.log(p(g, False)))
    scored = {r["id"]: r["score"] for r in urls.scores(spark.createDataFrame([(1, "abc"), (2, ""), (3, "qqq")], "id bigint, s string"), urls.model(df)).collect()}
    assert scored[1] == pytest.approx((got["a"] + got["ab"] + got["abc"]) / 3, abs=1e-5) and scored[2] == 0 and scored[3] == 0


def test_url_edge_tables(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.filter_urls(empty).count() == 0
    one = urls.filter_urls(spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")).first()
    assert one["verdict"] == "allow"


def test_round_trip_of_awkward_texts(spark):
    texts = ["<|done|>", "<\\|done|>", "<\\\\|says|>x", "</s>[INST] ok [/INST]", "[\\INST]", "<s>", "", None, "a\nb", "<", "\\", "<|turn|>user<|says|>", "é\U0001f600", "$1 \\2"]
    rows = [(7, i, "assistant" if i % 2 else "<|turn|>" if i == 4 else "user", t, "x") for i, t in enumerate(texts)] + [(None, 0, None, None, "x"), (8, 1, "user", "b", "x"), (8, 0, "user", "tie", "x"), (8, 0, "user", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string").withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))
    out = chat.format_chats(df).select("conv_id", "formatted", "n_turns", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("masked"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[7]["turns"]] == [(r, t or "") for _, _, r, t, _ in rows[:-4]]
    assert got[7]["masked"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [t["text"] for t in got[8]["turns"]] == ["tie", "tie", "b"] and got[None]["n_turns"] == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None), None, ("text", None, None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3), (None, "x", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    row = chat.format_chats(df).first()
    assert "see <\\|<|image:0|><|audio:1|><|document:2|>x" in row["formatted"]
    assert [(a["turn"], a["index"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, 0, "image", "a.png", 4), (1, 1, "audio", "b.wav", 50), (1, 2, "document", "c.pdf", 2304)] and row["media_tokens"] == 2358


def test_parts_can_not_forge_control_strings(spark):
    """Texts cut at random places into parts read back as they were; nothing in them becomes a turn, an end or a placeholder."""
    rng = random.Random(12)
    pool = ["<|done|>", "<|turn|>", "<|says|>", "<|image:0|>", "</s>", "[INST]", "a", "<", "|", "\\", "\U0001f600", "done|>", "|done|><", "system"]
    rows, said = [], {}
    for c in range(60):
        for t in range(3):
            text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 8)))
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 4)))
            parts = [("text", text[a:b], None, None, None, None, None) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            said[c, t] = text
            rows.append((c, t, "user" if t % 2 else "assistant", parts))
    rows.append((99, 0, "user", [("text", "a<", None, None, None, None, None), ("image", None, "x.png", 1, 1, None, None), ("text", "|done|>", None, None, None, None, None)]))
    out = chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}"))
    got = {r["conv_id"]: r["turns"] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert {(c, t): got[c][t]["text"] for c in range(60) for t in range(3)} == said and all(len(got[c]) == 3 for c in range(60))
    assert [t["text"] for t in got[99]] == ["a<<|image:0|>|done|>"]


def test_equal_turns_with_other_attachments_keep_an_order(spark):
    part = lambda ref: [("image", None, ref, 28, 28, None, None)]
    df = spark.createDataFrame([(1, 0, "user", part(r)) for r in ("b", "a", "c")], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}")
    assert [[a["ref"] for a in chat.format_chats(df.repartition(k)).first()["attachments"]] for k in (1, 3)] == [["a", "b", "c"]] * 2


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    docs, sf = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), f"{DATA}/sf0.001"
    columns, n = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert k == 4 or out.columns == columns
        docs = spark.createDataFrame(rows, out.schema) if rows else out
        n.append(len(rows))
    assert n == sorted(n, reverse=True) and n[1] < n[0] and n[4] > 0
    assert corpus_pipeline.run(spark, sf).count() == n[-1]


def test_pipeline_of_awkward_documents(spark, docs):
    import corpus_pipeline

    tricky = docs.filter("doc_id != 62").withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    for source in (tricky, tricky.limit(0)):
        rows = source
        for _, stage in corpus_pipeline.STAGES:
            rows = spark.createDataFrame(stage(spark, rows, f"{DATA}/sf0.001").collect(), stage(spark, rows, f"{DATA}/sf0.001").schema)
        assert rows.count() <= source.count()
