"""Operators on documents against brute force on a small fixture with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import bits, decontaminate, exact_dedup, jaccard, mixing, mixing_lm, quality, repeats, secrets
from glyphlake.llm.components import components
from glyphlake.llm.suffixes import suffix_array
from glyphlake.llm.words import BLOCK, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def low_words(text):
    return WORD.findall((text or "").encode().translate(LOW))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_word_hashes_are_equal_for_equal_words_only(texts):
    values = [*texts.values(), "x" * (BLOCK + 5) + " end", "é É"]
    hashes, counts = word_hashes(pa.array(values))
    expected = [w for t in values for w in low_words(t)]
    assert counts.tolist() == [len(low_words(t)) for t in values] and len(set(zip(hashes.tolist(), expected, strict=True))) == len(set(expected)) == len(set(hashes.tolist()))


def test_exact_dedup(docs, texts, nothing):
    norm = {i: (t or "").encode().translate(LOW) for i, t in texts.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = by_id(exact_dedup.exact_dedup(docs))
    for i, t in norm.items():
        assert got[i][1:] == (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t).hexdigest())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_checks_the_bytes_of_hits(spark, docs, texts):
    contents = spark.createDataFrame([(1, i, texts[i]) for i in (10, 20, 40)], "file bigint, row bigint, bytes string")
    false = spark.createDataFrame([(1, 40, (10, 1, 10), b"d"), (1, 20, (10, 1, 10), b"e")], "file bigint, row bigint, stays struct<id: bigint, file: bigint, row: bigint>, digest binary")
    assert [bytes(r[0]) for r in exact_dedup.mismatches(contents, false).collect()] == [b"e"]


def test_texts_of_one_digest_are_told_apart(spark, monkeypatch):
    """A digest that all texts share: groups are made by bytes."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (None, "b"), (2, "b")], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == {(1, 3, 2, False): 1, (3, 3, 2, True): 1, (None, 2, 3, False): 1, (2, 2, 3, True): 1, (2, 2, 3, False): 1}


def test_one_row_of_equal_texts_stays_whatever_identifiers_repeat(spark):
    df = spark.createDataFrame([(7, "a", 1), (7, "a", 2), (7, "b", 3), (None, "c", 4), (None, "C", 5), (8, None, 6), (9, "", 7)], "doc_id bigint, text string, file int")
    kept = exact_dedup.unique(df)
    assert kept.columns == df.columns and sorted((r["text"] or "").lower() for r in kept.collect()) == ["", "a", "b", "c"]
    assert {r["doc_id"] for r in kept.collect()} == {7, None, 9}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    schema = exact_dedup.ARRIVALS
    spark.createDataFrame([(1, b"a", 5, 0), (2, b"b", 5, 1)], schema).write.parquet(f"{tmp_path}/in")
    run = lambda: {bytes(r["digest"]): (r["stays"]["id"], r["n"]) for r in exact_dedup.stream_state(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/ck", f"{tmp_path}/out").collect()}
    assert run() == {b"a": (1, 1), b"b": (2, 1)}
    spark.createDataFrame([(5, b"a", 6, 0)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {b"a": (5, 2), b"b": (2, 1)}


def shingles(text, n):
    w = low_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_jaccard_join(docs, texts, nothing, percent, n):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0:
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(jaccard.join(docs, percent, n)).items()} == {i: (len(s), label[i]) for i, s in sets.items()}
    assert jaccard.join(nothing, percent, n).count() == 0


@pytest.mark.parametrize("percent", [90, 80, 50, 20])
@pytest.mark.parametrize("frequent", [1, 4])
def test_prefix_keys_lose_no_pair(percent, frequent, monkeypatch):
    """Sets of a few families whose tokens many have, so that prefixes hold rare tokens, frequent ones, and both."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = np.random.default_rng(percent)
    families = [rng.integers(-(2**63), 2**63 - 1, int(n)) for n in (3, 8, 20, 60, 150)]
    sets = []
    for _ in range(160):
        f = families[rng.integers(len(families))]
        keep = f[rng.random(len(f)) > rng.choice([0.0, 0.05, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, len(f) // 5 + 2)))])))
    count = Counter(int(t) for s in sets for t in s)
    keys, twos = [], 0
    for s in sets:
        c = np.array([count[int(t)] for t in s])
        order = np.lexsort((s, c))
        order = order[c[order] > 1]
        keys.append({int(k) for part in jaccard.combined(len(s), c[order], s[order], percent) for k in part})
        twos += sum(c[order] > frequent) > 1
    linked = 0
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= percent * (len(x) + len(sets[j]) - both) > 0 and len(x) + len(sets[j]) > 2 * both:
                linked += 1
                assert keys[i] & keys[j]
    assert linked > 50 and twos


def test_keys_of_twos():
    values = np.arange(200, dtype=np.uint64)
    got = {int(k) for part in jaccard.by_twos(values, values % np.uint64(10)) for k in part}
    assert len(got) == 10 * 20 * 19 // 2 and not list(jaccard.by_twos(values[:1], values[:1]))


def test_keys_grow_with_the_prefix_not_with_its_square():
    """A set all of whose tokens are frequent has a few keys for each token that it may have alone."""
    rng = np.random.default_rng(1)
    for n in (100, 1000, 10_000):
        tokens = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        keys = sum(len(k) for k in jaccard.combined(len(tokens), np.full(len(tokens), 1000), tokens, 80))
        assert keys < 6 * jaccard.prefix(n, 80) + 20


def test_pairs_of_a_family_grow_with_its_members(spark, monkeypatch):
    """Near copies of one text, many of them just below the similarity: every two of them meet at some key."""
    seen, write = [], jaccard.written

    def watched(df, what, *more):
        out = write(df, what, *more)
        if what == "jaccard-pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    rng, made = random.Random(12), []
    for size in (60, 240):
        seen.clear()
        line = [f"w{k}" for k in range(200)]
        texts = {}
        for i in range(size):
            words = list(line)
            for k in rng.sample(range(200), rng.choice([1, 2, 4, 4, 5, 5, 6])):
                words[k] = f"x{i}y{k}"
            texts[i] = " ".join(words)
        sets = {i: shingles(t, 5) for i, t in texts.items()}
        label = {i: i for i in sets}
        for i in sets:
            for j in range(i):
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = label[i], label[j]
                    label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
        got = by_id(jaccard.join(spark.createDataFrame([*texts.items()], "doc_id bigint, text string"), 80, 5))
        assert {i: r["component_id"] for i, r in got.items()} == label and len(set(label.values())) > size // 20
        made.append(sum(seen))
    assert 0 < made[1] < 8 * made[0]


@pytest.mark.parametrize("forests", [1, 3])
def test_forests_leave_no_pair_untried(forests):
    """Sets of a family at two keys; a part of the pairs is told not to link, and the rest comes in some round."""
    rng = np.random.default_rng(7)
    family = rng.integers(-(2**63), 2**63 - 1, 300)
    sets = [np.unique(np.append(family[rng.random(300) > 0.04], rng.integers(-(2**63), 2**63 - 1, 9))) for _ in range(40)]
    long = np.array([jaccard.parity(s, jaccard.LONG).tobytes() for s in sets])
    short = np.bitwise_xor.reduce(np.frombuffer(b"".join(jaccard.parity(s, jaccard.LONG).tobytes() for s in sets), np.uint64).reshape(len(long), jaccard.LONG // jaccard.FOLDED, -1), axis=1)
    assert (int(np.bitwise_count(short[0] ^ short[1]).sum()) - len(np.setxor1d(sets[0], sets[1]))) % 2 == 0
    ids, n = np.arange(40), np.array([len(s) for s in sets])
    rows = np.concatenate([ids, ids[10:30]])
    key = np.repeat(np.array([-5, 8]), [40, 20])
    tried, rounds = set(), 0
    while pairs := set(jaccard.spanning(key, rows, n[rows], rows, short[rows], tried, 80, forests)):
        assert len(pairs) <= forests * 39 + forests * 19 and not pairs & tried and all(a < b for a, b in pairs)
        tried, rounds = tried | pairs, rounds + 1
    allowed = {(a, b) for b in range(40) for a in range(b) if np.bitwise_count(short[a] ^ short[b]).sum() * 180 <= (n[a] + n[b]) * 20 and min(n[a], n[b]) * 100 >= 80 * max(n[a], n[b])}
    assert tried == allowed and len(allowed) > 100 and rounds > 1


def test_rows_of_a_key_stay_together():
    keys = [[1, 1, 2], [2, 2], [2, 3], [], [4, 4], [4], [5, 6, 7]]
    got = [t.column(0).to_pylist() for t in jaccard.whole_keys(pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], ["key"]) for k in keys)]
    assert sum(got, []) == sum(keys, []) and len({k for t in got for k in t}) == sum(len(set(t)) for t in got)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {i: i for i in range(400)}
    for a, b in links:
        x, y = label[a], label[b]
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), spark.range(400))
    assert {r["id"]: r["label"] for r in got.collect()} == label


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(rng.randrange(0, 40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats(docs, texts, nothing, monkeypatch):
    data = {i: (t or "").encode() for i, t in texts.items() if i != 62}
    seen = Counter(d[a : a + 400] for d in data.values() for a in range(len(d) - 399))
    got = by_id(repeats.repeats(docs.filter("doc_id != 62")))
    for i, d in data.items():
        cover = bytearray(len(d))
        for a in range(len(d) - 399):
            if seen[d[a : a + 400]] > 1:
                cover[a : a + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", cover))
        kept = bytes(x for x, c in zip(d, cover, strict=True) if not c)
        assert got[i][1:5] == (len(d), sum(cover), spans, hashlib.sha256(kept).hexdigest()), i
    assert sum(r["n_removed"] for r in got.values()) > 5000 and repeats.repeats(nothing).count() == 0


def test_a_text_of_many_blocks_repeats_itself(docs):
    row = repeats.repeats(docs.filter("doc_id = 62")).first()
    assert row[1:4] == (1_500_000, 1_500_000, 1)


def repeats_by_hand(rows):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each (id, text)."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[a : a + 400] for d in data for a in range(len(d) - 399))
    out = Counter()
    for (i, _), d in zip(rows, data, strict=True):
        cover = bytearray(len(d))
        for a in range(len(d) - 399):
            if seen[d[a : a + 400]] > 1:
                cover[a : a + 400] = b"\1" * 400
        kept = bytes(x for x, c in zip(d, cover, strict=True) if not c)
        out[i, len(d), sum(cover), len(re.findall(b"\1+", cover)), hashlib.sha256(kept).hexdigest()] += 1
    return out


def noise(rng, n):
    return "".join(chr(rng.randrange(97, 123)) for _ in range(n))


@pytest.mark.parametrize(("hot", "hottest"), [(256, 65_536), (4, 65_536), (4, 8)])
def test_passages_that_many_share_in_different_surroundings(spark, monkeypatch, hot, hottest):
    """Passages just below and above the length, in few and in many documents; null and repeated identifiers."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HOTTEST", hottest)
    rng = random.Random(9)
    below, above, middle = noise(rng, 398), noise(rng, 430), noise(rng, 300)
    sides = [noise(rng, 150) for _ in range(4)]
    rows = [(i, noise(rng, 60 + i) + below + noise(rng, 200)) for i in range(40)] + [(100 + i, noise(rng, 90) + above + noise(rng, 100)) for i in range(20)]
    rows += [(200 + i, sides[rng.randrange(4)] + middle + sides[rng.randrange(4)]) for i in range(30)] + [(None, "x" + above), (None, above + "y"), (7, below + "z"), (7, None), (None, ""), (8, noise(rng, 3) + below)]
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("file", F.lit("f")).repartition(3)).collect()
    assert Counter(tuple(r[:5]) for r in got) == repeats_by_hand(rows)


def test_no_task_gathers_a_hot_key():
    """Many segments that share all but their ends: over HOT of one key become windows, a few at a time."""
    rng = random.Random(10)
    shared = noise(rng, 398).encode()
    rows = [(5, 1, bytes([i % 256, i // 256]), 0, 0, bytes([97 + i % 26, 97 + i // 26 % 26]) + shared + b"ab") for i in range(2000)]
    batches = [repeats._batch(rows[a : a + 100], repeats.CUT) for a in range(0, 2000, 100)]
    out = list(repeats._sorted(iter(batches)))
    assert max(b.num_rows for b in out) <= (repeats.HOT + 1) * 3 and sum(b.num_rows for b in out) == 2000 * 3 and all(w.is_valid for b in out for w in b.column(3))


def test_decontamination(spark, docs, texts, nothing, monkeypatch):
    rng = random.Random(11)
    items = {100: " ".join(texts[15].split(" ")[5:30]), 101: "never seen words at all in any of these texts here", 102: "", 103: None, 104: texts[16].split(" ")[3]}
    w = texts[17].split(" ")[2:32]
    for k in (4, 11, 20):
        w[k] = "changed"
    del w[7]
    items[105] = " ".join(w).upper().replace(" ", ", ")
    w = texts[18].split(" ")[:20]
    for k in (0, 3, 7, 11, 15, 19):
        w[k] = "changed"
    items[106] = " ".join(w)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id bigint, text string, doc_id string")
    tokens = lambda t: re.findall("[^\x00-/:-`{-\x7f]+", (t or "").lower())
    expected = {}
    for i, t in items.items():
        m = tokens(t)
        for d, x in texts.items():
            if m and d != 62:
                row = [0] * (len(tokens(x)) + 1)
                for k, a in enumerate(m, 1):
                    new = [k]
                    for j, b in enumerate(tokens(x), 1):
                        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
                    row = new
                if min(row) <= int(len(m) * 0.2):
                    expected[d, i] = min(row)
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(docs, bench).collect()}
    assert got == expected and (15, 100) in got and got[17, 105] == 4 and (18, 106) not in got
    dirty = {d for d, _ in expected}
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.select("doc_id").collect()} == set(texts) - dirty
    unnamed = spark.createDataFrame([(None, items[100], "x")], bench.schema)
    assert {r["doc_id"] for r in decontaminate.clean(docs, unnamed).select("doc_id").collect()} == set(texts) - {d for d, i in expected if i == 100}
    monkeypatch.setattr(decontaminate, "BLOCK", 4)  # several blocks
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(docs, bench).collect()} == expected
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).select("doc_id").collect()} == set(texts) - dirty
    assert decontaminate.matches(nothing, bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert rng


def test_secrets(spark, nothing):
    live, shared = "sK9xQ2mZ7pL4vR8tY3wB", "aB3dE6gH9jK2mN5pQ8sT"
    rows = [(1, f"token = '{live}' and AKIA{'Q7' * 9} or {'0af' * 10}", "r1", "o1"), (2, "password:abc secret=token: abcdef API_KEY: é=x", "r1", "o1"), (3, None, None, None), (4, "", "r", "o"), (5, f"see {shared} there", "r2", "o1"), (6, f"\U0001f600 see {shared} there", "r2", "o2"), (7, f"mine {live[::-1]}", "r2", "o2"), (8, f"mine {live[::-1]}", "r2", "o2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("id", F.lit("clash")).withColumn("s", F.lit(1))
    kinds = {"assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}
    got = by_id(secrets.scan(df))
    for i, t, *_ in rows:
        base = sorted((m.start(), list(kinds).index(k), m.end(), k) for k, (p, g, n) in kinds.items() for m in p.finditer(t or "") if len(m.group(g)) >= n)
        assert [(s["start"], s["order"], s["end"], s["kind"]) for s in got[i]["base"]] == base
    assert [s["kind"] for s in got[7]["spans"]] == ["mixed"] == [s["kind"] for s in got[8]["spans"]] and not got[5]["spans"] and not got[6]["spans"]
    assert secrets.scan(nothing).count() == 0


def test_secrets_of_null_and_repeated_identifiers_and_of_repositories(spark):
    key, spread = "AKIA" + "Q7" * 9, "zY9xQ2mZ7pL4vR8tY3wB"
    rows = [(None, f"x {key}", "r1", "o1"), (1, f"y {key}", "r1", "o1"), (1, "none", "r1", "o1"), (1, f"y {key}", "r1", "o1"), *((10 + k, f"see {spread}", f"r{k}", "o9") for k in range(3)), (20, f"see {spread[::-1]}", "r1", "o9"), (21, f"see {spread[::-1]}", "r2", "o9")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    told = Counter((r["doc_id"], tuple(s["kind"] for s in r["spans"])) for r in got)
    assert told == {(None, ("access",)): 1, (1, ("access",)): 2, (1, ()): 1, (10, ()): 1, (11, ()): 1, (12, ()): 1, (20, ("mixed",)): 1, (21, ("mixed",)): 1}
    assert {(s["owners"], s["repos"]) for r in got for s in r["spans"] if s["kind"] == "mixed"} == {(1, 2)}


def test_mixing(docs, texts, nothing):
    rows, queue = mixing.mix(docs)
    rows, queue = rows.collect(), queue.collect()
    source = {i: None if i % 5 == 0 else f"s{i % 4}" for i in texts}
    size = {i: len(low_words(t)) for i, t in texts.items()}
    total, most = Counter(), Counter()
    for i, s in source.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * total[s], weight[s] * mid) for s in names) < sum(total.values()) else (lo, mid)
    assert {r["id"] for r in rows} == set(texts)
    for r in rows:
        s = source[r["id"]]
        most[s] += r["taken"]
        assert r["size"] == size[r["id"]] and r["source_size"] == total[s] and r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(min(3 * total[s], weight[s] * hi), rel=1e-6)
    assert sum(most.values()) <= sum(total.values()) and len(queue) == sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert {r["id"]: r["taken"] for r in mixing.mix(docs)[0].collect()} == {r["id"]: r["taken"] for r in rows}
    assert mixing.mix(nothing)[0].count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixing_of_null_and_repeated_identifiers(spark):
    """Every row comes out, none is taken more than three times, the budget is kept, and reruns agree."""
    rows = [(None, "one two three", "a"), (None, "one two three", "a"), (None, "four", None), (7, "x", "b"), (7, "y z y z y z y z", "b"), (7, "y z y z y z y z", "b"), (7, "y z y z y z y z", "c"), (8, None, "c"), (9, "", None)] + [(k, "w " * k, "abc"[k % 3]) for k in range(10, 60)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, size int").repartition(5)
    got = mixing.mix(df)[0].collect()
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert total - 60 * 3 < sum(r["taken"] for r in got) <= total
    told = lambda out: Counter((r["id"], r["source"], r["size"], r["taken"]) for r in out)
    assert told(mixing.mix(df.repartition(3))[0].collect()) == told(got)
    kept = mixing.mixed_documents(df).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in kept) == Counter({k: n for k, n in told(got).items() if k[3]})


def test_quality(spark, nothing):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "and", "river", "stone", "walked", "slowly", "home"]) for _ in range(rng.randrange(20, 200))) + "."
    rows = [(i, good() if i % 4 else good().upper().replace(" ", "!! "), "s", 5) for i in range(400)] + [(1000, None, "s", 5), (1001, "", "s", 5), (1002, "z" * 10**6, "s", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string, x int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(5, None, 0), (None, 1, 0), (7, 9, 0)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality.classify(df, labels))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and np.mean([got[i]["predicted"] == int(i % 4 > 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and len(got) == 403
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_isotonic_steps_ascend():
    x, y = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(y) > 0).all() and y.tolist() == pytest.approx([0, 0.5, 2 / 3])


def test_language_model(docs, texts, nothing):
    tokens = {i: [*low_words(t), b" "] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = by_id(mixing_lm.score(docs))
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(w in c for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0
    assert mixing_lm.score(nothing).count() == 0


def test_language_model_knows_which_word_follows(spark):
    """Words in an order or not: only their pairs tell the held-out documents apart."""
    ordered = [f"a{k}{k}b" for k in range(40)]
    mixed_up = random.Random(3).sample(ordered, 40)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, " ".join(ordered)) for i in range(60) if i not in held] + [(held[0], " ".join(ordered)), (held[1], " ".join(mixed_up))]
    got = by_id(mixing_lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"]) and got[held[0]]["score"] > got[held[1]]["score"] + 5


def flat(words):
    return np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)


@pytest.fixture(scope="module")
def letters():
    """A model of bits of some words, trained, and these words."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice(["an", "be", "cor", "ed", "\u00e9", "fu"]) for _ in range(rng.randrange(1, 5))).encode() for _ in range(300)}) + [b""]
    data, lens = flat(words)
    code = bits.Code(np.bincount(data, minlength=256) + len(lens) * (np.arange(256) == 32))
    model = bits.Model(code, bits.fitted(bits.counted(code, data, lens)))
    return model.after(model.learnt(data, lens)), words


def contexts(word):
    """(byte, contexts) of each byte of a word and the blank behind it."""
    line = word + b" "
    return [(b, [(k, line[max(0, i - k) : i]) for k in range(1, 5)] + [(9, line[:i])], i) for i, b in enumerate(line)]


def test_bits_against_a_plain_coder(letters):
    model, words = letters
    length, nodes, values = bits.tree(model.code.counts)
    count = Counter()
    for w in words:
        for b, ctx, _ in contexts(w):
            count.update((c, int(n), int(v)) for c in ctx for n, v in zip(nodes[b, : length[b]], values[b, : length[b]], strict=True))
    tried = [words[3], words[50], b"anbe", b"zz\xff", b"", b"q" * 40]
    for w, got in zip(tried, model.costs(*flat(tried)), strict=True):
        cost = 0.0
        for b, ctx, i in contexts(w):
            for n, v in zip(nodes[b, : length[b]].tolist(), values[b, : length[b]].tolist(), strict=True):
                pairs = [(count[c, n, 0], count[c, n, 1]) for c in ctx]
                gate = min(i, 3) * 4 + sum(sum(pairs[2]) > x for x in bits.SEEN_AT)
                weight = model.weights[gate]
                dot = float(weight[0] * bits.BIAS + sum(k * math.log((y + 0.4) / (x + 0.4)) for k, (x, y) in zip(weight[1:], pairs, strict=True)))
                dot = min(11.5, max(-11.5, dot))
                p = 1 / (1 + math.exp(-dot))
                seen, ones = model.refined[gate * bits.STEPS + int(dot + 12)]
                p = (1 - bits.REFINED) * p + bits.REFINED * (p * bits.CONFIDENCE + ones) / (bits.CONFIDENCE + seen)
                cost -= math.log2(p if v else 1 - p)
        assert got == pytest.approx(cost, rel=1e-2)  # unseen contexts may meet in a cell


@pytest.mark.parametrize("prefix", [b"", b"an", b"nothing so", b"\xc3"])
def test_next_bytes_are_a_distribution(letters, prefix):
    model, _ = letters
    b = bits.Bits.of(model.code, *flat([prefix + bytes([k]) for k in range(256)]))
    cost, before = model.coder()(b), int(model.code.length[list(prefix)].sum())
    assert sum(2.0 ** -cost[a + before : a + before + n].sum() for a, n in zip(b.first, model.code.length, strict=True)) == pytest.approx(1, abs=1e-4)


def test_training_words_pay_as_new_ones_while_weights_learn(letters):
    model, words = letters
    data, lens = flat(words)
    learnt = model.learnt(data, lens)
    assert learnt.size == model.learnt(*flat([])).size and np.abs(model.weights - bits.WEIGHTS).max() > 0 and model.refined.sum() > 0


def test_language_model_against_brute_force(spark):
    """Each token's four shares, their online weights, and the sum, in plain loops."""
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["red", "green", "Blue", "of", "the", f"x{i}"]) for _ in range(rng.randrange(0, 40))) for i in range(40)}
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").coalesce(1)  # one group
    got = by_id(mixing_lm.score(df))
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    line = {i: [*low_words(t), b""] for i, t in texts.items()}
    known = Counter(w for i, t in line.items() if not out[i] for w in t)
    pair = Counter(p for i, t in line.items() if not out[i] for p in zip([b"", *t[:-1]], t, strict=True))
    total = sum(known.values())
    data, lens = flat(sorted(known))
    rows = mixing_lm.coded(df, "doc_id", "text")
    model = mixing_lm.byte_model(rows)
    plain = bits.Code(np.bincount(data, minlength=256) + len(lens) * (np.arange(256) == 32))
    assert (model.counts == bits.fitted(bits.counted(plain, data, lens))).all()
    cost = dict(zip(sorted({w for t in line.values() for w in t}), model.costs(*flat(sorted({w for t in line.values() for w in t}))), strict=True))

    def kinds(i):
        t, own, both = line[i], Counter(), Counter()
        if not out[i]:
            own, both = Counter(t), Counter(zip([b"", *t[:-1]], t, strict=True))
        for k, w in enumerate(t):
            before = t[k - 1] if k else b""
            first = known[before] - own[before]
            p = [2.0 ** -cost[w], (known[w] - own[w]) / (total - sum(own.values())), (pair[before, w] - both[before, w]) / max(1, first), t[:k].count(w) / max(1, k)]
            yield p, [1, 1, first > 0, k > 0], min(first.bit_length(), mixing_lm.GATES - 1)

    start = [list(mixing_lm.FIRST) for _ in range(mixing_lm.GATES)]
    rounds = [list(r) for r in start]
    for _ in range(mixing_lm.ROUNDS):
        sums = [[0.0] * 4 for _ in start]
        for i in texts:
            for p, use, g in [] if out[i] else kinds(i):
                part = [a * b * c for a, b, c in zip(rounds[g], p, use, strict=True)]
                sums[g] = [a + b / sum(part) for a, b in zip(sums[g], part, strict=True)]
        rounds = [[(a + b) / (sum(x) + 1) for a, b in zip(x, y, strict=True)] for x, y in zip(sums, rounds, strict=True)]
    start = [[(a + b) / (sum(x) + 1) for a, b in zip(x, y, strict=True)] for x, y in zip(sums, start, strict=True)]
    for i in texts:
        logits, log, k, tokens = [[math.log(x) for x in r] for r in start], 0.0, 0, list(kinds(i))
        while k < len(tokens):
            size = max(1, min(mixing_lm.MOST, k // 8))
            change = []
            for p, use, g in tokens[k : k + size]:
                share = [math.exp(x) * u for x, u in zip(logits[g], use, strict=True)]
                share = [x / sum(share) for x in share]
                part = [a * b for a, b in zip(share, p, strict=True)]
                log += math.log10(sum(part))
                change += [(g, j, mixing_lm.RATE * (part[j] / sum(part) - share[j])) for j in range(4)]
            for g, j, d in change:
                logits[g][j] += d
            k += size
        assert got[i]["score"] == pytest.approx(log, rel=1e-5)


def learning(model, line):
    """Bits of each word of a document, whose weights and map learn from block to block of its words, in plain loops."""
    weights, refined, out, k = model.weights.astype(float).tolist(), model.refined.tolist(), [], 0
    while k < len(line):
        size, wrong, visits, seen = max(1, min(bits.MOST, k // 8)), defaultdict(float), Counter(), []
        for w in line[k : k + size]:
            b, cost = bits.Bits.of(model.code, *flat([w])), 0.0
            for i, v in enumerate(b.value.tolist()):
                n = [model.counts[c[i]].tolist() for c in b.cells]
                gate = int(b.place[i]) * bits.SEEN + sum(sum(n[2]) > x for x in bits.SEEN_AT)
                x = [bits.BIAS, *(math.log((one + 0.4) / (zero + 0.4)) for zero, one in n)]
                dot = min(11.5, max(-11.5, sum(a * b for a, b in zip(weights[gate], x, strict=True))))
                p, step = 1 / (1 + math.exp(-dot)), gate * bits.STEPS + int(dot + 12)
                q = (1 - bits.REFINED) * p + bits.REFINED * (p * bits.CONFIDENCE + refined[step][1]) / (bits.CONFIDENCE + refined[step][0])
                cost -= math.log2(q if v else 1 - q)
                visits[gate] += 1
                seen.append((step, v))
                for j, y in enumerate(x):
                    wrong[gate, j] += (v - p) * y
            out.append(cost)
        for (gate, j), d in wrong.items():
            weights[gate][j] += bits.ONLINE / (1 + visits[gate] / 128) * d
        for step, v in seen:
            refined[step] = [refined[step][0] + 1, refined[step][1] + v]
        k += size
    return out


@pytest.mark.parametrize("held", [0, 10**6])
def test_bits_learn_within_a_document(letters, monkeypatch, held):
    """Documents that go on together learn from their own words alone, as in plain loops; what isn't held expanded costs the same."""
    monkeypatch.setattr(bits, "HELD", held)
    monkeypatch.setattr(bits, "TOGETHER", 2)
    model, words = letters
    rng, words = random.Random(9), [*words[:-1], b"zz\xff", b"qqqq", b""]
    lines = [[rng.choice(words[:-1]) for _ in range(n)] + [b""] for n in (30, 0, 90, 1, 12)] + [[b"qqqq"] * 60 + [b""]]
    got = model.online(*flat(words), np.array([words.index(w) for t in lines for w in t]), np.array([len(t) for t in lines]))
    assert got == pytest.approx([c for t in lines for c in learning(model, t)], rel=1e-3, abs=1e-3)
    assert got[-2] < got[-61] - 10 and got[-61] == pytest.approx(model.costs(*flat([b"qqqq"]))[0], rel=1e-3)
    assert model.online(*flat(words), np.zeros(0, np.int64), np.zeros(0, np.int64)).size == 0


def test_rows_of_bits_hold_each_bit_once(letters):
    """A word's bits lie in whole rows in the order of Bits; what is left of its last row is idle: its own gate, no predictions."""
    model, words = letters
    data, lens = flat([*words, b"q" * 40])
    rows, b = bits.Expanded(model).of(data, lens), bits.Bits.of(model.code, data, lens)
    ends = np.append(b.first[1:], len(b.value))
    stretch = np.log((model.counts[:, 1] + np.float32(0.4)) / (model.counts[:, 0] + np.float32(0.4)))
    assert len(rows.kind) == rows.n.sum() and (rows.n == -(-(ends - b.first) // bits.LANES)).all()
    for w, (a, z) in enumerate(zip(b.first, ends, strict=True)):
        kind = rows.kind[rows.first[w] : rows.first[w] + rows.n[w]].ravel()
        x = rows.x[:, rows.first[w] : rows.first[w] + rows.n[w]].reshape(len(bits.CELLS), -1)
        assert (kind[: z - a] & 1 == b.value[a:z]).all() and (kind[: z - a] < 2 * bits.GATES).all() and (x[:, : z - a] == stretch[np.array([c[a:z] for c in b.cells])]).all()
        assert len(kind) - (z - a) == rows.idle[w] and (kind[z - a :] == 2 * bits.GATES).all() and not x[:, z - a :].any()


def test_the_query_mixes_bits_online(spark, tmp_path):
    """The query's scores are those of bits that learn within a document."""
    from glyphlake.llm.queries import op10_lm_scoring

    rng = random.Random(12)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    syllables = ["xo", "qa", "zy"]
    texts = {i: " ".join(rng.choice(["red", "green", "blue", "of", "the", f"x{i}"]) for _ in range(rng.randrange(0, 60))) for i in range(40) if i not in held}
    texts[held[0]], texts[held[1]] = " ".join("".join(rng.choice(syllables) for _ in range(6)) for _ in range(200)), None
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got, frozen = by_id(op10_lm_scoring(spark, str(tmp_path))), by_id(mixing_lm.score(df))
    row = mixing_lm.coded(df, "doc_id", "text").collect()[0].asDict()
    model, own, tokens = mixing_lm.byte_model(mixing_lm.coded(df, "doc_id", "text")), mixing_lm.Group(row), row["tokens"]
    words = [w.as_py() for w in own.strings()] + [b""]
    costs = np.array([c for a, n in zip(own.ends - own.counts, own.counts, strict=True) for c in learning(model, [words[k] for k in own.places[a : a + n]])])
    own, p, gate = mixing_lm.shares(row, costs, tokens)
    start = np.tile(np.array(mixing_lm.FIRST), (mixing_lm.GATES, 1))
    sums = mixing_lm.fitted(own, p, gate, start, tokens) + start
    for i, log in zip(row["ids"], mixing_lm.document_logs(own, p, costs, gate, sums / sums.sum(axis=1, keepdims=True), tokens), strict=True):
        assert got[i]["score"] == pytest.approx(log, rel=1e-3)
    assert got[held[0]]["score"] > frozen[held[0]]["score"] + 400
    assert all(got[i][:6] == frozen[i][:6] for i in texts)


def test_online_bits_on_awkward_texts(spark, docs, texts, nothing):
    """Null, empty and very long texts and words, no rows, and no training documents."""
    got, frozen = by_id(mixing_lm.score(docs, online=True)), by_id(mixing_lm.score(docs))
    assert got.keys() == texts.keys() and all(got[i][:6] == frozen[i][:6] and -math.inf < got[i]["score"] < 0 for i in texts)
    assert mixing_lm.score(nothing, online=True).count() == 0
    held = next(i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = mixing_lm.score(spark.createDataFrame([(held, "a word")], "doc_id bigint, text string"), online=True).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and -math.inf < r["score"] < 0


def test_random_text_pays_for_its_letters(spark):
    rng = random.Random(6)
    held = next(i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    plain = lambda: " ".join(rng.choice(["river", "stone", "walked", "slowly", "home", "and", "the"]) for _ in range(200))
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(1, 60))) for _ in range(300))
    rows = [(i, plain()) for i in range(300, 340)] + [(held, noise), (None, "walked home"), (301, "said twice")]
    got = mixing_lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1 and sum(r["doc_id"] == 301 for r in got) == 2
    assert next(r["bits_per_byte"] for r in got if r["doc_id"] == held) > 4 and max(r["bits_per_byte"] for r in got if r["doc_id"] not in (held, 301, None)) < 1


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_a_word_is_priced_once_in_a_worker(letters, most):
    """The same words come in group after group: what is held costs what it did, and isn't priced again."""
    model, words = letters
    keys = np.array([zlib.crc32(w) for w in words], np.uint64)
    memo, asked, coder = bits.Memo(most), [], model.coder()
    for part in ([5, 3, 9, 90], [9, 5, 77], list(range(100)), [77, 3, 12]):

        def price(missing):
            asked.append(int(missing.sum()))
            return model.costs(*flat([words[i] for i, m in zip(part, missing, strict=True) if m]), coder)

        got = memo.of(keys[part], price)
        assert got.tolist() == pytest.approx(model.costs(*flat([words[i] for i in part])), rel=1e-5) and len(memo.keys) <= most
    assert asked == {0: [4, 3, 100, 3], 1000: [4, 1, 95, 0]}.get(most, asked)
