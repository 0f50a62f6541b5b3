"""The quality classifier, the verdicts of urls and the whole pipeline against plain loops."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphlake.llm import decontaminate, quality, urls

LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return BLANKS.findall((text or "").encode().translate(LOW))


def statistics_by_hand(text):
    data = (text or "").encode()
    size, words = len(data), words_of(text)
    n = max(1, len(words))
    count = lambda of: sum(c in of for c in data)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    lines = data.split(b"\n")
    log = lambda of: math.log1p(10 * count(of) / n)
    pairs = list(zip(words, words[1:], strict=False))
    return [
        upper / max(1, upper + lower), count(range(48, 58)) / max(1, size), log(b"!?"), log(b"#$%&*+<=>@\\^_`~{}[]/"), log(b"|\t"), log(b".,;:"), log(b"\n\r"), count(range(128, 256)) / max(1, size),
        min(40, (size - count(b"\n\r") - count(b" ")) / n), len(set(words)) / n if words else 0, (len(set(pairs)) / len(pairs) if pairs else 1) if words else 0, math.log1p(len(words)), 1 - len(set(lines)) / len(lines) if words else 0, sum(len(x) < 20 for x in lines) / len(lines) if words else 0,
    ]


def scores_by_hand(texts, labels):
    """Scores of all texts by id, learnt from labels whose fold isn't 1."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    x = {i: statistics_by_hand(t) for i, t in texts.items()}
    known = [(i, y) for i, y in labels if y in (0, 1) and i in texts and fold(i) != 1]
    rows = np.array([x[i] for i, _ in known])
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(quality.SEED)
    omega = rng.normal(size=(rows.shape[1], quality.FEATURES)) / math.sqrt(rows.shape[1])
    shift = rng.uniform(0, 2 * math.pi, quality.FEATURES)

    def features(row):
        z = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(row, mean, scale, strict=True)]
        return np.array([math.cos(sum(a * b for a, b in zip(z, omega[:, k], strict=True)) + shift[k]) * math.sqrt(2 / quality.FEATURES) for k in range(quality.FEATURES)] + [1.0])

    fit, test = ([(features(x[i]), y) for i, y in known if fold(i) == k] for k in (0, 2))
    a = sum(np.outer(f, f) for f, _ in fit)
    b = sum(f * y for f, y in fit)
    w = np.linalg.solve(a + quality.RIDGE * max(1.0, a[-1, -1]) / quality.FEATURES * np.eye(len(a)), b)
    bins = {}
    for f, y in test:
        k = int(min(quality.BINS - 1, max(0, (f @ w + 0.5) / 2 * quality.BINS)))
        n, good = bins.get(k, (0, 0))
        bins[k] = (n + 1, good + y)
    pools = []
    for k in sorted(bins):
        pools.append([((k + 0.5) / quality.BINS * 2 - 0.5) * bins[k][0], *bins[k]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    at, value = [p[0] / p[1] for p in pools], [p[2] / p[1] for p in pools]
    return {i: min(1.0, max(0.0, float(np.interp(features(r) @ w, at, value)))) for i, r in x.items()}


def invented(rng, good):
    body = " ".join(rng.choice(["the", "and", "river", "stone", "walked", "slowly", "home", "é", "of"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(5, 60)))
    return body if good else rng.choice([body.upper() + "!!! $$$", "\n".join(["| menu |"] * 9) + body, "a1 " * 30 + body])


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(21)
    texts = {i: invented(rng, i % 3 > 0) for i in range(160)} | {500: None, 501: "", 502: " \n"}
    return texts, [(i, int((i % 3 > 0) != (i % 17 == 0))) for i in range(0, 160, 2)] + [(3, None), (5, 7), (900, 1)]


def test_quality_against_plain_loops(spark, labelled):
    texts, labels = labelled
    expected = scores_by_hand(texts, labels)
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    for i, s in expected.items():
        assert got[i]["score"] == pytest.approx(s, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_url_verdicts_against_plain_loops(spark):
    rng = random.Random(22)
    names = [f"http://{rng.choice(['shop', 'news', 'blog', 'x9'])}{k % 7}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['en', 'es', 'fr', 'buy-now', 'a'])}/{rng.choice(['page', 'win', 'cheap'])}{k}" for k in range(150)] + [None, "", "none"]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(names)), "page_id bigint, url string")).collect()}

    def rule(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2] if fit else None

    small = [re.sub(r"[^a-z0/.\-?]", "~", re.sub("[0-9]", "0", (u or "").lower())) for u in names]
    verdicts = [rule(u) for u in names]
    grams = {v: Counter(s[max(0, i - n) : i + 1] for s, w in zip(small, verdicts, strict=True) if w == v for i in range(len(s)) for n in range(urls.ORDER + 1) if i >= n) for v in ("allow", "block")}
    context = {v: Counter() for v in grams}
    for v in grams:
        for g, n in grams[v].items():
            context[v][g[:-1]] += n
    p = lambda g, v: 1 / 32 if not g else (grams[v][g] + 2 * p(g[1:], v)) / (context[v][g[:-1]] + 2)

    def score(s):
        total = 0
        for i in range(len(s)):
            best = next((g for n in range(urls.ORDER, -1, -1) if i >= n and ((g := s[i - n : i + 1]) in grams["allow"] or g in grams["block"])), None)
            total += math.floor((math.log(p(best, "allow")) - math.log(p(best, "block"))) * 1e6) if best else 0
        return total / len(s) / 1e6 if s else 0.0

    scores = [score(s) for s in small]
    place = lambda x: min(urls.BINS - 1, max(0, math.floor((x + 4) / 8 * urls.BINS)))
    good, bad = ([place(x) for x, w in zip(scores, verdicts, strict=True) if w == v] for v in ("allow", "block"))
    quality_of = [sum(x >= b for x in good) / len(good) + sum(x < b for x in bad) / len(bad) for b in range(urls.BINS)]
    best = [b for b in range(urls.BINS) if quality_of[b] > max(quality_of) - 1e-12]
    least = best[len(best) // 2] / urls.BINS * 8 - 4
    assert {"allow", "block", None} == set(verdicts)
    for k, (s, v) in enumerate(zip(scores, verdicts, strict=True)):
        assert got[k]["score"] == pytest.approx(s, abs=2e-6)
        if v or abs(s - least) > 1e-5:
            assert got[k]["verdict"] == (v or ("allow" if s >= least else "block"))


def similar(a, b, n=5):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for w in (words_of(a), words_of(b))]
    return 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) > 0


def holds(text, item):
    """Whether an item is in a text within its edits."""
    split = lambda t: re.findall("[^\x00-/:-`{-\x7f]+", (t or "").lower())
    m, row = split(item), [0] * (len(split(text)) + 1)
    for k, a in enumerate(m, 1):
        new = [k]
        for j, b in enumerate(split(text), 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return bool(m) and min(row) <= int(len(m) * decontaminate.ERRORS)


def test_the_pipeline_against_plain_loops(spark, tmp_path, labelled):
    """All five stages, each on what the one before kept, by the classifier, sets, edit distances and a queue in plain loops."""
    import corpus_pipeline

    rng = random.Random(23)
    texts, labels = labelled
    texts = {i: t for i, t in texts.items() if t}
    base = {i: t for i, t in texts.items() if i % 3 and len(words_of(t)) > 25}
    for k, (i, t) in enumerate(list(base.items())[:20]):
        w = t.split(" ")
        texts[200 + k] = t.upper().lower() if k % 2 else t  # exact copies
        w[rng.randrange(len(w))] = "other"
        texts[300 + k] = " ".join(w)
    items = [" ".join(base[i].split(" ")[3:20]) for i in list(base)[21:25]] + ["", None]
    source = {i: None if i % 11 == 0 else f"s{i % 4}" for i in texts}
    rows = [(i, t, "en", source[i], len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {i for i, s in scores_by_hand(texts, labels).items() if s >= 0.5}
    counts = [len(texts), len(kept)]
    last = {}
    for i in sorted(kept):
        last[(texts[i]).encode().translate(LOW)] = i
    kept = sorted(last.values())
    counts.append(len(kept))
    label = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if b < a and label[a] != label[b] and similar(texts[a], texts[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    kept = [i for i in kept if label[i] == i]
    counts.append(len(kept))
    kept = [i for i in kept if not any(holds(texts[i], t) for t in items)]
    counts.append(len(kept))
    import hashlib

    size = {i: len(words_of(texts[i])) for i in kept}
    total = Counter()
    for i in kept:
        total[source[i]] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    queue = []
    for s in names:
        own = sorted((i for i in kept if source[i] == s), key=lambda i: hashlib.md5(f"{i}:mix:{hashlib.md5(texts[i].encode()).hexdigest()}".encode()).hexdigest())
        done = 0
        for epoch in range(3):
            for n, i in enumerate(own):
                done += size[i]
                queue.append((done / weight[s], s is None, s or "", n + epoch * len(own), i))
    taken, used, budget = Counter(), 0, sum(size.values())
    for _, _, _, _, i in sorted(queue):
        used += size[i]
        if used > budget:
            break
        taken[i] += size[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == 5
    assert {r["doc_id"]: r["taken"] for r in got} == {i: n for i, n in taken.items() if n} and len(got) == sum(n > 0 for n in taken.values())
