import random

import pytest

TRICKY = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, label int, key string, tokens string, _bucket int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcde'[rng.randrange(5)]}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts by identifier: null, empty, blank, short and very long ones, copies, near copies, ties, repeated passages."""
    rng = random.Random(7)
    out = {1: None, 2: "", 3: " \n\t", 4: "one", 5: "One", 6: "two words", 7: "aaaa" * 300}
    for i in range(10, 40):
        out[i] = words(rng, rng.randrange(30, 300))
    out[40], out[41] = out[10], out[10].upper()
    for i in range(42, 52):  # near copies: one word of many is another
        w = out[11 + i % 3].split(" ")
        w[rng.randrange(len(w))] = f"new{i}"
        out[i] = " ".join(w)
    passage = words(rng, 90)
    for i in range(52, 60):
        out[i] = words(rng, 40) + " " + passage + " " + words(rng, 40)
    out[60] = passage + " " + passage + " é漢\U0001f600 " + passage
    out[61] = words(rng, 30_000, 10**6)
    out[62] = "x" * 1_500_000
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts, with more columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 4}", len(t or ""), "x", 1, "k", "t", 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, TRICKY).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], TRICKY)
