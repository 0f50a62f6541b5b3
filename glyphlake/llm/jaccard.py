"""N-gram Jaccard join: token-combination prefixes.

A document's set has the hashes of its distinct word shingles. Sets that are equal are one class, and classes are joined:

* Two sets with similarity >= t share at least l of their p + l - 1 smallest hashes (p = |x| - ceil(t|x|) + 1). A class of which
  fewer than l of these occur in another class has no partner and is left out. This needs counts of tokens only.
* Of the rest, all tokens are counted, and each set is ordered by count, rarest first. Sizes are dealt into classes, and a set
  meets its partners in the room of the larger one's class. A set may have p - 1 tokens alone there. Tokens that more than FREQUENT
  classes have are frequent, and are dealt by hash into token classes, as many as p. A set's prefix has p tokens that
  aren't frequent; if there aren't so many, it is extended by frequent ones, until those that are not the first of their token
  class make up what is missing. Rare tokens of the prefix are keys by themselves, frequent ones by every two of a token class.
  Were no key of two sets the same, the shorter prefix would share no rare token and at most one of each token class, so p of its
  tokens or more would differ: no link is lost. Keys are a few times p, however frequent the tokens are. Tokens that one class
  alone has fill the prefix but are no keys; a set whose prefix they fill has no partner.
* A set's parity sketch has SKETCH bits, each the parity of its tokens of one hash value. Each token in which two sets differ
  flips one bit, so pairs whose sketches differ in more bits than partners may differ in tokens are no candidates. Pairs that
  are left compare sketches of LONG bits before whole sets.
* Each class is verified against the first class of its keys, which links nearly all that link at all; components are
  labelled. Labels that still meet at a key are verified by one pair a key, round by round. Then all that meet at a key and have
  different labels are held against each other by sketches of FOLDED bits where they lie, and of the pairs that these allow a key
  gives a spanning forest over its labels, in the next round four, then sixteen, less the pairs tried before, until no key has a
  pair left: so pairs grow with the members of a key, and not with their square, and none that may link stays untried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import count
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, written
from glyphlake.llm.components import components
from glyphlake.llm.words import bounded_batches, mixed, word_hashes

#: A token that more classes have is frequent; one token class for so many tokens that a set may have alone (more classes make fewer keys of a longer prefix).
FREQUENT, ALONE = 16, 1
#: Keys that a task holds at a time.
KEYS = 1 << 17
#: Bits of a parity sketch, as columns of 64.
SKETCH = 256
PARITY = [f"s{i}" for i in range(SKETCH // 64)]
#: Bits of the sketch that is compared before whole sets are fetched.
LONG = 8192
#: Bits that it is folded to where all members of a key are compared.
FOLDED = 2048
#: So many pairs of identifiers at most are broadcast.
FEW = 1000
#: Rounds of one pair for each label and key before forests of all that are left; how many times the forests of a round the next has.
ROUNDS, MORE = 2, 4


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes (int64) of its distinct shingles; of fewer words, that of the whole sequence; of none, none."""
    hashes, counts = word_hashes(texts)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        joined = mixed(joined + hashes[k : k + len(joined)] + np.uint64(k + 1))
    at = 0
    for n in counts:
        if n >= words:
            yield np.unique(joined[at : at + n - words + 1].view(np.int64))
        elif n:
            h = np.zeros(1, np.uint64)
            for k in range(n):
                h = mixed(h + hashes[at + k] + np.uint64(k + 1))
            yield (mixed(h + np.uint64(n))).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
        at += n


def least_shared(n: int, percent: int) -> int:
    """The least number of tokens that a set of n shares with any set that is as similar."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int) -> int:
    return n - least_shared(n, percent) + 1


def counted(n: int, percent: int) -> int:
    """l of the count filter: half the prefix of a set."""
    return (prefix(n, percent) + 1) // 2


def size_class(n: int, percent: int) -> tuple[int, int]:
    """(number, largest size) of the class of sets with n tokens; partners are of one class or of neighbours."""
    number, first = 0, 1
    while (after := 100 * first // percent + 1) <= n:
        number, first = number + 1, after
    return number, after - 1


def alone(n: int, other: int, percent: int) -> int:
    """One more than the tokens of a set of n that a partner of `other` tokens or more can lack."""
    return n - -(-percent * (n + other) // (100 + percent)) + 1


@cache
def size_class_first(number: int, percent: int) -> int:
    """The least size of a class."""
    return 1 if number <= 0 else 100 * size_class_first(number - 1, percent) // percent + 1


def token_classes(number: int, percent: int) -> int:
    """How many classes frequent tokens have in the room of a size class; 0 where none is frequent, for partners may share one token
    only. Partners share more tokens than there are classes."""
    largest, shared = size_class_first(number + 1, percent) - 1, least_shared(size_class_first(number - 1, percent), percent)
    return max(1, min(prefix(largest, percent) // ALONE, shared - 1)) if shared > 1 else 0


def _sets(batches: Iterator[pa.RecordBatch], words: int, percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n, digest, tokens = b.column(0), [], [], []
        for s in shingle_sets(b.column(1), words):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            # The partner may be larger or smaller: l of the smallest partner holds for both.
            tokens.append(s.tobytes() if whole else s[: prefix(len(s), percent) + counted(len(s), percent) - 1].tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.binary())], ["id", "n", "digest", "tokens"])


def sets_of(docs: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """(id, n, digest, tokens) of docs (id, text); tokens: little-endian 64-bit hashes, of the whole set or its counted prefix."""
    bounded_batches(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(lambda it: _sets(it, words, percent, whole), "id bigint, n bigint, digest binary, tokens binary")


def _rows(schema: list[tuple[str, pa.DataType]], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [n for n, _ in schema])


def exploded(sets: DataFrame, length) -> DataFrame:
    """(token, id) for the first length(n) tokens of each set."""
    schema = [("token", pa.int64()), ("id", pa.int64())]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                ids, size = part.column(0).to_numpy(), part.column(1).to_numpy()
                tokens = [np.frombuffer(t.as_buffer(), np.int64)[: length(int(n))] for t, n in zip(part.column(2), size, strict=True)]
                yield _rows(schema, [np.concatenate(tokens), np.repeat(ids, [len(t) for t in tokens])])

    return sets.select("id", "n", "tokens").mapInArrow(run, "token bigint, id bigint")


def by_twos(values: np.ndarray, classes: np.ndarray) -> Iterator[np.ndarray]:
    """A key for each two values of one class."""
    order = np.argsort(classes, kind="stable")
    values, classes = values[order], classes[order]
    for apart in range(1, len(values)):
        same = classes[apart:] == classes[:-apart]
        if not same.any():
            return
        yield mixed(mixed(values[:-apart][same] + np.uint64(1)) + values[apart:][same]).view(np.int64)


def combined(n: int, counts: np.ndarray, tokens: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Keys of a set of n tokens; counts and tokens: those that other sets have too, by count and then by hash."""
    number, _ = size_class(n, percent)
    only = n - len(tokens)  # come first in the order
    for room in (number, number + 1):
        smallest = least_shared(n, percent) if room == number else size_class_first(room, percent)
        missing = alone(n, smallest, percent) - only
        if missing <= 0 or least_shared(smallest, percent) > n:
            continue
        kinds = token_classes(room, percent)
        rare = int(np.searchsorted(counts, FREQUENT, "right")) if kinds else len(counts)
        own = mixed(tokens.view(np.uint64) + np.uint64(room << 1))
        yield own[: min(rare, missing)].view(np.int64)
        if missing > rare:  # extended by frequent tokens
            of = (own[rare:] >> np.uint64(40)) % np.uint64(kinds)
            first = np.zeros(len(of), bool)
            first[np.unique(of, return_index=True)[1]] = True
            enough = int(np.searchsorted(np.cumsum(~first), missing - rare)) + 1
            yield from by_twos(own[rare : rare + enough], of[:enough])


def parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of a set, as 64-bit values."""
    of = (mixed(tokens.view(np.uint64)) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(of, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def keyed(counted_tokens: DataFrame, percent: int) -> DataFrame:
    """(key, id): the keys of sets (id, n, tokens: array of (count, token) of those that other sets have too)."""
    schema = [("key", pa.int64()), ("id", pa.int64())]

    def run(batches):
        keys, ids, held = [], [], 0
        for b in batches:
            each = b.column(2)
            ends = np.cumsum(pc.list_value_length(each).to_numpy())
            count, token = (c.to_numpy() for c in each.flatten().flatten())
            for i, n, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
                order = np.lexsort((token[lo:hi], count[lo:hi]))
                for k in combined(n, count[lo:hi][order], token[lo:hi][order], percent):
                    keys, ids, held = [*keys, k], [*ids, np.full(len(k), i)], held + len(k)
                    if held >= KEYS or len(keys) >= 256:
                        yield _rows(schema, [np.concatenate(keys), np.concatenate(ids)])
                        keys, ids, held = [], [], 0
        if keys:
            yield _rows(schema, [np.concatenate(keys), np.concatenate(ids)])

    return counted_tokens.select("id", "n", "tokens").mapInArrow(run, "key bigint, id bigint")


def sketched(sets: DataFrame) -> DataFrame:
    """(id, n, *PARITY, long): size and sketches of each set."""

    def run(batches):
        for b in batches:
            tokens = [np.frombuffer(t.as_buffer(), np.int64) for t in b.column(2)]
            short = np.array([parity(t, SKETCH) for t in tokens], np.int64).reshape(-1, len(PARITY))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in short.T), pa.array([parity(t, LONG).tobytes() for t in tokens], pa.binary())], ["id", "n", *PARITY, "long"])

    return sets.select("id", "n", "tokens").mapInArrow(run, f"id bigint, n bigint, {', '.join(f'{s} bigint' for s in PARITY)}, long binary")


def may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether sizes and sketches (n, *PARITY) allow the similarity."""
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    bits = reduce(add, (F.bit_count(x[s].bitwiseXOR(y[s])) for s in PARITY))
    return sizes & (bits * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent))


def near(percent: int):
    """Keep the rows (a, b, ta, tb, na, nb) whose LONG sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(k)), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (100 + percent) <= n * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def similar(percent: int):
    """Keep the rows (a, b, ta, tb, na, nb) whose sets are as similar."""

    def run(batches):
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                x = np.sort(np.concatenate([np.frombuffer(ta.as_buffer(), np.int64), np.frombuffer(tb.as_buffer(), np.int64)]), kind="stable")
                both = int(np.count_nonzero(x[1:] == x[:-1]))
                keep.append(100 * both >= percent * (len(x) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def folded(sketches: DataFrame) -> DataFrame:
    """(id, short): the LONG sketches in FOLDED bits; parities of equal places add up to the parity of both."""

    def run(batches):
        for b in batches:
            long = np.frombuffer(b"".join(v.as_py() for v in b.column(1)), np.uint64).reshape(b.num_rows, LONG // FOLDED, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in np.bitwise_xor.reduce(long, axis=1)], pa.binary())], ["id", "short"])

    return sketches.select("id", "long").mapInArrow(run, "id bigint, short binary")


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in the order of their first column dealt anew, so that the rows of a key are in one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def spanning(key: np.ndarray, ids: np.ndarray, n: np.ndarray, label: np.ndarray, short: np.ndarray, tried: set[tuple[int, int]], percent: int, forests: int) -> Iterator[tuple[int, int]]:
    """Pairs (a, b) that sizes and sketches allow, untried and of different labels at one key: as many as make `forests` forests
    over the labels of each key, one after the other of what is left. Keys come in order."""
    order = np.lexsort((mixed((ids ^ key).view(np.uint64)), key))  # other pairs first at each key
    key, ids, n, label, short = key[order], ids[order], n[order], label[order], short[order]
    ends = np.searchsorted(key, key, "right")
    code = np.unique(label, return_inverse=True)[1] + np.searchsorted(key, key) * np.int64(len(key))
    node = np.unique(code, return_inverse=True)[1]
    parents = [list(range(int(node.max()) + 1)) for _ in range(forests)]
    last = np.array(parents[-1])
    i, apart = np.arange(len(key)), 1
    while len(i := i[i + apart < ends[i]]):
        x = i[last[node[i]] != last[node[i + apart]]]
        x = x[np.minimum(n[x], n[x + apart]) * 100 >= np.maximum(n[x], n[x + apart]) * percent]
        bits = np.bitwise_count(short[x] ^ short[x + apart]).sum(axis=1, dtype=np.int64)
        x = x[bits * (100 + percent) <= (n[x] + n[x + apart]) * (100 - percent)]
        for one, two, a, b in zip(node[x].tolist(), node[x + apart].tolist(), ids[x].tolist(), ids[x + apart].tolist(), strict=True):
            pair = (min(a, b), max(a, b))
            if pair in tried:
                continue
            for parent in parents:
                if (r := _root(parent, one)) != (q := _root(parent, two)):
                    parent[r] = q
                    yield pair
                    break
        if len(x):
            last = np.array(parents[-1])
            while (last[last] != last).any():
                last = last[last]
        apart += 1


def forest(percent: int, forests: int):
    """The pairs (a, b) of `spanning` for rows (key, id, n, label, short, failed) in the order of keys; failed: smaller identifiers that the row's was tried with."""

    def run(batches):
        for t in whole_keys(batches):
            key, ids, n, label = (t.column(k).to_numpy() for k in range(4))
            short = np.frombuffer(b"".join(v.as_py() for v in t.column(4)), np.uint64).reshape(t.num_rows, -1)
            tried = {(a, b) for b, more in zip(ids.tolist(), t.column(5).to_pylist(), strict=True) for a in more or ()}
            pairs = np.array([*spanning(key, ids, n, label, short, tried, percent, forests)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def merged(one: DataFrame, two: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the corpus: the same plan at every size."""
    return one.hint("merge").join(two.hint("merge"), on, how)


def verify(pairs: DataFrame, sketches: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: sketches of 1 KB go first, and few pairs need their whole sets. At most FEW pairs are broadcast."""
    for sets, column, test in ((sketches, "long", near), (whole, "tokens", similar)):
        one, two = (sets.select(F.col("id").alias(k), F.col(column).alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
        if pairs.count() <= FEW:
            both = F.broadcast(F.broadcast(pairs).join(one, "a")).join(two, "b")
        else:
            both = merged(merged(pairs, one, "a"), two, "b")
        pairs = written(both.select("a", "b", "ta", "tb", "na", "nb").mapInArrow(test(percent), "a bigint, b bigint"), "jaccard-links")
    return pairs


def join(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest identifier reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union|. A null or empty text, or one of blanks, has an empty set
    and no link. Texts with equal sets link. A text of fewer words than a shingle has its whole sequence as its one token.
    Identifiers should be unique; rows that repeat one together with its text are one class, and those with a null one have a
    null component. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    first = written(sets_of(docs, words, percent, False), "jaccard-prefixes")
    classes = first.groupBy("digest").agg(F.min("id").alias("rep"))
    members = written(merged(first.select("id", "n", "digest"), classes, "digest").select("id", "n", "rep"), "jaccard-classes")
    reps = members.filter("id = rep and n > 0").select("id")
    short = written(merged(first, reps, "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "tokens"), "jaccard-short")
    discard(first)
    twice = exploded(short, lambda n: n).groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
    seen = merged(exploded(short, lambda n: n), twice, "token", "left_semi").groupBy("id").agg(F.count("*").alias("seen"))
    least = F.floor((F.col("n") - F.ceil(F.col("n") * percent / 100) + 2) / 2)  # counted(n), or that of a smaller partner
    small = F.floor((F.ceil(F.col("n") * percent / 100) - F.ceil(F.ceil(F.col("n") * percent / 100) * percent / 100) + 2) / 2)
    live = written(merged(short.select("id", "n"), seen, "id").filter(F.col("seen") >= F.least(least, small)).select("id"), "jaccard-live")
    discard(short)
    texts = merged(docs, live, "id", "left_semi").dropDuplicates(["id"])
    whole = written(sets_of(texts, words, percent, True).select("id", "n", "tokens"), "jaccard-sets")

    occurs = exploded(whole, lambda n: n)
    several = occurs.groupBy("token").agg(F.count("*").alias("count")).filter("count > 1")
    known = merged(occurs, several, "token").groupBy("id").agg(F.collect_list(F.struct("count", "token")).alias("tokens"))  # a set's own tokens
    keys = written(keyed(merged(known, whole.select("id", "n"), "id"), percent), "jaccard-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    meeting = written(merged(keys, shared, "key", "left_semi"), "jaccard-meeting")
    discard(keys)
    met = written(merged(whole, meeting.select("id").distinct(), "id", "left_semi"), "jaccard-met")
    discard(whole, live)
    sketches = written(sketched(met), "jaccard-sketches")
    keys = written(merged(meeting, sketches.drop("long"), "id"), "jaccard-sketched")
    discard(meeting)
    one = F.struct("id", "n", *PARITY)
    firsts = keys.groupBy("key").agg(F.min(one).alias("f"))

    side = lambda name: {k: F.col(f"{name}.{k}") for k in ("id", "n", *PARITY)}
    own = {k: F.col(k) for k in ("id", "n", *PARITY)}
    fits = may_link(own, side("f"), percent) & (F.col("id") != F.col("f.id"))
    stars = written(merged(keys, firsts, "key").filter(fits).groupBy(F.col("id").alias("a")).agg(F.min("f.id").alias("b")), "jaccard-stars")
    links = verify(stars, sketches, met, percent)
    tried = stars.select(F.col("b").alias("a"), F.col("a").alias("b"))
    nodes = met.select("id")
    labels = components(links, nodes)
    short = None
    for turn in count():
        told = merged(keys, labels, "id")
        apart = told.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
        rows = written(merged(told, apart, "key", "left_semi"), "jaccard-apart")
        if rows.isEmpty():
            break
        if turn < ROUNDS:  # each label's first class at a key, with the first one of another label
            by = rows.groupBy("key", "label").agg(F.min(one).alias("f"))
            to = by.groupBy("key").agg(F.min(F.struct("label", "f")).alias("t")).select("key", F.col("t.label").alias("other"), F.col("t.f").alias("t"))
            pairs = by.join(to, "key").filter((F.col("label") > F.col("other")) & may_link(side("f"), side("t"), percent))
            pairs = pairs.select(F.least("f.id", "t.id").alias("a"), F.greatest("f.id", "t.id").alias("b")).distinct()
            pairs = merged(pairs, tried, ["a", "b"], "left_anti")
        else:
            short = short or written(folded(sketches), "jaccard-folded")
            failed = tried.groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("failed"))
            members_of = merged(merged(rows.select("key", "id", "n", "label"), short, "id"), failed, "id", "left")
            in_order = members_of.select("key", "id", "n", "label", "short", "failed").repartition("key").sortWithinPartitions("key")
            pairs = in_order.mapInArrow(forest(percent, MORE ** (turn - ROUNDS)), "a bigint, b bigint").distinct()
        pairs = written(pairs, "jaccard-pairs")
        discard(rows)
        if pairs.isEmpty():
            if turn < ROUNDS:
                continue
            break
        tried = tried.unionByName(pairs)
        more = verify(pairs, sketches, met, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links, nodes)
    by_class = labels.select(F.col("id").alias("rep"), "label")
    out = merged(members, by_class, "rep", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
