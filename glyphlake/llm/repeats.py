"""Suffix-array deduplication: remove every byte that lies in a string of LENGTH bytes that also starts anywhere else.

1. Anchors. Every window of LENGTH bytes holds the least of its GRAM-byte hashes, at the same place in equal windows. The
   windows of one anchor are a range of starts; the bytes they cover are a segment. A scan of the texts gives one small row
   for each segment: the anchor's hash, a cryptographic digest of the segment's bytes, and where it is. Hashes only route.
2. Segments of the same bytes are one, with a weight: how many they are. A segment alone with its anchor, and with weight 1, has no
   repeat. All others go on, one of each with its bytes.
3. Suffix arrays. A batch of segments is cut, from the anchor on, in words of 8 bytes, which are the symbols of one string.
   Its suffix array (glyphlake.llm.suffixes) brings suffixes that share CORE symbols together: these are classes. A window of
   LENGTH bytes is CORE whole symbols with 8 bytes around them, so windows are equal when their class, their place and these
   8 bytes are: decided on the bytes themselves. A window is repeated if its equals weigh 2 or more. What is found in a segment
   holds for all segments of the same bytes.
4. Hot anchors, such as passages that many documents share in different surroundings. One with over HOT different segments is split
   by SPLIT longer keys, the bytes that some neighbouring windows all have. A key that is still hot is not gathered: its windows
   go out one by one as digests of their whole bytes, and are counted. Of an anchor with over HOTTEST segments, all windows do. So
   a task never holds more than HOT segments of one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import discard, located, written
from glyphlake.llm.suffixes import suffix_array
from glyphlake.llm.words import bounded_batches, bytes_of, mixed

LENGTH, GRAM = 400, 128
WINDOW = LENGTH - GRAM + 1
CORE = LENGTH // 8 - 1
#: Bytes of one scanned block, and of the segments in one suffix array.
BLOCK, ARRAY = 1 << 20, 1 << 18
#: An anchor with more different segments than HOT is split, by SPLIT longer keys; with more than HOTTEST, in single windows.
HOT, SPLIT, HOTTEST = 256, 8, 65_536

_rng = np.random.default_rng(20240131)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_POW = np.multiply.accumulate(np.append(np.uint64(1), np.full(BLOCK + LENGTH, _BASE, np.uint64)))
_INV = np.multiply.accumulate(np.append(np.uint64(1), np.full(BLOCK + LENGTH, pow(_BASE, -1, 2**64), np.uint64)))
_LOW = np.uint64((1 << 24) - 1)


def digest(data, place: int) -> bytes:
    """A digest of bytes and a place among them."""
    return hashlib.blake2b(data, digest_size=16, salt=place.to_bytes(8, "little")).digest()


class Hashes:
    """Hashes of any substring of data, in constant time each."""

    def __init__(self, data: np.ndarray):
        self.sums = np.append(np.uint64(0), np.cumsum(_VALUE[data] * _POW[: len(data)], dtype=np.uint64))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * _INV[a] + (b - a).astype(np.uint64))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, anchor, h, g) of all segments of the texts in data: window starts lo to hi, from each text's beginning; h the
    anchor's hash, g the digest of the segment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, []
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    least = (sliding_least(grams & ~_LOW | at.astype(np.uint64), WINDOW) & _LOW).astype(np.int64)
    long = np.diff(offsets) >= LENGTH
    mark = np.zeros(n + 1, np.int8)
    mark[offsets[:-1][long]] += 1
    mark[offsets[1:][long] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(mark[: len(least)], dtype=np.int8))
    if not len(starts):
        return none, none, none, none, none, []
    anchors = least[starts]
    first = np.flatnonzero(np.append(True, (np.diff(anchors) != 0) | (np.diff(starts) != 1)))
    lo, hi, a = starts[first], starts[np.append(first[1:], len(starts)) - 1], anchors[first]
    text = np.searchsorted(offsets, lo, "right") - 1
    base = offsets[text]
    view = memoryview(np.ascontiguousarray(data))
    digests = [digest(view[x : y + LENGTH], z - x) for x, y, z in zip(lo.tolist(), hi.tolist(), a.tolist(), strict=True)]
    return text, lo - base, hi - base, a - base, grams[a].view(np.int64), digests


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, where in it, bytes, offsets): some whole texts, or a part of a long one with LENGTH - 1 bytes of the next."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > BLOCK:
            for a in range(offsets[i], offsets[i + 1] - LENGTH + 1, BLOCK):
                b = min(a + BLOCK + LENGTH - 1, offsets[i + 1])
                yield i, a - offsets[i], data[a:b], np.array([0, b - a])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, 0, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _scan(batches):
    names = ["file", "row", "lo", "hi", "anchor", "h", "g"]
    for b in batches:
        file, row = (c.to_numpy() for c in b.columns[1:])
        for first, base, data, offsets in _blocks(*bytes_of(b.column(0))):
            text, lo, hi, a, h, g = segments(data, offsets)
            at = [pa.array(x[first + text]) for x in (file, row)]
            yield pa.RecordBatch.from_arrays([*at, *(pa.array((x + base).astype(np.int32)) for x in (lo, hi, a)), pa.array(h), pa.array(g, pa.binary())], names)


#: A segment's windows, or some of them, to be decided: key that routes it, weight, the segment's digest, the first window from the
#: segment's beginning, the anchor from there, and the bytes.
CUT = [("key", pa.int64()), ("weight", pa.int64()), ("g", pa.binary()), ("first", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())]


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [n for n, _ in schema])


def _cut(batches):
    """CUT of the wanted segments (lo, hi, anchor, h, g, n, m) of each text; m: the anchor's different segments."""
    for b in batches:
        rows = []
        for text, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            data = text.as_buffer() or b""
            for w in wanted:
                lo, hi, a, key, n, g = w["lo"], w["hi"], w["anchor"], w["h"], w["n"], w["g"]
                if w["m"] <= HOT:
                    rows.append((key, n, g, 0, a - lo, bytes(data[lo : hi + LENGTH])))
                    continue
                step = -(-WINDOW // SPLIT)
                for c in range(SPLIT):  # the windows that begin c * step to (c + 1) * step - 1 before the anchor
                    first, last = max(lo, a - (c + 1) * step + 1), min(hi, a - c * step)
                    if first <= last:
                        both = bytes(data[a - c * step : a - (c + 1) * step + 1 + LENGTH])
                        own = int.from_bytes(hashlib.blake2b(both, digest_size=7, salt=bytes([c])).digest(), "big")
                        rows.append((key ^ own, n, g, first - lo, a - first, bytes(data[first : last + LENGTH])))
                    if len(rows) >= 8192:
                        yield _batch(rows, CUT)
                        rows = []
        yield _batch(rows, CUT)


#: What is decided: windows `first` to `last` from the beginning of the segments of a digest are repeats; or, with a window's own
#: digest, one window that is yet to be counted by it.
FOUND = [("g", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("window", pa.binary()), ("weight", pa.int64())]


def single_windows(rows) -> list[tuple]:
    """FOUND for each window of (weight, g, first, bytes)."""
    return [(g, first + i, first + i, digest(data[i : i + LENGTH], 0), weight) for weight, g, first, data in rows for i in range(len(data) - LENGTH + 1)]


def _windows(batches):
    """FOUND for each window of the wanted segments of the hottest anchors."""
    for b in batches:
        for text, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            data = text.as_buffer() or b""
            for w in wanted:
                yield _batch(single_windows([(w["n"], w["g"], 0, bytes(data[w["lo"] : w["hi"] + LENGTH]))]), FOUND)


def repeated_windows(parts: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """For each part (weight, anchor, bytes) the starts of its windows that equal another window of these parts, or of the same part with a weight of 2 or more."""
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    size = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(size) - size
    lead = np.array([p[1] % 8 for p in parts])  # symbols are cut from the anchor on
    blocks = (size - lead) // 8
    part = np.repeat(np.arange(len(parts)), blocks)
    number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    where = (begin + lead)[part] + 8 * number
    words = np.zeros(len(where), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | data[where + k].astype(np.uint64)
    _, rank = np.unique(words, return_inverse=True)
    string = np.zeros(len(rank) + len(parts), np.int64)  # 0 ends each part
    at = np.arange(len(rank)) + part
    string[at] = rank + 1
    order = suffix_array(string)
    # Classes: neighbours in the suffix array that share CORE symbols.
    room = np.zeros(len(string), np.int64)
    room[at] = blocks[part] - number
    string = np.append(string, np.zeros(CORE, np.int64))
    same = np.append(False, (room[order[1:]] >= CORE) & (room[order[:-1]] >= CORE))
    live = np.flatnonzero(same)
    for k in range(CORE):
        equal = string[order[live] + k] == string[order[live - 1] + k]
        same[live[~equal]] = False
        live = live[equal]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(~same)
    kind = kind[at]
    # Windows begin 0 to 7 bytes before a symbol; the rest of their 8 loose bytes are behind its CORE symbols.
    whole = np.flatnonzero(blocks[part] - number >= CORE)
    s = where[whole][:, None] - np.arange(8)
    r = np.broadcast_to(np.arange(8), s.shape)
    own = np.broadcast_to(part[whole][:, None], s.shape)
    fits = (s >= begin[own]) & (s + LENGTH <= (begin + size)[own])
    s, r, own, c = s[fits], r[fits], own[fits], np.broadcast_to(kind[whole][:, None], s.shape)[fits]
    loose = np.zeros(len(s), np.uint64)
    for k in range(8):
        loose = loose << np.uint64(8) | data[s + k + 8 * CORE * (k >= r)].astype(np.uint64)
    sort = np.lexsort((loose, c * 8 + r))
    new = np.append(True, (np.diff((c * 8 + r)[sort]) != 0) | (np.diff(loose[sort]) != 0)) if len(sort) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    total = np.bincount(run, np.array([p[0] for p in parts])[own[sort]]) if len(sort) else np.zeros(0)
    found = sort[total[run] >= 2]
    found = found[np.argsort(s[found])]
    ends = np.searchsorted(own[found], np.arange(len(parts) + 1))
    return [s[found[a:b]] - begin[i] for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ascending starts as ranges (first, last)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


def _sorted(batches):
    """FOUND of CUT rows that come by key. Keys are packed into arrays of ARRAY bytes; of a key with over HOT rows, windows go out as
    digests while its rows are read."""

    def solve(rows):
        parts = [(r[1], r[4], r[5]) for r in rows]
        return _batch([(r[2], r[3] + a, r[3] + b, None, None) for r, starts in zip(rows, repeated_windows(parts), strict=True) for a, b in runs(starts)], FOUND)

    ready: list = []
    group: list = []
    held = size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and row[0] != group[0][0]:
                if size > HOT:
                    yield _batch(single_windows([(r[1], r[2], r[3], r[5]) for r in group]), FOUND)
                elif len(group) > 1 or group[0][1] > 1:
                    ready += group
                    held += sum(len(r[5]) for r in group)
                    if held >= ARRAY:
                        yield solve(ready)
                        ready, held = [], 0
                group, size = [], 0
            group.append(row)
            size += 1
            if size > HOT and len(group) > 32:
                yield _batch(single_windows([(r[1], r[2], r[3], r[5]) for r in group[:-1]]), FOUND)
                group = group[-1:]
    if group and size > HOT:
        yield _batch(single_windows([(r[1], r[2], r[3], r[5]) for r in group]), FOUND)
    elif len(group) > 1 or group and group[0][1] > 1:
        ready += group
    if ready:
        yield solve(ready)


def _removed(batches):
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of texts with their ranges of repeated windows."""
    for b in batches:
        rows = []
        for text, wanted in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            data, kept, spans = text.as_buffer().to_pybytes() if text.is_valid else b"", hashlib.sha256(), []
            for lo, hi in sorted((w["lo"], w["hi"] + LENGTH) for w in wanted or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            at = 0
            for lo, hi in spans:
                kept.update(data[at:lo])
                at = hi
            kept.update(data[at:])
            rows.append((len(data), sum(y - x for x, y in spans), len(spans), kept.hexdigest(), [{"lo": x, "hi": y} for x, y in spans]))
        types = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))]
        told = _batch(rows, types)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *told.columns], ["id", *(n for n, _ in types)])


_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (lo, hi: the maximal removed runs of bytes).

    A null text is empty; texts shorter than LENGTH bytes keep all. Texts are known by where their content is, so null and repeated
    identifiers are rows like any other. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = located(docs, F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("bytes"))
    place = ["file", "row"]
    found = written(texts.select("bytes", *place).mapInArrow(_scan, "file bigint, row bigint, lo int, hi int, anchor int, h bigint, g binary"), "repeats-segments")
    distinct = written(found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct(*place, "lo", "hi", "anchor")).alias("s")), "repeats-distinct")
    several = distinct.groupBy("h").agg(F.count("*").alias("m"), F.max("n").alias("most")).filter("m > 1 OR most > 1")
    wanted = distinct.join(several, "h").filter("m > 1 OR n > 1").select(*(F.col(f"s.{c}").alias(c) for c in place), "m", F.struct("s.lo", "s.hi", "s.anchor", "h", "g", "n", "m").alias("w"))
    wanted = written(wanted, "repeats-wanted")
    bytes_of_wanted = lambda some: texts.select("bytes", *place).join(some.groupBy(*place).agg(F.collect_list("w").alias("wanted")), place).select("bytes", "wanted")  # noqa: E731  a text's own segments
    cut = bytes_of_wanted(wanted.filter(F.col("m") <= HOTTEST)).mapInArrow(_cut, _ddl(CUT))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    decided = cut.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sorted, _ddl(FOUND))
    if (wanted.agg(F.max("m")).first()[0] or 0) > HOTTEST:
        decided = decided.unionByName(bytes_of_wanted(wanted.filter(F.col("m") > HOTTEST)).mapInArrow(_windows, _ddl(FOUND)))
    decided = written(decided, "repeats-found")
    apart = decided.filter("window IS NOT NULL")
    again = apart.groupBy("window").agg(F.sum("weight").alias("weight")).filter("weight > 1").select("window")
    ranges = decided.filter("window IS NULL").select("g", "first", "last").unionByName(apart.join(again, "window", "left_semi").select("g", "first", "last"))
    by_digest = ranges.groupBy("g").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))  # of one segment: WINDOW at most
    placed = F.transform("ranges", lambda r: F.struct((F.col("lo") + r["first"]).alias("lo"), (F.col("lo") + r["last"]).alias("hi")))
    spans = found.join(by_digest, "g").select(*place, placed.alias("r"))
    spans = written(spans.groupBy(*place).agg(F.flatten(F.collect_list("r")).alias("ranges")), "repeats-ranges")
    discard(found, distinct, wanted, decided)
    out = texts.join(spans, place, "left").select("id", "bytes", "ranges").mapInArrow(_removed, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<lo: int, hi: int>>")
    return out.withColumnRenamed("id", id_col)
