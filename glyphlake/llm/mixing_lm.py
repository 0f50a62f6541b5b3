"""Language-model scoring by online logistic context mixing.

Every word is coded by the bits of its bytes: glyphlake.llm.bits predicts each bit in several hashed contexts, mixes the
predictions by gated weights and refines the sum by an adaptive map. Cells, weights and map are learnt from all distinct words of
the training documents, and weights and map go on learning within a document that is scored online. So any word, known or not, pays
for its letters, and the probabilities of all words add up to one.

A document's tokens (its words, then its end) are then gone through in order, and four predictions are mixed, each a
distribution over all words: by bits, the word's share of the training tokens, its share of the training tokens behind the word
before, and its share of what the document held so far. Their weights are gated by how often the word before comes. They begin
with what fits the training documents and learn online within the document. All counts but those of cells are by whole 64-bit
keys, every word and every pair of words, and grow with the corpus. What a training document adds to counts isn't counted when it is
scored itself.

Texts aren't shuffled. A scan makes one row of each block of texts, a group: its distinct words, and the place of each token
among them. A group's words and pairs go out as sorted keys, a block for each bucket of keys; a bucket's blocks are summed by
key, and the answers come back by position.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import bits
from glyphlake.llm.common import discard, written
from glyphlake.llm.words import bounded_batches, lowered, mixed, word_hashes, word_spans

#: Bytes of text in one group, about, and documents, at most a batch more; bytes of text whose words and pairs are in one bucket of keys, on average.
GROUP_BYTES, GROUP_DOCUMENTS, BUCKET_BYTES = 3 << 20, 20_000, 12 << 20
END_HASH = np.array([-1], np.int64).view(np.uint64)[0]
#: Predictions of a token; first weights; gates by the bits of the count of the word before; learning rate; rounds of fitting in a group.
KINDS, FIRST, GATES, RATE, ROUNDS = 4, (0.2, 0.4, 0.3, 0.1), 24, 0.02, 2
#: Tokens between two updates in a document: an eighth of those before, at most MOST.
MOST = 16
#: What a word's bits count as at least while weights are learnt.
LEAST = np.float32(1e-30)
#: Tokens that are fitted at a time; bytes of a row group of the tables of groups.
FITTED, ROW_GROUP = 1 << 18, 16 << 20
#: Words whose costs a worker keeps, 12 bytes each.
KEPT = 2_000_000
#: What this worker has priced, by the run of `score`: one at most.
_priced: dict[str, bits.Memo] = {}


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def narrow(x: np.ndarray) -> bytes:
    """x in the fewest bytes that hold its numbers, which are not negative."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """n numbers that `narrow` made bytes of."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def packed(ascending: np.ndarray) -> bytes:
    """Ascending keys as gaps, all first bytes before all second ones: the high ones are zeros, which shuffles compress away."""
    return np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(x: np.ndarray) -> bytes:
    """x compressed, all first bytes of its numbers before all second ones."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True)


def loose(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: A group: of each document id, held_out, bytes and tokens; of each token the place of its word, in 4 bytes; bytes and lengths of
#: words, the most frequent first, so that places are small numbers, and the end last. The last three are compressed.
GROUPS = "g bigint, ids array<bigint>, held array<boolean>, sizes array<bigint>, counts array<bigint>, places binary, words binary, lens binary"


def group(g: int, batch: pa.Table) -> pa.RecordBatch:
    """A row of GROUPS for (id, text, held)."""
    texts = batch.column(1).combine_chunks()
    hashes, counts, starts, lens, data = word_spans(texts)
    ends = np.cumsum(counts)
    hashes, starts, lens = np.insert(hashes, ends, END_HASH), np.insert(starts, ends, 0), np.insert(lens, ends, 0)
    _, first, places = np.unique(hashes, return_index=True, return_inverse=True)
    often = np.bincount(places)
    often[-1] = 0  # the end has the largest hash
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first, places = first[order], rank[places]
    n = lens[first]
    at = np.arange(n.sum()) + np.repeat(starts[first] - np.cumsum(n) + n, n)
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    row = [g, batch.column(0).to_pylist(), batch.column(2).to_pylist(), size, (counts + 1).tolist(), *(squeezed(x) for x in (places.astype(np.uint32), lowered(data[at]), n.astype(np.uint32)))]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _schema(GROUPS), strict=True)], schema=_schema(GROUPS))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ready, size = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        ready.append(b)
        size += b.nbytes
        if size >= GROUP_BYTES or sum(x.num_rows for x in ready) >= GROUP_DOCUMENTS:
            yield group(number, pa.Table.from_batches(ready))
            number, ready, size = number + 1, [], 0
    if ready:
        yield group(number, pa.Table.from_batches(ready))


class Group:
    """A row of GROUPS read again."""

    def __init__(self, row: dict):
        self.counts = np.array(row["counts"], np.int64)
        self.held = np.array(row["held"], bool)
        self.places = loose(row["places"], np.uint32).astype(np.int32)
        self.lens = loose(row["lens"], np.uint32).astype(np.int64)
        self.words = loose(row["words"], np.uint8)
        self.ends = np.cumsum(self.counts)
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        self.train = ~self.held[self.doc]

    def strings(self) -> pa.Array:
        """All words but the end."""
        return pa.Array.from_buffers(pa.large_binary(), len(self.lens) - 1, [None, pa.py_buffer(np.append(0, np.cumsum(self.lens[:-1])).tobytes()), pa.py_buffer(self.words)])

    def before(self) -> np.ndarray:
        """The place of the word before each token: that of the end, before a document's first."""
        out = np.roll(self.places, 1)
        if len(out):
            out[self.ends - self.counts] = self.places[-1]
        return out

    def at(self) -> np.ndarray:
        """The place of each token in its document."""
        return np.arange(len(self.places), dtype=np.int32) - np.repeat((self.ends - self.counts).astype(np.int32), self.counts)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places): the sorted keys of all words and pairs; the place among them of each word, then of each token's pair."""
        hashes = np.append(word_hashes(self.strings())[0], END_HASH)
        pairs = mixed(mixed(hashes[self.before()] + np.uint64(1)) + hashes[self.places])
        return np.unique(np.concatenate([hashes, pairs]), return_inverse=True)

    def repeats(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times, rank) of each token's place in its document: how often it comes there, and how often before."""
        most = int(places.max()) + 1 if len(places) else 1
        if most > 2**62 // (len(self.counts) + 1):
            places = np.unique(places, return_inverse=True)[1]
            most = len(places)
        code = self.doc.astype(np.int64) * most + places
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(order)))
        del code
        times, rank = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        times[order] = np.repeat(n, n)
        rank[order] = np.arange(len(order)) - np.repeat(first, n)
        return times, rank


def bucket_starts(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys of each bucket, an even range of keys, begin, with the end at last."""
    bounds = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(distinct, bounds), len(distinct))


def asked(buckets: int):
    """(b, g, keys, n): the words and pairs of a group by bucket, with how often they come in training texts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Group(row)
                distinct, places = own.keys()
                n = np.bincount(places[len(own.lens) :][own.train], minlength=len(distinct))
                n += np.bincount(places[: len(own.lens)][own.places[own.train]], minlength=len(distinct))
                at = bucket_starts(distinct, buckets)
                b = np.flatnonzero(np.diff(at))
                cols = [pa.array(b, pa.int64()), pa.array(np.full(len(b), row["g"]), pa.int64()), pa.array([packed(distinct[at[i] : at[i + 1]]) for i in b], pa.binary()), pa.array([narrow(n[at[i] : at[i + 1]]) for i in b], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["b", "g", "keys", "n"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """(b, g, n): for each key of each block of one bucket, twice the sum of its counts, plus 1 in the first group that has it."""
    order = np.argsort(table.column("g").to_numpy(), kind="stable")
    blocks = [unpacked(x.as_py()) for x in table.column("keys").take(order)]
    n = np.concatenate([wide(x.as_py(), len(k)) for x, k in zip(table.column("n").take(order), blocks, strict=True)])
    distinct, first, places = np.unique(np.concatenate(blocks), return_index=True, return_inverse=True)
    answer = 2 * np.bincount(places, n, len(distinct)).astype(np.int64)[places]
    answer[first] += 1
    ends = np.cumsum([len(k) for k in blocks])
    return pa.table({"b": table.column("b"), "g": table.column("g").take(order), "n": pa.array([narrow(x) for x in np.split(answer, ends[:-1])], pa.binary())})


#: GROUPS with, of each word, its count, and whether it is new here; of each pair of a token its count; training tokens and words.
CODED = GROUPS + ", known binary, new binary, pairs binary, tokens bigint, vocabulary bigint"


def answered(buckets: int):
    def run(groups: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in groups.to_pylist():
            own = Group(row)
            distinct, places = own.keys()
            answer, at = np.zeros(len(distinct), np.int64), bucket_starts(distinct, buckets)
            for b, n in zip(answers.column("b").to_pylist(), answers.column("n"), strict=True):
                answer[at[b] : at[b + 1]] = wide(n.as_py(), int(at[b + 1] - at[b]))
            words, pairs = places[: len(own.lens)], places[len(own.lens) :]
            known, new = answer[words] >> 1, (answer[words] & 1 > 0) & (answer[words] > 1)
            rows.append(row | {"known": narrow(known), "new": np.packbits(new).tobytes(), "pairs": narrow(answer[pairs] >> 1), "tokens": int(own.train.sum()), "vocabulary": int(new.sum())})
        return pa.Table.from_pylist(rows, schema=_schema(CODED))

    return run


def _schema(ddl: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    of = lambda t: pa.list_(types[t[6:-1]]) if t.startswith("array<") else types[t]
    return pa.schema([(c.split(" ")[0], of(c.split(" ")[1])) for c in ddl.split(", ")])


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """CODED of all documents, one row for each group."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held"))
    groups = written(rows.mapInArrow(_grouped, GROUPS), "lm-groups", "zstd", ROW_GROUP)
    size = groups.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    blocks = groups.mapInArrow(asked(buckets), "b bigint, g bigint, keys binary, n binary")
    answers = written(blocks.groupBy("b").applyInArrow(_summed, "b bigint, g bigint, n binary"), "lm-answers", "zstd", ROW_GROUP)
    out = written(groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(answered(buckets), CODED), "lm-coded", "zstd", ROW_GROUP)
    discard(groups, answers)
    return out


def new_words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lens) of the training words that no group before has."""
    lens = loose(row["lens"], np.uint32).astype(np.int64)
    new = np.unpackbits(np.frombuffer(row["new"], np.uint8), count=len(lens)).astype(bool)
    return loose(row["words"], np.uint8)[np.repeat(new, lens)], lens[new]


def summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all rows of arrays of `size` numbers; `of` adds a row's to the array that it is given. A task adds up its own,
    and sends them in blocks of their non-zero ones."""
    step = 1 << 18

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for row in batch.to_pylist():
                of(row, total)
        for k in range(0, size, step):
            part = total[k : k + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step]), pa.array([_thin(part)], pa.binary())], ["k", "v"])

    def add(key, table):
        return pa.table({"k": pa.array([key[0].as_py()]), "v": pa.array([_thin(sum(_thick(v.as_py(), min(step, size - key[0].as_py() * step)) for v in table.column("v")))], pa.binary())})

    parts = rows.mapInArrow(run, "k bigint, v binary").groupBy("k").applyInArrow(add, "k bigint, v binary").toArrow()  # at most `size` numbers
    out = np.zeros(size)
    for k, v in zip(parts.column("k").to_pylist(), parts.column("v"), strict=True):
        out[k * step : (k + 1) * step] = _thick(v.as_py(), min(step, size - k * step))
    return out


def _thin(x: np.ndarray) -> bytes:
    """Non-zero numbers of x and where they are, in 4 bytes each if they are whole ones."""
    at = np.flatnonzero(x).astype(np.uint32)
    small = x[at].astype(np.uint32) if x.min(initial=0) >= 0 and x.max(initial=0) < 2**32 else None
    exact = small is not None and bool((small == x[at]).all())
    return bytes([exact]) + at.tobytes() + (small if exact else x[at]).tobytes()


def _thick(data: bytes, size: int) -> np.ndarray:
    exact, out = data[0], np.zeros(size)
    n = (len(data) - 1) // (8 if exact else 12)
    out[np.frombuffer(data, np.uint32, n, 1)] = np.frombuffer(data[1 + 4 * n :], np.uint32 if exact else np.float64)
    return out


def byte_model(rows: DataFrame) -> bits.Model:
    """The model of bits that all training words make."""
    words = rows.select("words", "lens", "new")

    def letters(row, total):
        data, lens = new_words(row)
        total += np.bincount(data, minlength=256)
        total[bits.BLANK] += len(lens)

    def learn(row, total):
        total += model.learnt(*new_words(row))

    code = bits.Code(summed(words, 256, letters))
    model = bits.Model(code, bits.fitted(summed(words, 2 * int(bits.OFFSETS[-1]), lambda row, total: bits.counted(code, *new_words(row), total))))
    return model.after(summed(words, model.learnt(np.zeros(0, np.uint8), np.zeros(0, np.int64)).size, learn))


def memo_of(run_id: str) -> bits.Memo:
    """What this worker, which outlives a task, has priced in a run."""
    if run_id not in _priced:
        _priced.clear()
    return _priced.setdefault(run_id, bits.Memo(KEPT))


def priced_words(own: Group, model: bits.Model, coder, memo: bits.Memo) -> np.ndarray:
    """Bits of each word of a group."""

    def price(missing: np.ndarray) -> np.ndarray:
        return model.costs(own.words[np.repeat(missing, own.lens)], own.lens[missing], coder)

    return memo.of(np.append(word_hashes(own.strings())[0], END_HASH), price)


def kept_costs(costs: np.ndarray) -> bytes:
    """Costs of tokens as the upper 24 bits of their floats, rounded up so that no probability grows."""
    return squeezed((costs.astype(np.float32).view(np.uint32) + np.uint32(0xFF)) >> np.uint32(8))


def costs_kept(data: bytes) -> np.ndarray:
    return (loose(data, np.uint32) << np.uint32(8)).view(np.float32)


def shares(row: dict, costs: np.ndarray, tokens: int) -> tuple[Group, np.ndarray, np.ndarray]:
    """(group, P, gate): the probability of each token in each of KINDS, and the gate of its weights. Each kind is a distribution
    over all words, or 0 for all of them. costs: bits of each token."""
    own = Group(row)
    p = np.empty((len(own.places), KINDS), np.float32)
    p[:, 0] = np.exp2(-costs)
    times, rank = own.repeats(own.places)
    p[:, 3] = rank / np.maximum(own.at(), 1)
    count = wide(row["known"], len(own.lens))[own.places] - np.where(own.train, times, 0)
    del times, rank
    first = np.roll(count, 1)
    if len(first):
        first[own.ends - own.counts] = count[own.ends - 1]
    p[:, 1] = count / np.maximum(1, tokens - np.where(own.held, 0, own.counts))[own.doc]
    del count
    again = own.repeats(own.before().astype(np.int64) * len(own.lens) + own.places)[0]
    p[:, 2] = (wide(row["pairs"], len(own.places)) - np.where(own.train, again, 0)) / np.maximum(first, 1)
    return own, p, np.minimum(np.frexp(first.astype(np.float32))[1], GATES - 1).astype(np.int8)


def usable(at: np.ndarray, gate: np.ndarray, tokens: int) -> np.ndarray:
    """Which kinds are distributions: a share needs something that it is a share of."""
    out = np.ones((len(at), KINDS), np.float32)
    out[:, 1] = tokens > 0
    out[:, 2] = gate > 0
    out[:, 3] = at > 0
    return out


def fitted(own: Group, p: np.ndarray, gate: np.ndarray, start: np.ndarray, tokens: int) -> np.ndarray:
    """Sums by gate and kind of what each kind explains of the training tokens (p, gate), after ROUNDS rounds of fitting here."""
    total, at = np.zeros((GATES, KINDS)), own.at()
    for _ in range(ROUNDS):
        total, now = np.zeros((GATES, KINDS)), start.astype(np.float32)
        for k in range(0, len(p), FITTED):
            live = own.train[k : k + FITTED]
            g = gate[k : k + FITTED][live]
            part = now[g] * p[k : k + FITTED][live] * usable(at[k : k + FITTED][live], g, tokens)
            part[:, 0] = np.maximum(part[:, 0], LEAST)
            part /= part.sum(axis=1, keepdims=True)
            total += np.stack([np.bincount(g, part[:, j], GATES) for j in range(KINDS)], axis=1)
        start = (total + start) / (total.sum(axis=1, keepdims=True) + 1)
    return total


def document_logs(own: Group, p: np.ndarray, costs: np.ndarray, gate: np.ndarray, start: np.ndarray, tokens: int) -> np.ndarray:
    """log10 probability of each document. costs: bits of each token, for what is too little for p. Its weights begin with start (by gate and kind) and learn from block to block of its tokens."""
    order = np.argsort(-own.counts, kind="stable")
    size, first = own.counts[order], (own.ends - own.counts)[order]
    weights = np.tile(np.log(start).astype(np.float32), (len(size), 1, 1))
    out = np.zeros(len(size))
    for live, doc, place, token in bits.block_by_block(size, first, MOST):
        own_gate = gate[token]
        share = np.exp(weights[doc, own_gate]) * usable(place, own_gate, tokens)
        share /= share.sum(axis=1, keepdims=True)
        part = share * p[token]
        part[:, 0] = np.maximum(part[:, 0], LEAST)
        total = part.sum(axis=1)
        log = np.where(total > 2 * LEAST, np.log10(total), np.log10(share[:, 0]) - costs[token] * np.log10(2))
        out[:live] += np.bincount(doc, log, live)
        step = RATE * (part / total[:, None] - share)
        cell = doc * GATES + own_gate.astype(np.int64)
        flat = weights.reshape(-1, KINDS)
        for k in range(KINDS):
            np.add.at(flat[:, k], cell, step[:, k])
    result = np.empty(len(size))
    result[order] = out
    return result


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", online: bool = False) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), bits_per_byte.

    online: the mix of bits, its weights and its map, goes on learning within each document; else a word costs the same everywhere.
    A null text counts as empty and has one token, its end; bits_per_byte is null for an empty text. Without training documents
    the bits are evenly likely. Rows with a null identifier are training documents and scored like all; rows that repeat one are
    trained on and scored each. Other columns are ignored. An empty table gives no rows.
    """
    rows = coded(docs, id_col, text_col)
    tokens, vocabulary = (int(x or 0) for x in rows.agg(F.sum("tokens"), F.sum("vocabulary")).first())
    model = byte_model(rows)
    start = np.tile(np.array(FIRST), (GATES, 1))

    run_id = uuid.uuid4().hex

    def cost(batches):
        coder, memo = (None, None) if online else (model.coder(), memo_of(run_id))
        for batch in batches:
            costs, fits = [], []
            for row in batch.to_pylist():
                own = Group(row)
                if online:
                    each = model.online(own.words, own.lens, own.places, own.counts)
                    costs.append(kept_costs(each))
                else:
                    word = priced_words(own, model, coder, memo)
                    each = word[own.places]
                    costs.append(word.tobytes())
                own, p, gate = shares(row, each, tokens)
                fits.append(fitted(own, p, gate, start, tokens).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(costs, pa.binary()), pa.array(fits, pa.list_(pa.float64())), *(batch.column(n) for n in names)], ["g", "costs", "fits", *names])

    names = ["ids", "held", "sizes", "counts", "places", "words", "lens", "known", "pairs"]
    schema = "g bigint, costs binary, fits array<double>, " + ", ".join(c for c in CODED.split(", ") if c.split(" ")[0] in names)
    priced = written(rows.drop("new").mapInArrow(cost, schema), "lm-priced", "zstd", ROW_GROUP)
    discard(rows)
    sums = np.array(priced.agg(*(F.sum(F.element_at("fits", k + 1)) for k in range(GATES * KINDS))).first(), float)
    sums = np.nan_to_num(sums).reshape(GATES, KINDS)
    trained = (sums + start) / (sums + start).sum(axis=1, keepdims=True)
    scale = float(np.log10(tokens + vocabulary + 1))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                costs = costs_kept(row["costs"]) if online else np.frombuffer(row["costs"], np.float32)[loose(row["places"], np.uint32)]
                costs = costs.astype(float)
                own, p, gate = shares(row, costs, tokens)
                logs = document_logs(own, p, costs, gate, trained, tokens)
                known = wide(row["known"], len(own.lens))[own.places]
                add = lambda x: np.bincount(own.doc, x, len(own.counts))  # noqa: B023, E731
                size = np.array(row["sizes"], float)
                per_byte = pa.array(-logs / np.log10(2) / np.maximum(1, size), mask=size == 0)
                cols = [pa.array(row["ids"], pa.int64()), pa.array(own.held), pa.array(own.counts), pa.array(add(known > 0).astype(np.int64)), pa.array(add(np.log10(known + 1.0)) - own.counts * scale), pa.array(logs), per_byte]
                yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    out = priced.drop("g", "fits").mapInArrow(run, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte")
