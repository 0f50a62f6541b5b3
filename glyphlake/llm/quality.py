"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Random Fourier features approximate a Gaussian kernel over the standardised statistics. Each partition sums its share of the
normal equations; Spark adds them up by cell, and the driver solves a system of FEATURES + 1 unknowns. Raw scores are made
probabilities by isotonic regression over BINS steps, fitted on rows that the ridge hasn't seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import written
from glyphlake.llm.words import bounded_batches, bytes_of, word_hashes

FEATURES, BINS, RIDGE, SEED = 192, 1024, 1e-3, 20240607
STATISTICS = ("upper", "digit", "mark", "symbol", "bar", "stop", "line", "other", "word_length", "distinct", "pairs", "words", "repeated_lines", "short_lines")

#: Classes of bytes: 1 upper, 2 lower, 3 digit, 4 `!` and `?`, 5 symbols, 6 bars and tabs, 7 stops, 8 line ends, 9 blanks, 10 non-ASCII, 0 others.
_CLASS = np.zeros(256, np.int64)
for _k, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!?", b"#$%&*+<=>@\\^_`~{}[]/", b"|\t", b".,;:", b"\n\r", b" ", range(128, 256)), 1):
    _CLASS[list(_of)] = _k


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; all zero for an empty one."""
    data, offsets = bytes_of(texts)
    size = np.diff(offsets)
    counts = np.zeros((len(size), 11))
    at = 0
    while at < len(size):  # about 1 MB at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        of = np.repeat(np.arange(to - at) * 11, size[at:to])
        counts[at:to] = np.bincount(of + _CLASS[data[offsets[at] : offsets[to]]], minlength=(to - at) * 11).reshape(-1, 11)
        at = to
    hashes, n = word_hashes(texts)
    ends = np.cumsum(n)
    distinct, pairs, again, short = (np.zeros(len(n)) for _ in range(4))
    with np.errstate(over="ignore"):
        both = hashes[:-1] * np.uint64(31) + hashes[1:] if len(hashes) else hashes
    for i, (e, c) in enumerate(zip(ends, n, strict=True)):
        if c:
            distinct[i] = len(np.unique(hashes[e - c : e])) / c
            pairs[i] = len(np.unique(both[e - c : e - 1])) / (c - 1) if c > 1 else 1
            lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
            again[i] = 1 - len(set(lines)) / len(lines)
            short[i] = sum(len(x) < 20 for x in lines) / len(lines)
    words, letters = np.maximum(1, n), np.maximum(1, counts[:, 1] + counts[:, 2])
    cols = [counts[:, 1] / letters, counts[:, 3] / np.maximum(1, size), *(np.log1p(10 * counts[:, k] / words) for k in (4, 5, 6, 7, 8)), counts[:, 10] / np.maximum(1, size)]
    return np.column_stack([*cols, np.minimum(40, (size - counts[:, 8] - counts[:, 9]) / words), distinct, pairs, np.log1p(n), again, short])


def folds(id_col: Column) -> Column:
    """crc32 of the identifier as text, mod 3: 1 is held out, 0 fits the ridge and 2 the calibration."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        omega = rng.normal(size=(len(self.mean), FEATURES)) / math.sqrt(len(self.mean))
        shift = rng.uniform(0, 2 * math.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ omega + shift) * math.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if self.weights is not None else np.zeros(len(x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def _x(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, len(STATISTICS))


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres, values) of blocks of x (ascending, n rows each, y of them positive)."""
    blocks: list[list[float]] = []
    for centre, rows, good in zip(x, n, y, strict=True):
        blocks.append([centre * rows, rows, good])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(rows: DataFrame) -> Model:
    """rows: x (array of STATISTICS), y (0 or 1), fold (0 or 2). Without rows of both kinds the score is the share of 1, or 0.5."""
    k = len(STATISTICS)
    sums = rows.agg(F.count("*"), F.sum("y"), *(f(F.element_at("x", i + 1)) for f in (F.avg, F.stddev_pop) for i in range(k))).first()
    n, good = sums[0], sums[1] or 0
    if not n or good in (0, n):
        flat = good / n if n else 0.5
        return Model(np.zeros(k), np.ones(k), None, (np.zeros(1), np.array([flat])))
    scale = np.array(sums[2 + k :], float)
    model = Model(np.array(sums[2 : 2 + k], float), np.where(scale > 1e-9, scale, 1.0), None, (np.zeros(1), np.zeros(1)))
    size = FEATURES + 1
    upper = np.triu_indices(size)

    def equations(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(_x(batch))
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy()
        value = np.concatenate([a[upper], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value)], ["cell", "value"])

    two = [r["fold"] for r in rows.groupBy("fold").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect() if r["a"] != r["b"]]
    own = rows.filter(F.col("fold") == 0) if 0 in two else rows
    other = rows.filter(F.col("fold") == 2) if 2 in two else rows
    cells = {r[0]: r[1] for r in own.select("x", F.col("y").cast("double")).mapInArrow(equations, "cell bigint, value double").groupBy("cell").agg(F.sum("value")).collect()}  # size * (size + 3) / 2 rows
    value = np.array([cells[i] for i in range(len(cells))])
    a = np.zeros((size, size))
    a[upper] = value[: len(upper[0])]
    a = a + np.triu(a, 1).T
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) / FEATURES * np.eye(size), value[len(upper[0]) :])

    def binned(batches):
        for batch in batches:
            raw = np.clip((model.raw(_x(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], ["bin", "y"])

    bins = other.select("x", F.col("y").cast("double")).mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.count("*"), F.sum("y")).collect()  # BINS rows at most
    b, rows_, good_ = (np.array(c, float) for c in zip(*sorted(map(tuple, bins)), strict=True))
    model.steps = isotonic((b + 0.5) / BINS * 2 - 0.5, rows_, good_)
    return model


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of each document."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            offsets = pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])

    return docs.select(id_col, text_col).mapInArrow(run, "id bigint, x array<double>")


def training(x: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows to fit on: of labelled documents that aren't held out. A null label is none; each of several labels of a document counts."""
    y = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    return written(x.join(y.filter(folds(F.col("id")) != 1), "id").select("x", "y", folds(F.col("id")).alias("fold")), "quality-training")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    A null text counts as empty; an empty text is scored by its all-zero statistics. Repeated rows are scored each. Labels,
    identifiers and other columns are no inputs of a score. An empty table gives no rows.
    """
    x = written(measured(docs, id_col, text_col), "quality-statistics")
    model = fit(training(x, labels, "doc_id", label_col))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_x(b, 1)))], ["id", "score"])

    out = x.mapInArrow(run, "id bigint, score double")
    return out.select(F.col("id").alias(id_col), (folds(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns, that score 0.5 or more. The scan is filtered in place: texts aren't shuffled."""
    known = labels.select(F.col(id_col).alias("_id")).filter(folds(F.col("_id")) != 1).distinct()
    own = docs.select(F.col(id_col), F.col(text_col)).join(known, F.col(id_col) == F.col("_id"), "left_semi")
    model = fit(training(measured(own, id_col, text_col), labels, "doc_id", label_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.scores(statistics(b.column(at))) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
