"""Words of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of about so many bytes, cut between words.
BLOCK = 1 << 20
#: Bytes of text in one Arrow batch.
BATCH_BYTES = 4 << 20

_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(4096, _BASE))


def bounded_batches(spark) -> None:
    """Long texts must not pile up in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of all texts on end, and where each begins, with the end at last. Null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block_ends(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that cut no word: they end where a text or a blank begins."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # within one long text
                while to < offsets[k + 1] and not _BLANK[data[to]]:
                    to += 1
        yield at, to
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): a hash for each word of all texts in order, and the number of words in each text."""
    return word_spans(texts)[:2]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, starts, lengths, bytes): as word_hashes, and where in the bytes of all texts each word begins and how long it is."""
    data, offsets = bytes_of(texts)
    hashes, starts, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _block_ends(data, offsets):
        block = data[a:b]
        inside = np.flatnonzero(~_BLANK[block])
        if not len(inside):
            continue
        first = np.empty(len(inside), bool)
        first[0] = True
        first[1:] = np.diff(inside) > 1
        heads = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a  # texts that begin here
        k = np.searchsorted(inside, heads)
        k = k[k < len(inside)]
        first[k] = True  # a text's first word is a word of its own (for a text of blanks: the next text's first)
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(inside)))
        place = np.arange(len(inside)) - np.repeat(at, length)
        powers = _POWERS if (most := int(length.max())) <= len(_POWERS) else np.multiply.accumulate(np.full(most, _BASE))
        hashes.append(mixed(np.add.reduceat(_VALUE[block[inside]] * powers[place], at) + length.astype(np.uint64)))
        starts.append(inside[at] + a)
        lengths.append(length)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, offsets)), starts, np.concatenate(lengths), data
