"""Words by the bits of their bytes: hashed-context bit predictors, mixed online by gated weights and refined by an adaptive map.

A word is its bytes and a blank; the end of a text is a blank where a word would begin. A byte is a path through a code tree
over all 256 bytes, shorter for frequent ones, so a word's bits are 4 to 5 for each byte and the probabilities of all words
add up to one. A bit is predicted in several contexts: the one, two, three or four bytes before it in the word, and all of the
word so far, each a hash with the tree's node to a cell of counts of zeros and ones. The predictions are added up in the logistic
domain with weights gated by the place in the word and by how much the three bytes before it have been seen, and an adaptive
map from what comes out to what came true refines the sum. Weights and map learn online, block by block of words: in training
over all distinct words, and in a document (`online`), which begins with what training left, over its own words in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Cells of each hashed context as powers of two: one, two, three and four bytes, the word so far.
CELLS = (16, 18, 19, 20, 20)
OFFSETS = np.cumsum([0, *(1 << c for c in CELLS)])
#: Gates: places in a word by four, counts of the cell of three bytes by four. Inputs: a bias and the contexts.
PLACES, SEEN, INPUTS = 4, 4, len(CELLS) + 1
GATES = PLACES * SEEN
#: First weights; learning rate; steps of the adaptive map, its first confidence and its share of the result.
WEIGHTS, RATE, STEPS, CONFIDENCE, REFINED = (0.0, 0.0, 0.2, 0.3, 0.3, 0.2), 0.02, 24, 32.0, 0.5
#: Within a document: learning rate; words between two updates, an eighth of those before, at most MOST; documents that go on
#: together, which learn nothing from each other; bits of different words that are held expanded, beyond which they are per block.
ONLINE, MOST, TOGETHER, HELD = 0.002, 64, 128, 8_000_000
#: Words of one block of learning, of one block of scoring, and of one that is expanded; bits of a word that lie in one row.
BLOCK, SCORED, EXPANDED, LANES = 400, 4096, 1024, 8
#: Outcomes that a cell of the trained map counts as, at most.
TRAINED = 1023.0
#: Counts of the cell of three bytes at which the gate changes; the bias input; the byte that ends a word.
SEEN_AT, BIAS, BLANK = np.array([0.5, 3.5, 31.5]), 0.3, 32


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, nodes, bits) of each byte's path in the Huffman tree of counts + 1; nodes and bits have a row for each byte."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]  # weight, order of ties, tree
    heapq.heapify(heap)
    made = 256
    while len(heap) > 1:
        (x, _, left), (y, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (x + y, made, (made - 256, left, right)))
        made += 1
    length, paths = np.zeros(256, np.int64), [[]] * 256
    stack = [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[1], [*path, (node[0], 0)]), (node[2], [*path, (node[0], 1)])]
        else:
            length[node], paths[node] = len(path), path
    nodes, bits = np.zeros((256, length.max()), np.int64), np.zeros((256, length.max()), np.int64)
    for b, path in enumerate(paths):
        nodes[b, : len(path)], bits[b, : len(path)] = [n for n, _ in path], [x for _, x in path]
    return length, nodes, bits


_M = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


class Code:
    """The code tree's paths on end, with a hash of each node."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.length, nodes, bits = tree(counts)
        inside = np.arange(nodes.shape[1]) < self.length[:, None]
        self.first = np.cumsum(self.length) - self.length
        self.node, self.bit = nodes[inside].astype(np.uint32), bits[inside].astype(np.uint8)
        self.hash = (_spread(nodes[inside].astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Bits:
    """The bits of some words: where each word's bits begin, cells by context, place in the word, and value."""

    first: np.ndarray
    cells: list[np.ndarray]
    place: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, code: Code, data: np.ndarray, lens: np.ndarray) -> Bits:
        """data: the bytes of all words on end; lens: how many each has."""
        ends = np.cumsum(lens + 1)
        starts = ends - lens - 1
        line = np.full(int(ends[-1]) if len(ends) else 0, BLANK, np.uint8)
        line[np.arange(len(data)) + np.repeat(np.arange(len(lens)), lens)] = data
        place = np.arange(len(line)) - np.repeat(starts, lens + 1)
        before, orders = np.zeros(len(line), np.uint64), []
        for k in range(1, 5):
            back = np.zeros(len(line), np.uint64)
            back[k:] = line[:-k]
            back[place < k] = 0
            before |= back << np.uint64(8 * (k - 1))
            orders.append((_spread(before + np.uint64((1 << 40) * k)) >> np.uint64(32)).astype(np.uint32) if k > 1 else (before << np.uint64(8)).astype(np.uint32))
        # All of the word so far: a sum over its bytes, each with its place.
        each = _spread((line.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64) + np.uint64(1 << 50))
        sums = np.append(np.uint64(0), np.cumsum(each, dtype=np.uint64))
        orders.append((_spread(sums[:-1] - np.repeat(sums[starts], lens + 1) + place.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32))
        times = code.length[line]
        total = np.cumsum(times)
        path = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(code.first[line] - total + times, times)
        node = code.hash[path]
        cells = [np.repeat(orders[0], times) | code.node[path]]
        for k, c in enumerate(CELLS[1:], 1):
            h = np.repeat(orders[k], times)
            h ^= node
            h *= np.uint32(0x9E3779B1)
            cells.append((h >> np.uint32(32 - c)) + np.uint32(OFFSETS[k]))
        return cls(np.append(0, total)[starts], cells, np.repeat(np.minimum(place, PLACES - 1).astype(np.uint8), times), code.bit[path])


def counted(code: Code, data: np.ndarray, lens: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """How often each bit comes in each cell: at cell * 2 + bit. Adds to total, if there is one."""
    total = np.zeros(2 * OFFSETS[-1]) if total is None else total
    for _, words, part in blocks(data, lens, 4 * SCORED):
        b = Bits.of(code, part, words)
        for k, c in enumerate(b.cells):
            total[2 * OFFSETS[k] : 2 * OFFSETS[k + 1]] += np.bincount((c - np.uint32(OFFSETS[k])) * 2 + b.value, minlength=2 << CELLS[k])
    return total


def fitted(counts: np.ndarray) -> np.ndarray:
    """Counts by (cell, bit) in 16 bits, those of large cells in proportion."""
    counts = counts.reshape(-1, 2)
    return np.ceil(counts / np.maximum(1, counts.max(axis=1, keepdims=True) / 65535)).astype(np.uint16)


class Model:
    def __init__(self, code: Code, counts: np.ndarray, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        """counts: by (cell, bit), as `fitted` makes them."""
        self.code, self.counts = code, counts
        self.weights = np.tile(np.array(WEIGHTS, np.float32), (GATES, 1)) if weights is None else weights
        self.refined = np.zeros((GATES * STEPS, 2)) if refined is None else refined

    def coder(self):
        """A function that gives the cost of each of some Bits, from tables that are made once."""
        stretch = np.log((self.counts[:, 1] + np.float32(0.4)) / (self.counts[:, 0] + np.float32(0.4)))
        seen = SEEN_AT.searchsorted(self.counts[OFFSETS[2] : OFFSETS[3]].sum(axis=1, dtype=np.int64)).astype(np.uint8)
        told, weights = REFINED / (CONFIDENCE + self.refined[:, 0]), np.ascontiguousarray(self.weights.T, np.float32)
        bias = weights[0] * np.float32(BIAS)
        keep, add = (1 - REFINED + told * CONFIDENCE).astype(np.float32), (told * self.refined[:, 1]).astype(np.float32)

        def cost(b: Bits) -> np.ndarray:
            gate = b.place * np.uint8(SEEN) + seen[b.cells[2] - np.uint32(OFFSETS[2])]
            dot = bias[gate]
            for k, cell in enumerate(b.cells, 1):
                dot += weights[k][gate] * stretch[cell]
            p, step = refine(dot, gate)
            p = p * keep[step] + add[step]
            return -np.log2(np.where(b.value, p, 1 - p))

        return cost

    def costs(self, data: np.ndarray, lens: np.ndarray, cost=None) -> np.ndarray:
        """Bits of each word. cost: what `coder` gave, if it is at hand."""
        out, cost = np.zeros(len(lens)), cost or self.coder()
        for a, words, part in blocks(data, lens, SCORED):
            b = Bits.of(self.code, part, words)
            out[a : a + len(words)] = np.add.reduceat(cost(b), b.first, dtype=np.float64)
        return out

    def online(self, data: np.ndarray, lens: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bits of each token of some documents, whose weights and map go on learning from block to block of the document's tokens.
        data, lens: different words; places: which word each token is; counts: tokens of each document."""
        out, order, first = np.empty(len(places), np.float32), np.argsort(-counts, kind="stable"), np.cumsum(counts) - counts
        expand = Expanded(self)
        size, starts = expand.sizes(data, lens), np.cumsum(lens) - lens
        whole = expand.of(data, lens) if LANES * (-(-size // LANES)).sum() <= HELD else None
        own = GATES + 1  # gates of a document: the last one is that of idle lanes, which weighs and learns nothing
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            bias, *weights = np.tile(np.pad(self.weights.T, [(0, 0), (0, 1)]), len(some)).astype(np.float32)
            bias *= np.float32(BIAS)
            refined = np.pad(self.refined, [(0, STEPS), (0, 0)])
            refined[:, 0] -= refined[:, 1]
            told = np.tile(refined.ravel(), len(some)).astype(np.float32)  # outcomes 0 and 1 of each cell of the map
            for live, doc, _, token in block_by_block(counts[some], first[some], MOST):
                word, lines = places[token], whole
                if lines is None:
                    distinct, word = np.unique(word, return_inverse=True)
                    lines = expand.of(data[spread(starts[distinct], lens[distinct])], lens[distinct])
                n = lines.n[word]
                row, cell = spread(lines.first[word], n), np.repeat(doc * own, n * LANES)
                kind, x = lines.kind.take(row, axis=0).ravel(), [c.take(row, axis=0).ravel() for c in lines.x]
                cell += kind >> 1
                bit = kind & 1
                dot = bias.take(cell)
                for w, c in zip(weights, x, strict=True):
                    more = w.take(cell)
                    more *= c
                    dot += more
                p, step = refine(dot, cell)
                pair = told.view(np.complex64).take(step)
                q = p * np.float32(CONFIDENCE)
                q += pair.imag
                q /= pair.real + pair.imag + np.float32(CONFIDENCE)
                q -= p
                q *= np.float32(REFINED)
                q += p
                q += bit
                q -= 1  # what came true has q, or 1 - q: its size either way
                out[token] = -np.add.reduceat(np.log2(np.abs(q, out=q), out=q), LANES * (np.cumsum(n) - n)) - lines.idle[word]  # an idle lane has one bit
                wrong, cells = np.subtract(bit, p, out=p), live * own
                rate = ONLINE / (1 + np.bincount(cell, minlength=cells) / 128)
                rate[GATES::own] = 0
                bias[:cells] += rate * np.bincount(cell, wrong, cells) * BIAS**2
                for w, c in zip(weights, x, strict=True):
                    c *= wrong
                    w[:cells] += rate * np.bincount(cell, c, cells)
                step *= 2
                step += bit
                np.add.at(told, step, np.float32(1))
                told.reshape(len(some), own, -1)[:live, GATES] = 0
        return out

    def learnt(self, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """What going once through training words teaches: visits of gates, weights times visits, and the map's new outcomes. The
        cells are those without the word at hand, as it will be for new words."""
        weights, refined, visits = self.weights.T.astype(np.float64), self.refined.copy(), np.zeros(GATES)
        both = np.ascontiguousarray(self.counts).view("<u4").ravel()  # zeros low, ones high: one look-up
        for _, words, part in blocks(data, lens, BLOCK):
            b = Bits.of(self.code, part, words)
            bit, now = b.value.astype(np.int32), weights.astype(np.float32)
            x, less = [np.full(len(bit), BIAS, np.float32)], 1 - bit
            for k, cell in enumerate(b.cells, 1):
                found = both[cell]
                zero, one = np.maximum(0, (found & np.uint32(0xFFFF)).astype(np.int32) - less), np.maximum(0, (found >> np.uint32(16)).astype(np.int32) - bit)
                x.append(np.log((one + np.float32(0.4)) / (zero + np.float32(0.4)), dtype=np.float32))
                if k == 3:
                    gate = b.place * np.uint8(SEEN) + SEEN_AT.searchsorted(zero + one).astype(np.uint8)
            p, step = refine(sum(now[k][gate] * x[k] for k in range(INPUTS)), gate)
            n = np.bincount(gate, minlength=GATES)
            wrong = (b.value - p) * (RATE / (1 + n / 128))[gate]
            for k in range(INPUTS):
                weights[k] += np.bincount(gate, wrong * x[k], GATES)
            visits += n
            refined[:, 0] += np.bincount(step, minlength=GATES * STEPS)
            refined[:, 1] += np.bincount(step, b.value, GATES * STEPS)
        return np.concatenate([visits, (weights.T * visits[:, None]).ravel(), (refined - self.refined).ravel()])

    def after(self, sums: np.ndarray) -> Model:
        """The model that sums of `learnt` over all training words make."""
        visits, weights, refined = np.split(sums, [GATES, GATES * (1 + INPUTS)])
        weights, refined = weights.reshape(GATES, INPUTS), refined.reshape(-1, 2)
        weights = np.where(visits[:, None] > 0, weights / np.maximum(visits, 1)[:, None], self.weights).astype(np.float32)
        return Model(self.code, self.counts, weights, refined * np.minimum(1, TRAINED / np.maximum(refined[:, :1], 1)))


class Expanded:
    """What the bits of different words bring to the mixing, in rows of LANES, so that a word is few and whole rows: of each word its
    first row and how many, and its idle lanes, in the last one; of each lane the contexts' predictions in the logistic domain, and twice
    its gate plus its value. An idle lane has a gate of its own and no predictions."""

    def __init__(self, model: Model):
        self.code = model.code
        self.stretch = np.log((model.counts[:, 1] + np.float32(0.4)) / (model.counts[:, 0] + np.float32(0.4)))
        self.seen = SEEN_AT.searchsorted(model.counts[OFFSETS[2] : OFFSETS[3]].sum(axis=1, dtype=np.int64)).astype(np.uint8)

    def sizes(self, data: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """How many bits each word has."""
        total, ends = np.append(0, np.cumsum(self.code.length[data])), np.cumsum(lens)
        return total[ends] - total[ends - lens] + self.code.length[BLANK]

    def of(self, data: np.ndarray, lens: np.ndarray) -> Expanded:
        out, size = object.__new__(Expanded), self.sizes(data, lens)
        out.n = -(-size // LANES)
        out.first, out.idle = np.cumsum(out.n) - out.n, (out.n * LANES - size).astype(np.float32)
        total = int(out.n.sum())
        out.x, out.kind = np.zeros((len(CELLS), total, LANES), np.float32), np.full((total, LANES), 2 * GATES, np.uint8)
        x, kind = out.x.reshape(len(CELLS), -1), out.kind.ravel()
        for a, words, part in blocks(data, lens, EXPANDED):
            b, some = Bits.of(self.code, part, words), slice(a, a + len(words))
            at = spread(out.first[some] * LANES, size[some])
            for own, cell in zip(x, b.cells, strict=True):
                own[at] = self.stretch.take(cell)
            kind[at] = (b.place * np.uint8(SEEN) + self.seen.take(b.cells[2] - np.uint32(OFFSETS[2]))) * np.uint8(2) + b.value
        return out


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, and so on, n of each, on end."""
    out = np.repeat(first - np.cumsum(n) + n, n)
    out += np.arange(len(out))
    return out


def block_by_block(counts: np.ndarray, first: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of documents from the longest on, with their numbers of tokens and first tokens: (documents that go on, and of each token of
    the block its document, its place there, and itself). A block has an eighth of the tokens before, at most `most`."""
    at = block = 0
    while (at := at + block) < (int(counts[0]) if len(counts) else 0):
        block = max(1, min(most, at // 8))
        live = int(np.searchsorted(-counts, -at, "left"))
        take = np.minimum(block, counts[:live] - at)
        yield live, np.repeat(np.arange(live), take), spread(np.full(live, at), take), spread(first[:live] + at, take)


class Memo:
    """Costs of words that a worker has priced, by their 64-bit hashes: the same words come in group after group, and a model gives a
    word the same cost each time. It holds up to `most` words, and starts anew beyond; what it doesn't hold is priced again."""

    def __init__(self, most: int):
        self.most, self.keys, self.costs = most, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def of(self, keys: np.ndarray, price) -> np.ndarray:
        """The cost of each of some different words. price: gives the costs of those that a mask marks."""
        out, at = np.empty(len(keys), np.float32), np.searchsorted(self.keys, keys)
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == keys[held]
        out[held] = self.costs[at[held]]
        out[~held] = price(~held)
        if len(self.keys) + np.count_nonzero(~held) > self.most:
            self.keys, self.costs, at, held = self.keys[:0], self.costs[:0], np.zeros_like(at), np.zeros_like(held)
        order = np.flatnonzero(~held)
        order = order[np.argsort(keys[order])][: self.most]
        self.keys, self.costs = np.insert(self.keys, at[order], keys[order]), np.insert(self.costs, at[order], out[order])
        return out


def refine(dot: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of bit 1, cell of the adaptive map) of sums in the logistic domain."""
    dot = np.clip(dot, -11.5, 11.5)
    step = gate.astype(np.intp)
    step *= STEPS
    step += ((dot + 12) * (STEPS / 24)).astype(np.int32)
    p = np.exp(np.negative(dot, out=dot), out=dot)
    p += 1
    return np.divide(1, p, out=p), step


def blocks(data: np.ndarray, lens: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first word, lens, bytes) of some words at a time: `words` of them, or as many as have 16 bytes each."""
    ends = np.cumsum(lens)
    a = 0
    while a < len(lens):
        at = int(ends[a] - lens[a])
        b = min(a + words, max(a + 1, int(np.searchsorted(ends, at + 16 * words, "right"))))
        yield a, lens[a:b], data[at : int(ends[b - 1])]
        a = b
