"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each a node of a 255-node tree under the
context of the bytes before it. Every context has a Krichevsky-Trofimov estimate
for each node, and context-tree weighting mixes the estimates of all depths: a
context's weighted probability is half its own estimate and half the product of
its children's. The counts of all training texts decide, so after training the
mixture at a node is a fixed probability, and a text's score is a sum over its
bytes. Texts begin with bytes 0xFF, which UTF-8 never uses, and end with one;
the score is thus a proper code length of the whole text.

The tree holds every context of up to TOP + 1 bytes that was seen, and every
context of up to DEPTH bytes that was seen at least LEAST times; what a
context's other children hold is one child more, which they have in common. It
grows with the corpus and is never in one place:

- One pass counts words and pairs (the DEPTH bytes before a symbol, the symbol).
  Each task combines what it has counted, and passes pairs on as packed arrays by
  their newest TOP + 1 bytes. All shallower counts are sums of these.
- The arrays are dealt by these bytes, so a task merges, and sees, whole subtrees. It
  weighs them from the deepest contexts up, and each pair gets what its subtree
  says of its symbol's eight bits. Pairs that are only asked for have count 0.
- The TOP levels above (at most 256**TOP contexts) are weighed from the sums of
  the subtrees' weights, and are broadcast.
- Every pair then has one log probability. The GRAM_HEAD most frequent are
  broadcast, as are the HEAD most frequent words; the occurrences of all others are
  joined in Spark. The result does not depend on either.

Model.tree is a tree of bounded size over the same texts, for use without Spark;
score() does not read it.

Results in edge cases: a null or empty text has one token (the end); rows with
a null id are training rows; repeated rows count and are scored each time; with
no training rows every bit costs one bit; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, held_out, slices, stored, text_bytes

#: Words whose counts are broadcast. The rest is joined; the result does not depend on it.
HEAD = 200_000
#: Distinct words or triples that a training task holds before it passes their counts on.
HELD = 400_000
#: The longest contexts; from which length on a context must be seen LEAST times; and the levels that are broadcast.
DEPTH, LEAST, TOP = 6, 2, 2
#: Pairs whose scores are broadcast, those that a training task holds, and those that are weighed at once.
GRAM_HEAD, GRAMS_HELD, WEIGHED = 2_000_000, 1_000_000, 300_000
#: Pairs that a task holds before it merges them.
UNMERGED = 1_000_000
#: In Model.tree: share of all training bytes that a context of three or four bytes must hold.
SHARE = 1 / 32_768
#: Bytes of text that a task works on at once: each takes some 60 bytes of arrays.
STEP = 1_000_000
#: Kinds of counted rows; pairs with counts of one byte, and of eight.
WORD, TRIPLE, TEXTS, FOUR, FIVE, GRAMS, FREQUENT = 0, 1, 2, 3, 4, 5, 6
END, PAD = b"\xff", 4

_SYMBOLS = np.arange(256)
#: By level: the node that a symbol passes, and the bit it takes there.
_NODE = np.stack([(1 << k) - 1 + (_SYMBOLS >> (8 - k)) for k in range(8)])
_BIT = np.stack([_SYMBOLS >> (7 - k) & 1 for k in range(8)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of a half or more: Stirling's series at x + 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 nodes, from counts by symbol in the last axis."""
    levels = [counts.reshape(*counts.shape[:-1], 1 << k, 256 >> k).sum(-1) for k in range(9)]
    return np.concatenate([x[..., 0::2] for x in levels[1:]], -1), np.concatenate([x[..., 1::2] for x in levels[1:]], -1)


class _Node:
    """A context: its counts by symbol, and its children by the next older byte. What no child holds is the last child, `rest`."""

    def __init__(self, counts: np.ndarray, kids: dict[int, _Node]) -> None:
        zeros, ones = _nodes(counts)
        self.kids, own = kids, (ones + 0.5) / (zeros + ones + 1)
        log = _log_kt(zeros, ones)
        if not kids:
            self.weight, self.ones = log, own[None]
            return
        self.rest = _Node(counts - sum(k.counts for k in kids.values()), {})
        below = [*kids.values(), self.rest]
        half = np.log(0.5)
        self.weight = half + np.logaddexp(log, sum(k.weight for k in below))
        stop = np.exp(half + log - self.weight)
        self.ones = stop * own + (1 - stop) * np.concatenate([k.ones for k in below])

    counts: np.ndarray


def _grown(counts: np.ndarray, kids: dict[int, _Node]) -> _Node:
    node = _Node(counts, kids)
    node.counts = counts
    return node


@dataclass
class ByteTree:
    """table: log10 probability by symbol, in a row for each deepest context. child: where a byte leads from an inner context: to a row, or, as -1 - k, to the inner context k. start: the same for the two bytes before the symbol."""

    start: np.ndarray
    child: np.ndarray
    table: np.ndarray

    @classmethod
    def trained(cls, codes: np.ndarray, counts: np.ndarray, deeper: tuple[tuple[np.ndarray, np.ndarray], ...] = ()) -> ByteTree:
        """From byte triples (oldest byte in the highest place) and how often each was seen; and of each deeper level the same for the contexts that are in the tree."""
        levels = [(codes, counts), *deeper]
        spelled: list[dict[int, np.ndarray]] = []
        for own, n in levels:  # context -> counts by symbol
            order = np.argsort(own, kind="stable")
            own, n = own[order], n[order]
            context = own >> 8
            cut = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(own) else np.zeros(0, np.int64)
            found = {}
            for a, b in zip(cut.tolist(), np.r_[cut[1:], len(own)].tolist() if len(cut) else [], strict=True):
                row = np.zeros(256)
                row[own[a:b] & 255] = n[a:b]
                found[int(context[a])] = row
            spelled.append(found)
        grown: dict[int, _Node] = {}
        for depth in range(len(levels) + 1, 1, -1):  # longest contexts first
            below: dict[int, dict[int, _Node]] = {}
            for context, node in grown.items():
                below.setdefault(context & (1 << 8 * depth) - 1, {})[context >> 8 * depth] = node
            grown = {c: _grown(row, below.get(c, {})) for c, row in spelled[depth - 2].items()}
        for depth in (1, 0):
            below = {}
            for context, node in grown.items():
                below.setdefault(context & (1 << 8 * depth) - 1, {})[context >> 8 * depth] = node
            grown = {c: _grown(sum(k.counts for k in kids.values()), kids) for c, kids in below.items()}
        root = grown.get(0) or _grown(np.zeros(256), {})
        log = np.log10(np.stack([1 - root.ones, root.ones], -1))
        table = sum(log[:, _NODE[k], _BIT[k]] for k in range(8)).astype(np.float32)
        child: list[np.ndarray] = []

        def place(node: _Node, row: int) -> tuple[int, int]:
            """Where a node is found, and the first row behind its own."""
            if not node.kids:
                return row, row + 1
            own = len(child)
            child.append(np.zeros(256, np.int32))
            to = {}
            for byte, kid in node.kids.items():
                to[byte], row = place(kid, row)
            child[own][:] = row
            for byte, at in to.items():
                child[own][byte] = at
            return -1 - own, row + 1

        first, _ = place(root, 0)
        links = np.array(child, np.int32).reshape(-1, 256)
        start = np.full(65536, first, np.int32)
        pair = np.arange(65536)
        for byte in (pair & 255, pair >> 8):
            inner = start < 0
            start[inner] = links[-1 - start[inner], byte[inner]]
        return cls(start, links, table)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        if not texts:
            return np.zeros(0)
        data = np.frombuffer(b"".join(END * PAD + t + END for t in texts), np.uint8)
        first = np.cumsum([0, *(len(t) + PAD + 1 for t in texts[:-1])])
        at = self.start[data[PAD - 2 : -2].astype(np.int32) << 8 | data[PAD - 1 : -1]]
        for back in range(3, PAD + 1):
            inner = np.flatnonzero(at < 0)
            if len(inner):
                at[inner] = self.child[-1 - at[inner], data[inner + PAD - back]]
        log = np.zeros(len(data))
        log[PAD:] = self.table[at, data[PAD:]]
        for k in range(PAD):
            log[first + k] = 0
        return np.add.reduceat(log, first)


def grams(texts: list[bytes], length: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte strings of a length that end at a symbol of a text or at its end, as numbers, and their counts. wanted: by byte triple, whether it is a context of the tree; only strings whose contexts of three bytes all are count."""
    data = np.frombuffer(b"".join(END * PAD + t + END for t in texts), np.uint8).astype(np.uint64)
    n = len(data)
    codes = np.zeros(n - PAD, np.uint64)
    for k in range(length):  # data[i - length + 1 .. i] for each i from PAD on
        codes = codes << np.uint64(8) | data[PAD - length + 1 + k : n - length + 1 + k]
    keep = np.ones(len(codes), bool)
    first = np.cumsum([len(t) + PAD + 1 for t in texts[:-1]]).astype(np.int64)
    for k in range(PAD):  # the padding of later texts is no symbol
        keep[first - PAD + k] = False
    if wanted is not None:
        for k in range(1, length - 2):
            keep &= wanted[(codes >> np.uint64(8 * k)).astype(np.int64) & 0xFFFFFF]
    return np.unique(codes[keep], return_counts=True)


def pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text and for its end: the DEPTH bytes before it, the newest in the highest place, and the symbol, as a number; and which text it is in."""
    data = np.frombuffer(b"".join(END * DEPTH + t + END for t in texts), np.uint8)
    n = len(data)
    keys = np.zeros(n - DEPTH, np.int64)
    for back in [*range(1, DEPTH + 1), 0]:
        keys <<= 8
        keys |= data[DEPTH - back : n - back]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + DEPTH + 1)[:-1]
    keep = np.ones(len(keys), bool)
    for k in range(DEPTH):  # the padding of later texts is no symbol
        keep[first - DEPTH + k] = False
    return keys[keep], np.repeat(np.arange(len(texts)), sizes + 1)


def subtrees(key: np.ndarray, n: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From pairs in their order, of whole subtrees below TOP bytes, and how often each was seen: the probability that a pair's subtree gives each of its symbol's bits; and the sum of the subtrees' weights at each node (the TOP bytes, then the node) and these nodes."""
    code, count, at = key, n.astype(np.float64), np.arange(len(key))
    given = np.full((8, len(key)), 0.5)
    own_bits = _BIT[:, key & 255].astype(bool)
    inside = np.zeros(len(key), bool)  # by pair: whether its context of the level below is in the tree
    lower: list[tuple[np.ndarray, ...]] = []
    half = np.log(0.5)
    for depth in range(DEPTH, TOP, -1):
        up = np.zeros(0, np.int64)
        if depth < DEPTH:
            code, up = np.unique(code >> 16 << 8 | code & 255, return_inverse=True)
            count, at = np.bincount(up, count, len(code)), up[at]
        symbol, level, held = code & 255, [], np.ones(len(code), bool)
        for k in range(8):
            group = code >> (8 - k)
            new = np.r_[True, group[1:] != group[:-1]]
            run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            total, ones = np.add.reduceat(count, starts), np.add.reduceat(count * _BIT[k, symbol], starts)
            if k == 0 and depth > TOP + 1:
                held = (total >= least)[run]
            zeros = total - ones
            rest_zeros, rest_ones, weight = zeros, ones, 0.0
            log = rest_log = _log_kt(zeros, ones)
            if lower:
                of, kid_zeros, kid_ones, kid_weight, kid_held = lower[k]
                to = run[up[of[kid_held]]]
                rest_zeros = zeros - np.bincount(to, kid_zeros[kid_held], len(starts))
                rest_ones = ones - np.bincount(to, kid_ones[kid_held], len(starts))
                rest_log, weight = _log_kt(rest_zeros, rest_ones), np.bincount(to, kid_weight[kid_held], len(starts))
            weight = half + np.logaddexp(log, weight + rest_log)
            stop = np.exp(half + log - weight)
            own, rest = (ones + 0.5) / (total + 1), (rest_ones + 0.5) / (rest_zeros + rest_ones + 1)
            mine = run[at]
            rest = np.where(own_bits[k], rest[mine], 1 - rest[mine])
            own = np.where(own_bits[k], own[mine], 1 - own[mine])
            given[k] = stop[mine] * own + (1 - stop[mine]) * np.where(inside, given[k], rest)
            level.append((starts, zeros, ones, weight, held[starts]))
        lower, inside = level, held[at]
    nodes = np.concatenate([code[x[0]] >> 16 << 8 | _NODE[k, code[x[0]] & 255] for k, x in enumerate(lower)])
    nodes, where = np.unique(nodes, return_inverse=True)
    return given, nodes, np.bincount(where, np.concatenate([x[3] for x in lower]), len(nodes))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs come by subtree, in ascending order; a subtree that goes on in the next batch waits for it."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    width = 8 * (DEPTH - TOP)

    def found(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        given, nodes, weights = subtrees(key, n)
        raw = np.ascontiguousarray(given.T, np.float32)
        bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(key), [None, pa.py_buffer(raw)]).cast(pa.binary())
        names = ["key", "n", "bits", "weight"]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), bits, pa.nulls(len(key), pa.float64())], names)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.binary()), pa.array(weights)], names)

    def whole(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """At most about WEIGHED pairs at a time, but never less than a subtree."""
        first = np.flatnonzero(np.r_[True, key[1:] >> width != key[:-1] >> width]) if len(key) else np.zeros(0, np.int64)
        at = 0
        while at < len(key):
            stop = int(first[k]) if (k := int(np.searchsorted(first, at + WEIGHED))) < len(first) else len(key)
            yield from found(key[at:stop], n[at:stop])
            at = stop

    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(_unpacked(batch))
        if sum(len(k) for k, _ in parts) > UNMERGED:
            key, n = _merged(parts)
            last = int(np.searchsorted(key, (key[-1] >> width) << width))
            yield from whole(key[:last], n[:last])
            parts = [(key[last:], n[last:])]
    if parts:
        yield from whole(*_merged(parts))


@dataclass
class Top:
    """The levels of up to TOP = 2 bytes. row: of the two bytes before a symbol, the newer one higher. zero, one: by node, the probability of either bit so far; left: the part that the subtree decides. None is what the others leave of 1: a bit that was never seen in 10**8 has less than single precision holds beside 1."""

    row: np.ndarray
    zero: np.ndarray
    one: np.ndarray
    left: np.ndarray

    @classmethod
    def trained(cls, codes: np.ndarray, counts: np.ndarray, nodes: np.ndarray, weights: np.ndarray) -> Top:
        contexts, at = np.unique(codes >> 8, return_inverse=True)
        table = np.zeros((len(contexts), 256))
        table[at, codes & 255] = counts
        below = np.zeros((len(contexts), 255))
        below[np.searchsorted(contexts, nodes >> 8), nodes & 255] = weights
        half, levels, rows = np.log(0.5), [], np.arange(len(contexts))
        for _ in range(TOP + 1):
            zeros, ones = _nodes(table)
            log = _log_kt(zeros, ones)
            weight = half + np.logaddexp(log, below)
            levels.append(((zeros + 0.5) / (zeros + ones + 1), (ones + 0.5) / (zeros + ones + 1), np.exp(half + log - weight), rows))
            contexts, up = np.unique(contexts >> 8, return_inverse=True)
            rows = up[rows]
            table, below = (_summed(x, up, len(contexts)) for x in (table, weight))
        zero, one, left = 0.0, 0.0, 1.0
        for own_zero, own_one, stop, of in reversed(levels):
            zero = zero + left * (stop * own_zero)[of]
            one = one + left * (stop * own_one)[of]
            left = left * (1 - stop)[of]
        row = np.zeros(65536, np.int32)
        row[np.unique(codes >> 8)] = np.arange(len(left))
        return cls(row, zero.astype(np.float32), one.astype(np.float32), left.astype(np.float32))

    def logs(self, key: np.ndarray, given: np.ndarray) -> np.ndarray:
        """log10 probability of each pair's symbol; given: by pair and bit, the probability that its subtree gives the bit."""
        row, symbol = self.row[key >> 8 * (DEPTH + 1 - TOP)], key & 255
        log = np.zeros(len(key))
        for k in range(8):
            node = row, _NODE[k, symbol]
            above = np.where(_BIT[k, symbol] == 1, self.one[node], self.zero[node]).astype(np.float64)
            log += np.log10(above + self.left[node].astype(np.float64) * given[:, k])
        return log


def _summed(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]))
    np.add.at(out, to, rows)
    return out


def _gram_keys(keys: np.ndarray) -> pa.Array:
    """Pairs as keys of the join: eight bytes, of which the first is in no word."""
    raw = (keys | -2 << 56).astype(">i8")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(raw)]).cast(pa.binary())


def triples(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return grams(texts, 3)


COUNTED = "kind int, key binary, n long, subtree int, counts binary"
_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


def _rows(kind: int, keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _NAMES)


def _packed(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs in ascending order and their counts, as a row of arrays for each subtree: what is below the subtree in 32 bits, and counts in one byte where they fit."""
    for kind, own, width in ((GRAMS, counts < 256, np.uint8), (FREQUENT, counts >= 256, np.int64)):
        code, count = codes[own], counts[own].astype(width)
        if not len(code):
            continue
        tree = (code >> 32).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        n, ends = len(starts), np.r_[starts, len(code)]
        column = lambda x, n=n, ends=ends: pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), column(code.astype(np.uint32)), pa.nulls(n, pa.int64()), pa.array(tree[starts]), column(count)], _NAMES)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and counts of rows (kind, subtree, key, counts)."""
    codes, counts = [], []
    for kind, width in ((GRAMS, np.uint8), (FREQUENT, np.int64)):
        rows = batch.filter(pa.compute.equal(batch.column(0), kind))
        if rows.num_rows:
            low, count = (np.frombuffer(b"".join(rows.column(k).to_pylist()), t) for k, t in ((2, np.uint32), (3, width)))
            sizes = np.asarray(pa.compute.binary_length(rows.column(2))) // 4
            codes.append(np.repeat(np.asarray(rows.column(1)).astype(np.int64) << 32, sizes) | low)
            counts.append(count.astype(np.int64))
    return np.concatenate(codes), np.concatenate(counts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and the sums of their counts. Runs that are in order are merged, not sorted anew."""
    codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts[order], first)


class _Counts:
    """Counts of byte strings in a task: merged now and then, and passed on where there are many."""

    def __init__(self, kind: int, length: int, most: int = HELD) -> None:
        self.kind, self.length, self.most, self.parts, self.held = kind, length, most, [], 0

    def add(self, found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(found)
        self.held += len(found[0])
        if self.held > 2 * self.most:
            self._merge()
            if self.held > self.most:
                yield from self.flush()

    def _merge(self) -> None:
        self.parts = [_merged(self.parts)]
        self.held = len(self.parts[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            codes, counts = self.parts.pop()
            self.held = 0
            if self.kind == GRAMS:
                yield from _packed(codes, counts)
                return
            raw = codes.astype(">u8").tobytes()
            yield _rows(self.kind, [raw[k - self.length : k] for k in range(8, len(raw) + 1, 8)], counts.tolist())


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, pairs and number of the texts that are learned from; of the others only the pairs, with count 0."""
    words: Counter[bytes] = Counter()
    found = _Counts(GRAMS, DEPTH + 1, GRAMS_HELD)
    texts_seen = 0
    for batch in slices(batches, "text", STEP):
        texts = [t.lower() for t in batch.column(0).to_pylist()]
        learned = np.asarray(batch.column(1).to_pylist(), bool)
        own = [t for t, yes in zip(texts, learned.tolist(), strict=True) if yes]
        texts_seen += len(own)
        for t in own:
            words.update(t.split())
            if len(words) > HELD:
                yield _rows(WORD, list(words), list(words.values()))
                words.clear()
        if own:
            yield from found.add(np.unique(pairs(own)[0], return_counts=True))
        asked = [t for t, yes in zip(texts, learned.tolist(), strict=True) if not yes]
        if asked:
            codes = np.unique(pairs(asked)[0])
            yield from found.add((codes, np.zeros(len(codes), np.int64)))
    if words:
        yield _rows(WORD, list(words), list(words.values()))
    yield from found.flush()
    if texts_seen:
        yield _rows(TEXTS, [b""], [texts_seen])


def _train_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Counts(TRIPLE, 3)
    for batch in slices(batches, "text", STEP):
        yield from found.add(triples([t.lower() for t in batch.column(0).to_pylist()]))
    yield from found.flush()


def _train_deeper(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What follows contexts of three and four bytes whose triples are all frequent."""
        wanted = np.zeros(1 << 24, bool)
        wanted[frequent] = True
        four, five = _Counts(FOUR, 4), _Counts(FIVE, 5)
        for batch in slices(batches, "text", STEP):
            texts = [t.lower() for t in batch.column(0).to_pylist()]
            yield from four.add(grams(texts, 4, wanted))
            yield from five.add(grams(texts, 5, wanted))
        yield from four.flush()
        yield from five.flush()

    return run


@dataclass
class Model:
    """words: (kind, key, n) of all words. grams: (kind, subtree, key, counts) of all pairs, packed."""

    words: DataFrame
    grams: DataFrame
    head: dict[bytes, float]
    n: int
    v: int
    texts: int
    source: DataFrame
    share: float

    @cached_property
    def tree(self) -> ByteTree:
        """The tree of at most 256**2 + 2 / share contexts."""
        count = lambda run: self.source.mapInArrow(run, COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"))
        codes, n = _collected(count(_train_triples))  # at most 256**3 rows
        least = max(2, int(np.ceil(n.sum() * self.share)))
        frequent = codes[n >= least]  # at most 1 / share
        deep = stored(count(_train_deeper(frequent)).withColumn("context", F.expr("substring(key, 1, length(key) - 1)")), "deep")
        held = deep.groupBy("kind", "context").agg(F.sum("n").alias("held")).where(F.col("held") >= least)
        kept = deep.join(held, ["kind", "context"], "left_semi")  # at most 256 / share rows of either kind
        four, five = (_collected(kept.where(F.col("kind") == k)) for k in (FOUR, FIVE))
        whole = np.isin(five[0] >> 8 & 0xFFFFFF, four[0] >> 8)  # a context is in the tree only if the one below it is
        return ByteTree.trained(codes, n, (four, (five[0][whole], five[1][whole])))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = counts.select(F.conv(F.hex("key"), 16, 10).cast("long").alias("code"), "n").toArrow()
    return np.asarray(rows["code"]).astype(np.int64), np.asarray(rows["n"]).astype(np.int64)


def _counted(texts: DataFrame, text: str, learned: F.Column) -> tuple[DataFrame, DataFrame]:
    """Tables of words and texts (kind, key, n), and of packed pairs (kind, subtree, key, counts)."""
    source = bounded(texts).select(text_bytes(text).alias("text"), learned.alias("learned"))
    raw = stored(source.mapInArrow(_train, COUNTED), "raw")
    words = stored(raw.where(F.col("subtree").isNull()).groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")
    return words, raw.where(F.col("subtree").isNotNull()).select("kind", "subtree", "key", "counts")


def _least_class(counts: DataFrame, most: int) -> int:
    """The least class of counts such that all of it and above are at most `most` rows. There are some 4096 classes at most: no task sorts the rows of all others."""
    least, taken = 1 << 62, 0
    for row in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        taken += row["count"]
        if taken > most:
            break
        least = row["class"]
    return least


def _class() -> F.Column:
    return F.floor(F.log2(F.col("n") + 1) * 64).alias("class")


def train(texts: DataFrame, text: str = "text", head: int = HEAD, share: float = SHARE, learned: F.Column | None = None) -> Model:
    """Count all words and pairs of the texts, or of those that are `learned` from; the pairs of the others are known to be asked for."""
    learned = F.lit(True) if learned is None else learned
    counts, grams = _counted(texts, text, learned)
    totals = counts.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()
    by = {r.kind: r for r in totals}
    ends = by[TEXTS].n if TEXTS in by else 0
    known = by[WORD] if WORD in by else None
    words = counts.where(F.col("kind") == WORD).select("key", "n", _class())
    top = words.where(F.col("class") >= _least_class(words, head)).select("key", "n").toArrow()
    logs = np.log10(np.asarray(top["n"]) + 1.0).tolist()
    source = bounded(texts).where(learned).select(text_bytes(text).alias("text"))
    return Model(counts, grams, dict(zip(top["key"].to_pylist(), logs, strict=True)), (known.n if known else 0) + ends, (known["keys"] if known else 0) + bool(ends), ends, source, share)


def weighed(grams: DataFrame) -> DataFrame:
    """(key, n, log) for each of the packed pairs (kind, subtree, key, counts): its log10 probability."""
    width = 8 * (DEPTH - TOP)
    dealt = grams.repartition("subtree").sortWithinPartitions("subtree")
    deep = stored(dealt.mapInArrow(_weigh, "key long, n long, bits binary, weight double"), "deep")
    code = F.shiftleft(F.shiftright("key", width + 8), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    few = deep.where("bits is not null").groupBy(code.alias("code")).agg(F.sum("n").alias("n")).toArrow()  # at most 256**3 rows
    sums = deep.where("bits is null").groupBy("key").agg(F.sum("weight").alias("weight")).toArrow()  # at most 255 * 256**2 rows
    of = lambda t, c, kind: np.asarray(t[c]).astype(kind)
    top = Top.trained(of(few, "code", np.int64), of(few, "n", np.float64), of(sums, "key", np.int64), of(sums, "weight", np.float64))
    shared = grams.sparkSession.sparkContext.broadcast((top.row, top.zero, top.one, top.left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Top(*shared.value)
        for batch in batches:
            if batch.num_rows:
                key = np.asarray(batch.column(0))
                given = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top.logs(key, given).astype(np.float32))], ["key", "n", "log"])

    found = stored(deep.where("bits is not null").select("key", "n", "bits").mapInArrow(run, "key long, n long, log float"), "logs")
    discard(deep)
    return found


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_gram_keys(np.asarray(batch.column(0))), pa.nulls(batch.num_rows, pa.int64()), batch.column(1)], ["word", "c", "log"])


SCORED = "row long, doc_id long, held_out boolean, word binary, n long, n_words long, head_known long, head_log double, head_score double, n_bytes long"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", gram_head: int = GRAM_HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of docs."""
    asked = _counted(docs, text, F.lit(False))[1]
    return _scored(docs, model, weighed(model.grams.unionByName(asked)), doc_id, text, gram_head)


def _scored(docs: DataFrame, model: Model, logs: DataFrame, doc_id: str, text: str, gram_head: int) -> DataFrame:
    """logs: (key, n, log) of all pairs of docs."""
    classes = logs.select("key", "log", _class())
    least = _least_class(classes, gram_head)
    top = classes.where(F.col("class") >= least).select("key", "log").toArrow()
    keys = np.asarray(top["key"]).astype(np.int64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], np.asarray(top["log"]).astype(np.float32)[order], model.head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, frequent_logs, head = shared.value
        get = head.get
        for batch in slices(batches, "text", STEP):
            texts = [t.lower() for t in batch.column(3).to_pylist()]
            lists = [t.split() for t in texts]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            words = [w for x in lists for w in x]
            logs = np.fromiter(map(get, words, repeat(-1.0)), np.float64, len(words))
            ends = np.cumsum(counts)
            known = logs >= 0
            total = np.concatenate([[0.0], np.cumsum(np.where(known, logs, 0))])
            seen = np.concatenate([[0], np.cumsum(known)])
            codes, of = pairs(texts)
            order = np.argsort(codes)
            codes, of = codes[order], of[order]
            at = np.minimum(np.searchsorted(frequent, codes), max(len(frequent) - 1, 0))
            hit = frequent[at] == codes if len(frequent) else np.zeros(len(codes), bool)
            scores = np.bincount(of[hit], frequent_logs[at[hit]], len(texts)).astype(np.float64)
            ids, held, row = batch.column(1), batch.column(2), batch.column(0)
            # a row's own line has a key that no word equals, so that these lines spread over the partitions of the join
            marks = [END + int(r).to_bytes(8, "big") for r in row.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [row, ids, held, pa.array(marks, pa.binary()), pa.nulls(len(texts), pa.int64()), pa.array(counts), pa.array(seen[ends] - seen[ends - counts]), pa.array(total[ends] - total[ends - counts]), pa.array(scores), pa.array([len(t) for t in texts], pa.int64())],
                names,
            )
            codes, of = codes[~hit], of[~hit]
            if len(codes):
                none = [pa.nulls(len(codes), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([row.take(pa.array(of)), pa.nulls(len(codes), pa.int64()), pa.nulls(len(codes), pa.bool_()), _gram_keys(codes), pa.array(np.ones(len(codes), np.int64)), *none], names)
            rare = np.flatnonzero(~known)
            if len(rare):
                owner = np.searchsorted(ends, rare, "right")
                times = Counter(zip(owner.tolist(), [words[i] for i in rare.tolist()], strict=True))
                where = pa.array([i for i, _ in times], pa.int64())
                none = [pa.nulls(len(times), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([row.take(where), pa.nulls(len(times), pa.int64()), pa.nulls(len(times), pa.bool_()), pa.array([w for _, w in times], pa.binary()), pa.array(list(times.values()), pa.int64()), *none], names)

    names = SCORED.replace(",", "").split()[::2]
    source = bounded(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), text_bytes(text).alias("text"))
    lines = source.mapInArrow(run, SCORED)
    rare = model.words.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"), F.lit(None).cast("float").alias("log"))
    rare = rare.unionByName(classes.where(F.col("class") < least).select("key", "log").mapInArrow(_keyed, "word binary, c long, log float"))
    by_row = lines.join(rare, "word", "left").groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_words", "head_known", "head_log", "head_score", "n_bytes")),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("rare_known"),
        F.sum(F.log10(F.col("c") + 1.0) * F.col("n")).alias("rare_log"),
        F.sum("log").alias("rare_score"),
    )
    zero = F.lit(0)
    whole = F.col("head_score") + F.coalesce("rare_score", F.lit(0.0))
    tokens = F.col("n_words") + 1
    log = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(float(np.log10(model.texts + 1)))
    return by_row.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("head_known") + F.coalesce("rare_known", zero) + F.lit(int(model.texts > 0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (log - tokens * F.lit(float(np.log10(model.n + model.v + 1)))).alias("base_score"),
        whole.alias("score"),
        (-whole / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def learn_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_head: int = GRAM_HEAD) -> DataFrame:
    """Learn from the rows that are not held out and score all."""
    model = train(docs, text, learned=~held_out(doc_id))
    logs = weighed(model.grams)
    discard(model.grams)
    return _scored(docs, model, logs, doc_id, text, gram_head)
