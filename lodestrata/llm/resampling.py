"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features are the runs of one and two words. A feature's bucket is a hash of its
string; a bucket's gain compares how often target texts and all texts have it, a
document's weight is the mean gain of its features, and documents are drawn by
weight and a Gumbel number of their id.

- Documents are stored as slices: the words of about SLICE_BYTES of texts as numbers
  of the slice's distinct words. Each slice counts its distinct features and passes
  them on by parts, packed, so a frequent feature is one entry of a slice.
- A part's task joins what all slices passed to it to one dictionary, hashes each
  distinct string once, adds up buckets, and answers each slice with the buckets of
  its strings in their order.
- Buckets' counts become gains, a table of BUCKETS numbers. Slice and answers meet
  again by slice, and gains are joined back to the feature counts of each document.

There are as many parts as PARTS_FACTOR times the session's shuffle partitions; a task
holds one part, or one slice, at a time.

Results in edge cases: a null or empty text, or one of no words, has no features, weight 0
and is never drawn; a null id has the Gumbel number of an empty one and comes last of its
score. Rows with equal score and id are ordered by the number of features and the weight,
then as stored; each has a rank of its own. A text of any length is one slice at most. Empty tables: no
documents give no rows, no target texts leave gains to the documents alone. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored, text_bytes

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 25, 7
SLICE_BYTES = 8_000_000
PARTS_FACTOR = 4
#: In so many tasks the tasks' counts are added up.
SUMS = 8

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates words.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IN_WORD[_a:_b] = True


def _strings(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie one behind the other in data."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])


def _lines(data: bytes) -> pa.Array:
    """The lines of data, each with its line feed."""
    return _strings(data, np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1)


def _data(lines: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where strings begin in what they hold, the end added, and that itself. lines is not a part of a longer array."""
    return np.frombuffer(lines.buffers()[1], np.int64)[: len(lines) + 1], lines.buffers()[2].to_pybytes() if len(lines) else b""


def cut(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of words of each text, the distinct words as lines, and each word's number among them."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # a line feed behind each word, where a byte that separates it lies
    kept = inside[1:-1].copy()
    low = _LOWER[data]
    kept[ends], low[ends] = True, 10
    found = _strings(low[kept], np.cumsum(ends - starts + 1)).dictionary_encode()
    counts = np.bincount(np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right"), minlength=len(texts))
    return counts, found.dictionary, np.asarray(found.indices).astype(np.int64)


def _pairs(counts: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """first * n + second of each two consecutive words of one text, and where the first stands."""
    follows = np.ones(len(ids), bool)
    last = np.cumsum(counts)[counts > 0] - 1
    follows[last] = False
    at = np.flatnonzero(follows)
    return ids[at] * n + ids[at + 1], at


def _parts(words: pa.Array, pairs: np.ndarray, parts: int) -> np.ndarray:
    """The part of each word, then of each distinct pair."""
    n = len(words)
    own = np.array([zlib.crc32(w) for w in words.to_pylist()], np.uint64)
    mixed = np.concatenate([own, own[pairs // n] * np.uint64(31) + own[pairs % n] * np.uint64(0x9E3779B1)]) if n else own
    return ((mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


SLICES = "slice long, part int, ids array<long>, counts array<int>, words binary, sequence binary"


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    base, number = (task.partitionId() if task else 0) << 32, 0
    ids, texts, size = [], [], 0

    def out() -> pa.RecordBatch:
        counts, words, sequence = cut(texts)
        planes = sequence.astype("<u4").view(np.uint8).reshape(-1, 4).T
        row = [base + number], [-1], [ids], [counts.tolist()], [zstandard.compress(_data(words)[1], 3)], [_packed(planes)]
        kinds = pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["slice", "part", "ids", "counts", "words", "sequence"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(t) > SLICE_BYTES:
                yield out()
                pa.default_memory_pool().release_unused()
                number, ids, texts, size = number + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield out()


def slices_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as a stored table of slices."""
    return stored(bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(_slice, SLICES), "slices")


def _words_and_sequence(words: bytes, sequence: bytes) -> tuple[pa.Array, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(sequence), np.uint8).reshape(4, -1).T
    return _lines(zstandard.decompress(words)), np.ascontiguousarray(planes).view("<u4").ravel().astype(np.int64)


def _ask(parts: int):
    """A pass over slices that gives their distinct features and counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, counts, packed_words, packed_sequence in zip(*(batch.column(c).to_pylist() for c in ("slice", "counts", "words", "sequence")), strict=True):
                words, sequence = _words_and_sequence(packed_words, packed_sequence)
                n = len(words)
                if not n:
                    continue
                pairs, times = np.unique(_pairs(np.array(counts), sequence, n)[0], return_counts=True)
                times = np.concatenate([np.bincount(sequence, minlength=n), times])
                first = pc.binary_slice(words, 0, -1)
                both = pc.binary_join_element_wise(first.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), pa.scalar(b" ", pa.large_binary()))
                part = _parts(words, pairs, parts)
                order = np.argsort(part, kind="stable")
                offsets, data = _data(pa.concat_arrays([words, both]).take(pa.array(order)))
                times = times[order].astype("<u4")
                limits = np.flatnonzero(np.diff(part[order], prepend=-1))
                rows = [(number, int(part[order[a]]), zstandard.compress(data[offsets[a] : offsets[b]], 1), _packed(times[a:b])) for a, b in zip(limits, [*limits[1:], len(order)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "part", "features", "times"])
                pa.default_memory_pool().release_unused()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part: for each row the buckets of its features, and at the end the counts of all buckets of the task."""
    names, kinds = ["slice", "part", "buckets", "totals"], (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    total = np.zeros(BUCKETS, np.int64)

    def out(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        asked = [_lines(zstandard.decompress(f)) for _, f, _ in rows]
        dictionary = pa.concat_arrays(asked).dictionary_encode()
        bucket = np.fromiter((zlib.crc32(s[:-1]) for s in dictionary.dictionary.to_pylist()), np.int64, len(dictionary.dictionary)) % BUCKETS
        of_row = bucket[np.asarray(dictionary.indices)]
        times = np.concatenate([_unpacked(t, "<u4") for _, _, t in rows])
        ends = np.cumsum([len(a) for a in asked])
        total[:] += np.bincount(of_row, times, minlength=BUCKETS).astype(np.int64)
        packed = [_packed(of_row[a:b].astype("<u2")) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([r[0] for r in rows], [part] * len(rows), packed, [None] * len(rows)), kinds, strict=True)], names)

    rows, at = [], None
    for batch in batches:
        for number, part, features, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != at and rows:
                yield out(at, rows)
                rows = []
            at = part
            rows.append((number, features, times))
    if rows:
        yield out(at, rows)
    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, _packed(total.astype("<i8"))), kinds, strict=True)], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            total += _unpacked(packed, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["totals"])


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def answers_to(slices: DataFrame) -> DataFrame:
    """The buckets of each slice's features by part, and the counts of buckets by part; a stored table."""
    n = _partitions(slices)
    asked = bounded(slices).mapInArrow(_ask(n * PARTS_FACTOR), "slice long, part int, features binary, times binary")
    dealt = asked.repartition(n, "part").sortWithinPartitions("part", "slice")
    return stored(dealt.mapInArrow(_answer, "slice long, part int, buckets binary, totals binary"), "answers")


def bucket_counts(answers: DataFrame) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    # each task's counts are BUCKETS numbers; a fixed number of sums of them comes to the driver
    sums = answers.where("totals is not null").select("totals").repartition(SUMS).mapInArrow(_added, "totals binary")
    return sum((_unpacked(bytes(r.totals), "<i8") for r in sums.collect()), np.zeros(BUCKETS, np.int64))


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, by features of the documents and of the target texts."""
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains: np.ndarray, parts: int):
    """A pass over rows that come by slice, the slice itself first and then its answers by part."""

    def out(own: tuple, got: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, counts, packed_words, packed_sequence = own
        counts = np.array(counts, np.int64)
        words, sequence = _words_and_sequence(packed_words, packed_sequence)
        n = len(words)
        total = np.zeros(len(counts), np.int64)
        if n:
            key, at = _pairs(counts, sequence, n)
            pairs, which = np.unique(key, return_inverse=True)
            part = _parts(words, pairs, parts)
            order = np.argsort(part, kind="stable")
            if [p for p, _ in got] != np.unique(part).tolist():
                raise RuntimeError("answers to a slice are missing")
            gain = np.zeros(len(order), np.int64)
            gain[order] = gains[np.concatenate([_unpacked(b, "<u2") for _, b in got])]
            text = np.repeat(np.arange(len(counts)), counts)
            # a document's count of a feature times its gain, added up over its features
            sums = np.zeros(len(sequence), np.int64)
            sums += gain[sequence]
            sums[at] += gain[n + which]
            np.add.at(total, text, sums)
        features = np.maximum(2 * counts - 1, 0)
        weight = total // np.maximum(features, 1)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, got = None, []
        for batch in batches:
            for _, part, ids, counts, words, sequence, buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    if own:
                        yield out(own, got)
                    own, got = (ids, counts, words, sequence), []
                else:
                    got.append((part, buckets))
        if own:
            yield out(own, got)

    return run


def weighed(slices: DataFrame, answers: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document of slices."""
    n = _partitions(slices)
    both = slices.withColumn("buckets", F.lit(None).cast("binary")).unionByName(answers.where("slice is not null").select("slice", "part", "buckets"), allowMissingColumns=True)
    dealt = both.select("slice", "part", "ids", "counts", "words", "sequence", "buckets").repartition(n, "slice").sortWithinPartitions("slice", "part")
    return dealt.mapInArrow(_weigh(gains, n * PARTS_FACTOR), "doc_id long, n_words long, n_features long, weight long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, before = TaskContext.get(), 0
    for batch in batches:
        place = pa.array(np.arange(before, before + batch.num_rows))
        before += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task.partitionId() if task else 0, np.int32)), place], [*batch.schema.names, "range", "place"])


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """rows, a stored table, with rank: the k highest scores have 1 to k, the others null. Rows are numbered in ranges of the order, so no task holds them all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order)
    numbered = stored(bounded(dealt).mapInArrow(_number, f"{fields}, range int, place long"), "ranges")
    sizes = {r["range"]: r["n"] for r in numbered.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row for each shuffle partition
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]).tolist()
    rank = F.get(F.array(*map(F.lit, before)), F.col("range")) + F.col("place") + 1
    return numbered.withColumn("rank", F.when(rank <= k, rank)).drop("range", "place")


def gumbel(doc_id: str = "doc_id", seed: int = SEED) -> F.Column:
    """A thousand times a Gumbel number of the id, as a whole number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn ones have no rank."""
    slices = slices_of(docs, doc_id, text)
    answers = answers_to(slices)
    aim = answers_to(slices_of(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text))
    gains = gains_of(bucket_counts(answers), bucket_counts(aim))
    scored = weighed(slices, answers, gains).withColumn("score", F.col("weight") + gumbel()).withColumn("row", F.monotonically_increasing_id())
    rows = stored(scored, "weights")
    fit = rows.where(F.col("n_words") >= MIN_WORDS)
    best = ranked(fit, PERCENT * fit.count() // 100)
    rest = rows.where(F.col("n_words") < MIN_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return best.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
