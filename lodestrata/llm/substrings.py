"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

A word goes where a window of WINDOW words covers it whose word sequence also
starts in a document with a smaller id.

1. prepare(): one pass over the texts hashes every window of SEED_WORDS words
   and keeps, for each long window, its smallest seed hash (a minimizer). Equal
   long windows have equal minimizers, so windows whose minimizer occurs in one
   document only cannot repeat. That leaves about a fourteenth of the rows.
   Texts of the same words as a text with a smaller id lose all words at once.
2. The minimizers of the others are counted in Spark, with map-side
   combination; documents that hold one seen in several documents are candidates.
3. Every long window of the candidates with such a minimizer is hashed (96 bits)
   and counted in Spark: smallest and largest id of each. Windows with a smaller
   id elsewhere are joined back and merged into maximal removal intervals.

With every=True, steps 1 and 2 are left out: each window of each text is hashed and
counted. The result is the same, which the tests hold, at about fourteen times the
rows.

No step gathers a passage's documents in one task: counts are combined before
the shuffle, and the joins back are plain equi joins that adaptive execution
splits where a passage is frequent.

Results in edge cases: null and empty texts have no words; texts under WINDOW
words lose nothing; rows with a null id neither lose words nor count as first;
repeated rows (same id) do not remove one another and get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded, free_name, slices, stored, text_bytes

WINDOW, SEED_WORDS = 50, 25
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def rabin_karp(ids: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The polynomial hash of each window of `length` numbers, modulo 2**64, by doubling."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done = None, 0
        power, size, part = base, 1, ids
        while True:
            if length & size:
                out = part if out is None else out[: len(ids) - done - size + 1] * power + part[done : done + len(ids) - done - size + 1]
                done += size
            if done == length:
                return out[:n]
            part = part[: len(part) - size] * power + part[size:]
            power, size = power * power, 2 * size


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def minimizers(ids: np.ndarray, window: int = WINDOW, seed: int = SEED_WORDS) -> np.ndarray:
    """For each window its smallest seed hash."""
    if len(ids) < window:
        return np.zeros(0, np.uint64)
    return _sliding_min(_mixed(rabin_karp(ids, seed, _B1)), window - seed + 1)


PREPARED = "doc_id long, text_hash long, n_words long, sha256 string, seeds array<long>"


def _prepare(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, seeds, sizes = [], [], [], []
            for text in batch.column(2).to_pylist():
                words = text.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                own = np.unique(minimizers(word_hashes(words), window, seed)) if len(words) >= window else np.zeros(0, np.uint64)
                seeds.append(own)
                sizes.append(len(own))
            flat = np.concatenate(seeds).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "text_hash", "n_words", "sha256", "seeds"])

    return run


def _windows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            out: list[tuple[np.ndarray, ...]] = []
            wanted = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
            for i, (text, seeds) in enumerate(zip(batch.column(2).to_pylist(), wanted, strict=True)):
                ids = word_hashes(text.split())
                at = np.arange(max(len(ids) - window + 1, 0)) if seeds is None else np.flatnonzero(np.isin(minimizers(ids, window, seed), np.asarray(seeds.values).view(np.uint64)))
                out.append((rabin_karp(ids, window, _B1)[at], rabin_karp(ids, window, _B2)[at], at, np.full(len(at), i)))
            h1, h2, at, row = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc_id", "text_hash", "start", "h1", "h2"])

    return run


def covered(starts: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words, end excluded."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias("text_hash"), text_bytes(text).alias("text"))


def find(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text", every: bool = False, again: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What prepare() says of each row; texts that lose all words as copies; candidates with their texts; and per candidate the starts of the windows to remove.

    again: whether the caller reads the candidates, too; only then are their texts stored.
    """
    base = _base(docs, doc_id, text)
    prepared = stored(base.mapInArrow(_prepare(window, seed), PREPARED), "prepared")
    keys = ["doc_id", "text_hash"]
    if every:
        candidates = base.where("doc_id is not null")
        return prepared, prepared.select(*keys).limit(0), candidates, _starts(candidates, window, seed)
    # every window of a copy starts in its first text, too; the windows of copies need no counting
    whole = prepared.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    other = F.concat(F.lit("="), F.col("sha256")).alias("other")
    firsts = whole.groupBy("sha256").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(other, "lo")
    copies = stored(whole.select(*keys, other).join(firsts, "other").where("doc_id > lo").select(*keys).distinct(), "copies")
    seen = whole.select(*keys, "seeds").join(copies, keys, "left_anti").select(*keys, F.explode("seeds").alias("seed"))
    repeated = seen.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("seed")
    # a join on the complement of the key puts an exchange on either side: adaptive execution can then split a frequent key, which it cannot where an aggregate's exchange is used again
    other = F.bitwise_not("seed").alias("other")
    wanted = seen.select("*", other).join(repeated.select(other), "other").groupBy("doc_id", "text_hash").agg(F.collect_set("seed").alias("seeds"))
    candidates = base.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "seeds")
    if again:
        candidates = stored(candidates, "candidates")
    return prepared, copies, candidates, _starts(candidates, window, seed)


def _starts(candidates: DataFrame, window: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, starts) of the windows that also start in a document with a smaller id."""
    windows = stored(candidates.mapInArrow(_windows(window, seed), "doc_id long, text_hash long, start int, h1 long, h2 int"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    other = F.bitwise_not("h1").alias("other")
    later = windows.select("*", other).join(first.select(other, "h2", "lo"), ["other", "h2"]).where("doc_id > lo")
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("start").alias("starts"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            removed, digests, runs = [], [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = text.split()
                mask = covered(np.asarray(starts.values), len(words), window)
                removed.append(int(mask.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, gone in zip(words, mask.tolist(), strict=True) if not gone)).hexdigest())
                runs.append([{"from": a, "to": b} for a, b in intervals(mask)])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests), pa.array(runs, kind)], ["doc_id", "text_hash", "removed", "cut_sha256", "intervals"])

    return run


def digests(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals) for each row of docs."""
    prepared, copies, candidates, starts = find(docs, window, seed, doc_id, text, every)
    cut = (
        candidates.join(starts, ["doc_id", "text_hash"])
        .select("doc_id", "text_hash", "text", "starts")
        .mapInArrow(_cut(window), "doc_id long, text_hash long, removed long, cut_sha256 string, intervals array<struct<from: long, to: long>>")
        .dropDuplicates(["doc_id", "text_hash"])
    )
    copy = F.coalesce(F.col("copy"), F.lit(False))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))
    return prepared.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "text_hash"], "left").join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.col("intervals")).alias("intervals"),
    )


def _spans(text: str) -> np.ndarray:
    """Where the words of a text begin and end, in bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _rest(text: str, starts: np.ndarray, window: int) -> str:
    """The text without the covered words; what is kept keeps its own white space, and runs are joined by a blank."""
    spans = _spans(text)
    raw = text.encode()
    return b" ".join(raw[spans[a, 0] : spans[b - 1, 1]] for a, b in intervals(~covered(starts, len(spans), window))).decode("utf-8", "replace")


def remove(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated words cut out of their texts; all other columns and rows stay. Texts that lose nothing stay as they are."""
    _, copies, _, starts = find(docs, window, seed, doc_id, text, again=False)
    # of a copy no word is left: no starts
    starts = starts.unionByName(copies.withColumn("starts", F.array().cast("array<int>")))
    own, hashed, gone = (free_name(docs, n) for n in ("_doc", "_hash", "_starts"))
    found = starts.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.col("starts").alias(gone))
    same = (F.col(doc_id).cast("long") == F.col(own)) & (F.coalesce(F.xxhash64(F.col(text)), F.lit(0)) == F.col(hashed))
    joined = docs.join(found, same, "left").drop(own, hashed)
    names = docs.columns
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(where)
            starts_ = batch.column(batch.num_columns - 1)
            if starts_.null_count < len(starts_):
                texts = pa.array([t.as_py() if s.values is None else _rest(t.as_py(), np.asarray(s.values), window) if len(s.values) else "" for t, s in zip(texts, starts_, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == where else batch.column(k) for k in range(len(names))], names)

    return joined.mapInArrow(run, docs.schema)
