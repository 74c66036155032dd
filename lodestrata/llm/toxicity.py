"""Toxicity by subword vectors: the vectors of a text's character n-grams are averaged and go into a linear softmax.

A word is a run of letters and digits in lower case, with a sign before and behind
it; its subwords are the n-grams of GRAM_SIZES of its characters and the whole of
it, each hashed to one of BUCKETS vectors. A word's vector is the mean of its
subwords', a text's the mean of its distinct words'. Vectors and softmax are trained
together in numpy on labelled rows, so a spelling that no labelled text has gets
the vectors of the n-grams that it shares with others.

Training reads a bounded sample of the labelled rows: of each class the SAMPLE
with the smallest hash of their id, among texts of at most SAMPLE_BYTES. It is
gathered as counts of distinct words. As everything between buckets and logits is
linear, the trained model is one row of logits for each bucket, of a fixed size,
that goes to the tasks; these hash words in numpy, each distinct word of a slice once.

Results in edge cases: a null or empty text, or one without words, gets the score
of the softmax's bias; without labelled rows of both classes all scores are the share
of the class there is, or 0.5. A row with a null id counts as not held out and, as no
label is its own, is scored like the others. Repeated rows give repeated results;
a label that is null or other than 0 and 1 is not read, and of several labels of
one id the largest counts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, text_bytes

#: Vectors, their length, and the lengths of n-grams.
BUCKETS, WIDTH, GRAM_SIZES = 2**17, 8, (3, 4, 5)
#: Rows of each class to learn from, at most, and the length in bytes up to which a text may be one of them.
SAMPLE, SAMPLE_BYTES = 3_000, 50_000
STEPS, BATCH, RATE, SEED = 600, 64, 0.6, 12
#: Squared gradients that a parameter starts with: steps are near plain gradient steps until they have grown to it.
START = 1e-8
#: Texts to learn from are cut to words so many characters at a time.
CHUNK = 1_000_000
#: A subword is learned if so many words of the sample's texts have it, a text's distinct words counted once each.
LEAST_TEXTS = 4
#: So many words of vector zero are averaged with a text's own, so that a few odd words do not decide.
PADDING = 10
#: Score from which a text counts as toxic.
THRESHOLD = 0.7

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_OPEN, _CLOSE = 1, 2


@dataclass(frozen=True)
class Words:
    """Words of several texts. text: for each word the number of its text; which: its number among the distinct words; hashes, points, starts, ends: the distinct words' hashes and characters."""

    text: np.ndarray
    which: np.ndarray
    hashes: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _is_word() -> np.ndarray:
    """By code point up to U+303F: letters and digits of ASCII, and what is beyond Latin-1's and the general marks."""
    table = np.zeros(0x3041, bool)
    for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0xC0, 0x2000), (0x2070, 0x3000), (0x3040, 0x3041)):
        table[a:b] = True
    return table


_WORD = _is_word()


def words_of(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.concatenate([[False], _WORD[np.minimum(points, len(_WORD) - 1)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # a word's hash: the difference of two prefix sums, brought back to position 0
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), _P)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), _P_INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    limits = np.cumsum([len(t) + 1 for t in low])
    return Words(np.searchsorted(limits, starts, "right"), which, names, points, starts[first], ends[first])


def subwords(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the distinct words' subwords, and for each the number of its word; in the order of words."""
    lengths = words.ends - words.starts + 2
    begin = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - begin[owner]
    own = np.where(place == 0, _OPEN, np.where(place == lengths[owner] - 1, _CLOSE, words.points[np.clip(words.starts[owner] + place - 1, 0, max(0, len(words.points) - 1))])).astype(np.uint64)
    buckets, owners = [], []
    rolled = np.zeros(n, np.uint64)
    for k in range(max(GRAM_SIZES)):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = own[k:]
        rolled = rolled * _P + shifted + np.uint64(1)
        if k + 1 in GRAM_SIZES:
            inside = place + k < lengths[owner]
            buckets.append(rolled[inside] + np.uint64(k))
            owners.append(owner[inside])
    whole = np.zeros(len(lengths), np.uint64)
    for k in range(int(lengths.max()) if len(lengths) else 0):
        live = np.flatnonzero(lengths > k)
        if not len(live) or k > 64:
            break
        whole[live] = whole[live] * _P + own[begin[live] + k]
    buckets.append(whole * np.uint64(31) + np.uint64(7))
    owners.append(np.arange(len(lengths)))
    mixed, owner = np.concatenate(buckets), np.concatenate(owners)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(owner, kind="stable")
    return (mixed[order] >> np.uint64(47)).astype(np.int64) % BUCKETS, owner[order]


@dataclass(frozen=True)
class Model:
    """logits: for each bucket those of the two classes; bias: of a text without words."""

    logits: np.ndarray
    bias: np.ndarray

    def word_logits(self, words: Words) -> np.ndarray:
        bucket, owner = subwords(words)
        n = len(words.starts)
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        return np.stack([np.bincount(owner, self.logits[bucket, c], minlength=n) / count for c in (0, 1)], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts)
        text, which = np.divmod(np.unique(words.text * np.int64(len(words.starts)) + words.which), max(1, len(words.starts)))
        of_word = self.word_logits(words)[which]
        n = np.bincount(text, minlength=len(texts)) + PADDING
        both = np.stack([np.bincount(text, of_word[:, c], minlength=len(texts)) / n for c in (0, 1)], axis=1) + self.bias
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def _lexicon(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: text * n + word for each of a text's distinct words, the number of subwords of each of the n words, and their buckets."""
    ends = np.cumsum([len(t) for t in texts]) // CHUNK
    text, hashes, sizes, buckets, names = [], [], [], [], np.zeros(0, np.uint64)
    for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
        words = words_of([texts[k] for k in rows])
        if not len(words.hashes):
            continue
        own = np.unique(words.text * np.int64(len(words.starts)) + words.which)
        text.append(rows[own // len(words.starts)])
        hashes.append(words.hashes[own % len(words.starts)])
        new = ~np.isin(words.hashes, names)
        bucket, owner = subwords(replace(words, starts=words.starts[new], ends=words.ends[new]))
        names = np.concatenate([names, words.hashes[new]])
        sizes.append(np.bincount(owner, minlength=int(new.sum())))
        buckets.append(bucket.astype(np.int32))
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    order = np.argsort(names)
    pair = np.concatenate(text) * np.int64(len(names)) + order[np.searchsorted(names, np.concatenate(hashes), sorter=order)]
    return np.sort(pair), np.concatenate(sizes), np.concatenate(buckets)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges, and the number of the range of each."""
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model of texts and their classes 0 and 1. Classes have the same weight however many texts they have."""
    y = np.asarray(toxic, np.int64)
    count = np.bincount(y, minlength=2)
    if not count.all():
        share = count[1] / count.sum() if count.sum() else 0.5
        bias = {0.5: 0.0, 0.0: -30.0, 1.0: 30.0}[float(share)]
        return Model(np.zeros((BUCKETS, 2), np.float32), np.array([0.0, bias]))
    pair, each, bucket = _lexicon(texts)
    n = len(each)
    text, word = pair // max(1, n), pair % max(1, n)
    limits = np.searchsorted(text, np.arange(len(texts) + 1))
    owner, each = np.repeat(np.arange(n, dtype=np.int32), each), each.astype(np.float32)
    # subwords that few texts have stay zero
    enough = np.bincount(bucket, np.bincount(word, minlength=n)[owner], minlength=BUCKETS) >= LEAST_TEXTS
    bucket, owner = bucket[enough[bucket]], owner[enough[bucket]]
    names, bucket = np.unique(bucket, return_inverse=True)
    begin = np.searchsorted(owner, np.arange(n + 1))

    rng = np.random.default_rng(SEED)
    vectors, weights, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (len(names), WIDTH)).astype(np.float32), np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    seen_v, seen_w, seen_b = np.full(len(names), START, np.float32), np.full((WIDTH, 2), START), np.full(2, START)
    share = len(y) / (2 * count)

    def sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        return np.stack([np.bincount(group, values[:, k], minlength=groups) for k in range(values.shape[1])], axis=1)

    order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-STEPS * BATCH // len(y)))])
    for step in range(STEPS):
        rows = order[step * BATCH : (step + 1) * BATCH]
        cell, doc = _ranges(limits[rows], limits[rows + 1])
        own, which = np.unique(word[cell], return_inverse=True)
        place, of = _ranges(begin[own], begin[own + 1])
        feature = bucket[place]
        of_word = sums(vectors[feature], of, len(own)) / each[own, None]
        size = np.bincount(doc, minlength=len(rows))[:, None] + PADDING
        mean = sums(of_word[which], doc, len(rows)) / size
        logit = mean @ weights + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        p *= share[y[rows]][:, None] / len(rows)
        g_w, g_b = mean.T @ p, p.sum(axis=0)
        g_word = sums(((p @ weights.T) / size)[doc], which, len(own)) / each[own, None]
        touched, spot = np.unique(feature, return_inverse=True)
        g_v = sums(g_word[of], spot, len(touched))
        seen_v[touched] += (g_v * g_v).mean(axis=1)
        seen_w += g_w * g_w
        seen_b += g_b * g_b
        vectors[touched] -= RATE * g_v / np.sqrt(seen_v[touched])[:, None]
        weights -= RATE * g_w / np.sqrt(seen_w)
        bias -= RATE * g_b / np.sqrt(seen_b)
    logits = np.zeros((BUCKETS, 2), np.float32)
    logits[names] = vectors @ weights
    return Model(logits, bias)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the decimal id has the remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).where(F.length("text") <= SAMPLE_BYTES)
    named = rows.withColumn("h", F.xxhash64("text"))
    # first the ids and hashes of the sample, then the texts of these alone; equal rows count once
    keys = named.select("doc_id", "h").join(known, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "h"]
    ids = keys.where("toxic = 0").orderBy(*order).limit(SAMPLE).unionByName(keys.where("toxic = 1").orderBy(*order).limit(SAMPLE))
    picked = named.join(F.broadcast(ids), ["doc_id", "h"]).groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text"))
    sample = sorted(picked.collect(), key=lambda r: (r.doc_id, r.h))
    return train([bytes(r.text).decode("utf-8", "replace") for r in sample], [r.toxic for r in sample])


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text"):
            score = own.scores([t.decode("utf-8", "replace") for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), text_bytes(text).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What a model of the labelled rows says of all rows."""
    return scored(docs, learned(docs, labels))
