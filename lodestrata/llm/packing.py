"""Best-fit packing of documents into sequences, improved by swaps.

Documents longer than a sequence are cut so that all pieces but the first are
full; full pieces are sequences of their own. The other pieces are dealt at
random to shards of about SHARD pieces. In each shard best-fit decreasing makes
a start; then a local search moves single pieces between underfull bins,
exchanges one for one and two for one, whenever that raises the sum of squared
fills, until bins run empty and no exchange is left. A second round packs what
lies in underfull bins of all shards again, many shards to one, so few bins stay
underfull in all. Only lengths travel: ids are never shuffled.

Results in edge cases: a null or empty text is a piece of one end id; repeated
rows are packed each, and are dealt to all shards however many there are; ties in
length go by id; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import bounded, slices, stored, text_bytes

SEQUENCE, END_ID = 1024, 2
#: Pieces that are packed together, and how often the search goes through the underfull bins at most.
SHARD, PASSES = 50_000, 50


def cut(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: the first may be shorter."""
    first = n if n <= most else n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def best_fit(lengths: np.ndarray, most: int = SEQUENCE) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin. lengths must fall."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(most + 1)]
    mask = 0  # the bit f is set if a bin has f places free
    for item, n in enumerate(lengths.tolist()):
        fit = mask >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[b].append(item)
        else:
            free, b = most, len(bins)
            bins.append([item])
        left = free - n
        if left:
            by_free[left].append(b)
            mask |= 1 << left
    return bins


class _Search:
    """Underfull bins whose pieces are exchanged until the lightest run empty."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, most: int) -> None:
        self.most, self.bins = most, bins
        self.items = np.array([i for b in bins for i in b], np.int64)
        self.len = lengths[self.items].astype(np.int64)
        self.bin = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        self.fill = np.bincount(self.bin, self.len, len(bins)).astype(np.int64)

    def _move(self, k: int, to: int) -> None:
        self.fill[self.bin[k]] -= self.len[k]
        self.fill[to] += self.len[k]
        self.bin[k] = to

    def _improve(self, light: int) -> bool:
        """One exchange that takes from the light bin and fills another: the fullest gain of moves, then of one for one, then of two for one."""
        own = np.flatnonzero(self.bin == light)
        own = own[np.argsort(-self.len[own], kind="stable")]
        open_ = (self.fill < self.most) & (self.fill >= self.fill[light])
        open_[light] = False
        if not open_.any():
            return False
        free = np.where(open_, self.most - self.fill, -1)
        for k in own:  # move
            fits = np.flatnonzero(free >= self.len[k])
            if len(fits):
                self._move(k, int(fits[np.argmin(free[fits])]))
                return True
        other = np.flatnonzero(open_[self.bin])
        room = free[self.bin[other]]
        best, swap = 0, None
        for k in own:  # one for one
            gain = self.len[k] - self.len[other]
            gain = np.where(gain <= room, gain, 0)
            j = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[j] > best:
                best, swap = int(gain[j]), (k, int(other[j]))
        if swap:
            k, j = swap
            target = self.bin[j]
            self._move(j, light)
            self._move(k, target)
            return True
        for a in range(len(own) - 1):  # two for one
            for b in range(a + 1, len(own)):
                gain = self.len[own[a]] + self.len[own[b]] - self.len[other]
                j = int(np.where(gain <= room, gain, 0).argmax()) if len(gain) else 0
                if len(gain) and 0 < gain[j] <= room[j]:
                    target = self.bin[other[j]]
                    self._move(other[j], light)
                    self._move(own[a], target)
                    self._move(own[b], target)
                    return True
        # one for two: the two lightest that fit in place of one
        for k in own:
            order = np.lexsort((self.len[other], self.bin[other]))
            o = other[order]
            pair = np.flatnonzero(self.bin[o][1:] == self.bin[o][:-1])
            if not len(pair):
                break
            gain = self.len[k] - self.len[o[pair]] - self.len[o[pair + 1]]
            gain = np.where(gain <= free[self.bin[o[pair]]], gain, 0)
            j = int(gain.argmax())
            if gain[j] > 0:
                x, y = o[pair[j]], o[pair[j] + 1]
                target = self.bin[x]
                self._move(x, light)
                self._move(y, light)
                self._move(k, target)
                return True
        return False

    def run(self) -> None:
        """From the lightest bin to the fullest, again and again until no exchange is left or PASSES are over. What an exchange leaves behind may open another, so a pass that emptied no bin still counts."""
        for _ in range(PASSES):
            done, changed = np.zeros(len(self.bins), bool), False
            while True:
                live = (self.fill > 0) & (self.fill < self.most) & ~done
                if live.sum() < 1 or ((self.fill > 0) & (self.fill < self.most)).sum() < 2:
                    break
                light = int(np.flatnonzero(live)[np.argmin(self.fill[live])])
                while self.fill[light] > 0 and self._improve(light):
                    changed = True
                done[light] = self.fill[light] > 0
            if not changed:
                return


def pack(lengths: np.ndarray, most: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its place there."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins = [[int(order[i]) for i in b] for b in best_fit(lengths[order], most)]
    fill = np.array([int(lengths[b].sum()) for b in bins])
    under = np.flatnonzero(fill < most)
    number, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        number[b] = k
    if len(under) > 1:
        search = _Search([bins[k] for k in under], lengths, most)
        search.run()
        number[search.items] = under[search.bin]
    by_bin = np.lexsort((np.arange(n), number))
    size = lengths[by_bin]
    total = np.cumsum(size) - size
    first = np.r_[True, number[by_bin][1:] != number[by_bin][:-1]] if n else np.zeros(0, bool)
    place[by_bin] = total - np.repeat(total[first], np.diff(np.r_[np.flatnonzero(first), n]))
    return number, place


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each row: where they start, how long they are, the crc32 of their ids, and a number of their own (of the task, and in the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, count = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            rows, found = [], []
            for i, ids in enumerate(own.encode(texts)):
                raw = ids.tobytes() + end_id.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) + 1, most)):
                    rows.append(i)
                    found.append((k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            where = pa.array(rows, pa.int64())
            piece, start, length, crc = zip(*found, strict=True)
            number = (task << 40) + count + np.arange(len(rows))
            count += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0).take(where), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    source = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return source.mapInArrow(run, PIECES)


def _pack_groups(most: int):
    def run(group: pa.Table) -> pa.Table:
        """The key rows of one shard: pieces in a fixed order, with bin, place and whether the bin is full."""
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        lengths = np.asarray(group["length"]).astype(np.int64)
        number, place = pack(lengths, most)
        fill = np.bincount(number, lengths)
        full = fill[number] == most
        return pa.table({**{n: group[n] for n in ("row", "doc_id", "piece", "start", "length", "ids_crc32", "shard")}, "bin": number, "offset": place, "full": full})

    return run


PACKED = PIECES + ", shard long, bin long, offset long, full boolean"


def assign(found: DataFrame, most: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """pieces with sequence_id and offset."""
    short = found.where(F.col("length") < most)
    count = short.count()
    shards = max(1, round(count / shard))
    later = max(1, round(shards / 16))
    mixed = F.xxhash64("doc_id", "piece", "row")
    first = stored(short.withColumn("shard", F.pmod(mixed, F.lit(shards))).groupBy("shard").applyInArrow(_pack_groups(most), PACKED), "packed")
    columns = [n.split()[0] for n in PIECES.split(", ")]
    again = first.where(~F.col("full")).select(*columns, F.pmod(F.xxhash64("shard"), F.lit(later)).alias("shard")).groupBy("shard").applyInArrow(_pack_groups(most), PACKED)
    # the ids of the three kinds of sequences differ in their remainder by 3
    number = lambda kind: ((F.col("shard") * (1 << 32) + F.col("bin")) * 3 + kind).alias("sequence_id")
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = found.where(F.col("length") >= most).select(*out, (F.col("row") * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(first.where("full").select(*out, number(1), "offset")).unionByName(again.select(*out, number(2), "offset"))


def packed(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return assign(stored(pieces(docs, tokenizer, most, end_id, doc_id, text), "pieces"), most)
