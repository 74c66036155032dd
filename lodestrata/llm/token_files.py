"""Token-id files: canonical length-limited Huffman codes in independent blocks.

The ids of all texts are counted in Spark; the counts (at most one row per id of
the vocabulary) give one code whose lengths package-merge limits to MOST_BITS, or
to as many bits as that many ids need.
Only the lengths are stored, as the code is canonical. Documents are dealt by
ranges of their id and coded in that order, in blocks of about BLOCK_IDS ids.

A block is decoded with the code lengths alone and holds, little-endian:
magic `LTB1`, u32 documents, u64 ids, u64 ids of the part before it, u32
checkpoint distance, u32 checkpoints, u64 payload bytes, u32 crc32 of the
payload; i64 id of each document (smallest i64: null), u32 ids of each document;
u64 bit offset of each checkpoint; the payload. A checkpoint stands at every
CHECKPOINT-th id, so all stretches between them are decoded side by side by a
table that the longest code's bits index. Blocks are rows of a Parquet table in the
shared folder (part, block, data), the lengths its row with part -1: any store
that Spark reaches will do, and a lost executor costs no block twice.

Results in edge cases: a null or empty text has the end id only; rows with a
null id come first; repeated rows are stored each, and as many as there may be of
one id are dealt to several parts; an empty table gives an empty table of blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import bounded, discard, slices, stored, text_bytes

MOST_BITS, BLOCK_IDS, CHECKPOINT, END_ID = 18, 1_000_000, 256, 0
#: Ids that one output partition holds.
PART_IDS = 16_000_000
_HEAD = struct.Struct("<4sIQQIIQI")
_NULL = -(1 << 63)


def code_lengths(counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """The optimal code length of each id under the limit, by package-merge; 0 for ids that do not occur. The limit is MOST_BITS or, for more than 2**MOST_BITS / 4 ids, two bits above what their number needs."""
    used = np.flatnonzero(counts)
    most = max(MOST_BITS, int(max(len(used) - 1, 0)).bit_length() + 2) if most is None else most
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64) if counts.max() > 1 << 53 else counts[order].astype(np.int64)
    packages, kinds = weights[:0], []
    for _ in range(most):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        kinds.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for kind in reversed(kinds):
        own = int(kind[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


@dataclass
class Code:
    """The canonical code of given lengths, the longest of which sets the size of the decoding table. At most 25 bits can be read at once."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.most = max(1, int(self.lengths.max(initial=0)))
        if self.most > 25:
            raise ValueError(f"codes of {self.most} bits are too long")
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[order].astype(np.int64)
        self.words = np.zeros(len(self.lengths), np.uint64)
        # in canonical order the codes, moved to the left, are the running sum of the shares of the code space
        shares = np.int64(1) << (self.most - size)
        starts = np.cumsum(shares) - shares
        self.words[order] = (starts >> (self.most - size)).astype(np.uint64)
        self.symbol = np.repeat(order, shares).astype(np.uint32)
        self.size = np.repeat(size, shares).astype(np.uint8)
        if len(self.symbol) < 1 << self.most:  # a lone id leaves half of the space empty
            self.symbol = np.pad(self.symbol, (0, (1 << self.most) - len(self.symbol)))
            self.size = np.pad(self.size, (0, (1 << self.most) - len(self.size)), constant_values=1)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, highest first, and where each checkpoint begins."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        starts = ends - size
        # each code is moved to its place in one 64-bit word or, where it crosses an edge, two
        words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        at, shift = starts >> 6, 64 - (starts & 63) - size
        code = self.words[ids]
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(shift < 0)  # at most one a word
        words[at[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::CHECKPOINT].astype(np.uint64)

    def decode(self, payload: bytes, count: int, offsets: np.ndarray, distance: int = CHECKPOINT) -> np.ndarray:
        """All stretches between checkpoints side by side, one id of each at a time."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        out = np.zeros((len(offsets), distance), np.uint32)
        at = offsets.astype(np.int64)
        down, mask = np.uint32(32 - self.most), np.uint32((1 << self.most) - 1)
        for k in range(distance):
            live = len(offsets) if k < (count - 1) % distance + 1 else len(offsets) - 1
            here = at[:live]
            look = windows[here >> 3] >> (down - (here & 7).astype(np.uint32)) & mask
            out[:live, k] = self.symbol[look]
            here += self.size[look]
        return out.ravel()[:count]


def write_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, before: int, code: Code) -> bytes:
    payload, offsets = code.encode(ids)
    head = _HEAD.pack(b"LTB1", len(doc_ids), len(ids), before, CHECKPOINT, len(offsets), len(payload), zlib.crc32(payload))
    return head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + offsets.astype("<u8").tobytes() + payload


def read_block(data: bytes, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document ids, ids of each document, all ids, and how many ids of the part come before."""
    magic, docs, n, before, distance, points, size, crc = _HEAD.unpack_from(data)
    if magic != b"LTB1":
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    offsets = np.frombuffer(data, "<u8", points, at := at + 4 * docs)
    payload = data[(at := at + 8 * points) : at + size]
    if len(payload) != size or zlib.crc32(payload) != crc:
        raise ValueError("the payload is damaged")
    return doc_ids, counts, code.decode(payload, n, offsets, distance), before


ENCODED = "doc_id long, n long, check long, ids binary, counts binary"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        narrow = "<u2" if own.size <= 1 << 16 else "<u4"
        total = np.zeros(max(own.size, end_id + 1), np.int64)
        kind = ["doc_id", "n", "check", "ids", "counts"]
        seen = False
        for batch in slices(batches, "text"):
            found = [np.append(x, np.uint32(end_id)) for x in own.encode([t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()])]
            total += np.bincount(np.concatenate(found), minlength=len(total))
            seen = True
            raw = [x.astype(narrow).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary()), pa.nulls(len(found), pa.binary())], kind)
        if seen:  # one more row for each task: what it has counted
            used = np.flatnonzero(total)
            packed = b"".join((used.astype("<u4").tobytes(), total[used].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], kind)

    return run


def _unpack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            m = len(raw) // 12
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<u4", m).astype(np.int64)), pa.array(np.frombuffer(raw, "<u8", m, 4 * m).astype(np.int64))], ["id", "n"])


def _write(lengths: np.ndarray, narrow: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(lengths), TaskContext.get().partitionId()
        before = block = held = 0
        docs: list[int] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal before, block, held
            ids = np.frombuffer(b"".join(parts), narrow).astype(np.uint32)
            data = write_block(np.array(docs, np.int64), np.array([len(p) // np.dtype(narrow).itemsize for p in parts]), ids, before, code)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "n", "data"])
            before, block, held = before + len(ids), block + 1, 0
            docs.clear()
            parts.clear()
            return row

        for batch in batches:
            for doc, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held and held + n > BLOCK_IDS:
                    yield close()
                docs.append(_NULL if doc is None else doc)
                parts.append(raw)
                held += n
        if docs:
            yield close()

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all rows as a table of blocks (part, block, n, data) in the shared folder, in ascending order of id, and return it."""
    spark = docs.sparkSession
    size = max(encoder(tokenizer).size, end_id + 1)
    source = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    ids = stored(source.mapInArrow(_encode(tokenizer, end_id), ENCODED), "ids")
    counted = ids.where("n < 0").select("counts").mapInArrow(_unpack_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[np.asarray(counted["id"])] = np.asarray(counted["n"])
    lengths = code_lengths(counts)
    parts = max(1, -(-int(counts.sum()) // PART_IDS))
    # a number of its own lets the ranges part rows that are all alike
    rows = ids.where("n >= 0").select("doc_id", "n", "ids", "check", F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    by = ("doc_id", "n", "check", "salt")
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "n", "ids")
    blocks = ordered.mapInArrow(_write(lengths, "<u2" if size <= 1 << 16 else "<u4"), "part long, block long, n long, data binary")
    head = spark.createDataFrame([(-1, 0, 0, bytearray(zlib.compress(lengths.tobytes())))], "part long, block long, n long, data binary")
    out = stored(blocks.unionByName(head), "token-blocks")
    discard(ids)
    return out


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the blocks. What lies before each part is a table of a row for each PART_IDS ids, which is joined."""
    (head,) = files.where("part = -1").select("data").collect()
    lengths = np.frombuffer(zlib.decompress(bytes(head.data)), np.uint8)
    sizes = files.where("part >= 0").groupBy("part").agg(F.sum("n").alias("n"))
    before_part = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, ids, before = read_block(data.as_py(), code)
                ends, docs_ = np.cumsum(counts, dtype=np.int64), len(docs)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NULL), pa.array(before + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.full(docs_, part, np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    found = files.where("part >= 0").select("part", "data").mapInArrow(run, READ + ", part long")
    return found.join(before_part, "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(files: DataFrame) -> DataFrame:
    """doc_id and ids of every document, decoded from the blocks."""
    (head,) = files.where("part = -1").select("data").collect()
    lengths = np.frombuffer(zlib.decompress(bytes(head.data)), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for data in batch.column(0):
                docs, counts, ids, _ = read_block(data.as_py(), code)
                offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == _NULL), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return files.where("part >= 0").select("data").mapInArrow(run, "doc_id long, ids array<int>")
