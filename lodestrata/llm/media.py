"""ISO media containers: a writer, and a reader that walks boxes and sample tables only.

The reader decodes no payload. It walks the nested boxes, reads the sample
tables (sizes, compact sizes, chunks, chunk offsets, times, sync samples) and the
runs of movie fragments, and returns codec, duration, sample count, where each
keyframe's bytes lie, and the byte ranges that hold all samples. The writer stores
bytes as 8-bit audio samples so that any payload survives a round trip.

Results in edge cases: a null or empty text is stored as one frame of blanks;
bytes that are no container, or a container cut short, give a row whose
`problem` says so, as does a fragment of a track that there is not; boxes may be
nested however deep; a sample without a known flag is a keyframe where its track
has no table of them; equal payloads give equal files, as no clock or chance is
used; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, stored, text_bytes

FRAME, RATE, KEY_EVERY, CHUNK_FRAMES = 192, 8000, 16, 64

#: Boxes that hold boxes, with the bytes that come before them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = FRAME, fill: bytes = b" ") -> bytes:
    """Up to a positive multiple of the unit."""
    return data + fill * (max(1, -(-len(data) // unit)) * unit - len(data))


def write_container(payload: bytes) -> bytes:
    """The payload as frames of 8-bit samples: ftyp, mdat, moov. Every KEY_EVERY-th frame is a sync sample."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of the frame")
    frames = len(payload) // FRAME
    wide = len(payload) + 16 > 0xFFFFFFFF
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    media = (struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")) + payload
    begin = len(head) + (16 if wide else 8)
    chunks = -(-frames // CHUNK_FRAMES)
    offsets = begin + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK_FRAMES * FRAME)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] * (chunks > 1 or last == CHUNK_FRAMES) + [(chunks, last, 1)] * (last != CHUNK_FRAMES)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    samples = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *x) for x in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes()),
    )
    span = frames * FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    track = _box(
        b"trak",
        _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, span), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=3),
        _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, span, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), samples),
        ),
    )
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, span), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1), track)
    return head + media + movie


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: int = 0
    number: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def ranges(self, which: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Byte ranges, end excluded, of the samples or of some of them; neighbours are merged."""
        start, size = (self.offsets, self.sizes) if which is None else (self.offsets[which], self.sizes[which])
        if not len(start):
            return []
        end = start + size
        cut = np.flatnonzero(start[1:] != end[:-1])
        return list(zip(start[np.r_[0, cut + 1]].tolist(), end[np.r_[cut, len(end) - 1]].tolist(), strict=True))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Each box with its path and where its body lies. A box that ends beyond its parent raises ValueError."""
    open_: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_:
        start, stop, path = open_.pop()
        if start + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > stop:
                raise ValueError("box is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = stop - start
        if size < body - start or start + size > stop:
            raise ValueError("box is cut short")
        open_.append((start + size, stop, path))
        own = (*path[-3:], kind)  # who asks for more of a path than that does not need it
        yield own, body, start + size
        if kind in CONTAINERS:
            open_.append((body + CONTAINERS[kind], start + size, own))


def _numbers(data: bytes, at: int, stop: int, kind: str, count: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if count * width > stop - at:
        raise ValueError("table is cut short")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _sizes(data: bytes, at: int, stop: int, kind: bytes) -> np.ndarray:
    """The sizes of all samples, from a table of 32-bit or of compact sizes."""
    size, count = struct.unpack_from(">II", data, at + 4)
    if kind == b"stsz":
        return np.full(count, size, np.int64) if size and count <= len(data) else _numbers(data, at + 12, stop, ">u4", count)
    width = size & 255
    if width == 4:
        packed = _numbers(data, at + 12, stop, "u1", (count + 1) // 2)
        return np.stack([packed >> 4, packed & 15], 1).ravel()[:count]
    if width not in (8, 16):
        raise ValueError("sizes have no known width")
    return _numbers(data, at + 12, stop, "u1" if width == 8 else ">u2", count)


#: Flags of fragment boxes (fixed values), and the flag of a sample that is no keyframe.
BASE_OFFSET, DEFAULT_DURATION, DEFAULT_SIZE, DEFAULT_FLAGS, DESCRIPTION, FROM_MOOF = 0x1, 0x8, 0x10, 0x20, 0x2, 0x20000
DATA_OFFSET, FIRST_FLAGS, DURATIONS, SIZES, FLAGS, TIMES = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_SYNC = 0x10000


class _Fragments:
    """What the boxes of movie fragments say of their tracks' samples."""

    def __init__(self) -> None:
        self.defaults: dict[int, tuple[int, int, int]] = {}
        self.found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}
        self.moof = self.base = self.next = 0
        self.track, self.duration, self.size, self.flags = 0, 0, 0, 0

    def trex(self, data: bytes, at: int) -> None:
        track, _, *rest = struct.unpack_from(">IIIII", data, at + 4)
        self.defaults[track] = tuple(rest)

    def tfhd(self, data: bytes, at: int) -> None:
        flags, track = struct.unpack_from(">II", data, at)
        if track != self.track and not flags & (BASE_OFFSET | FROM_MOOF):
            self.base = self.next or self.moof  # the data of a track follow those of the one before
        self.track, at = track, at + 8
        self.duration, self.size, self.flags = self.defaults.get(track, (0, 0, 0))
        if flags & BASE_OFFSET:
            (self.base,) = struct.unpack_from(">Q", data, at)
            at += 8
        elif flags & FROM_MOOF:
            self.base = self.moof
        self.next = self.base
        at += 4 * bool(flags & DESCRIPTION)
        for flag, name in ((DEFAULT_DURATION, "duration"), (DEFAULT_SIZE, "size"), (DEFAULT_FLAGS, "flags")):
            if flags & flag:
                setattr(self, name, struct.unpack_from(">I", data, at)[0])
                at += 4

    def trun(self, data: bytes, at: int, stop: int) -> None:
        flags, count = struct.unpack_from(">II", data, at)
        at += 8
        if flags & DATA_OFFSET:
            self.next = self.base + struct.unpack_from(">i", data, at)[0]
            at += 4
        first = None
        if flags & FIRST_FLAGS:
            (first,) = struct.unpack_from(">I", data, at)
            at += 4
        held = [f for f in (DURATIONS, SIZES, FLAGS, TIMES) if flags & f]
        if not held and count > len(data):
            raise ValueError("run is cut short")
        table = _numbers(data, at, stop, ">u4", count * len(held)).reshape(count, len(held))
        column = lambda flag, other: table[:, held.index(flag)] if flag in held else np.full(count, other, np.int64)
        sizes, marks = column(SIZES, self.size), column(FLAGS, self.flags).copy()
        if first is not None and count and FLAGS not in held:
            marks[0] = first
        starts = self.next + np.cumsum(sizes) - sizes
        self.next += int(sizes.sum())
        if count and (int(starts.min()) < 0 or self.next > len(data)):
            raise ValueError("samples lie beyond the end")
        self.found.setdefault(self.track, []).append((starts, sizes, (marks & NO_SYNC) == 0, int(column(DURATIONS, self.duration).sum())))

    def add_to(self, tracks: list[Track]) -> None:
        for number, runs in self.found.items():
            track = next((t for t in tracks if t.number == number), None)
            if track is None:
                raise ValueError("fragment of a track that there is not")
            keys = np.concatenate([k for *_, k, _ in runs])
            track.keys = np.concatenate([track.keys, track.samples + np.flatnonzero(keys)])
            track.offsets = np.concatenate([track.offsets, *(r[0] for r in runs)])
            track.sizes = np.concatenate([track.sizes, *(r[1] for r in runs)])
            track.samples = len(track.sizes)
            track.duration += sum(r[3] for r in runs)


def _chunked(own: dict[str, np.ndarray], sizes: np.ndarray, end: int) -> np.ndarray:
    """Where each sample of the sample tables begins."""
    chunks, runs = own.get("chunks", np.zeros(0, np.int64)), own.get("runs", np.zeros((0, 3), np.int64))
    if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise ValueError("no whole chunk table")
    per = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0], len(chunks) + 1]).clip(0))[: len(chunks)]
    if int(per.sum()) < len(sizes):
        raise ValueError("chunks hold fewer samples than there are")
    chunk = np.repeat(np.arange(len(per)), np.minimum(per, len(sizes)))[: len(sizes)]
    before = np.cumsum(sizes) - sizes
    first = np.r_[True, chunk[1:] != chunk[:-1]]
    offsets = chunks[chunk] + before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(sizes)]))
    if int((offsets + sizes).max()) > end or int(offsets.min()) < 0:
        raise ValueError("samples lie beyond the end")
    return offsets


def read_container(data: bytes) -> list[Track]:
    """The tracks of a container. Raises ValueError for what is no whole container."""
    tracks: list[Track] = []
    tables: list[dict[str, np.ndarray]] = []
    fragments = _Fragments()
    try:
        for path, at, stop in walk(data):
            kind = path[-1]
            if kind == b"trak":
                tracks.append(Track())
                tables.append({})
            elif kind == b"moof":
                fragments.moof, fragments.base, fragments.next, fragments.track = at - 8, at - 8, 0, 0
            elif kind == b"trex":
                fragments.trex(data, at)
            elif kind == b"tfhd":
                fragments.tfhd(data, at)
            elif kind == b"trun":
                fragments.trun(data, at, stop)
            if not tracks:
                continue
            t, own = tracks[-1], tables[-1]
            if kind == b"tkhd":
                (t.number,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
            elif kind == b"mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr" and b"mdia" in path:
                t.handler = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                t.codec = data[at + 12 : at + 16].decode("latin-1").strip()
            elif kind == b"stts":
                own["time"] = _numbers(data, at + 8, stop, ">u4", 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2)
            elif kind == b"stss":
                own["keys"] = _numbers(data, at + 8, stop, ">u4", struct.unpack_from(">I", data, at + 4)[0]) - 1
            elif kind == b"stsc":
                own["runs"] = _numbers(data, at + 8, stop, ">u4", 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
            elif kind in (b"stsz", b"stz2"):
                own["sizes"] = _sizes(data, at, stop, kind)
            elif kind in (b"stco", b"co64"):
                own["chunks"] = _numbers(data, at + 8, stop, ">u4" if kind == b"stco" else ">u8", struct.unpack_from(">I", data, at + 4)[0])
    except (struct.error, IndexError) as e:
        raise ValueError("box is cut short") from e
    if not tracks:
        raise ValueError("no track")
    for t, own in zip(tracks, tables, strict=True):
        t.sizes = own.get("sizes", t.sizes)
        t.samples = len(t.sizes)
        if t.samples:
            t.offsets = _chunked(own, t.sizes, len(data))
        if "time" in own and not t.duration:
            t.duration = int((own["time"][:, 0] * own["time"][:, 1]).sum())
        t.keys = own["keys"][(own["keys"] < t.samples) & (own["keys"] >= 0)] if "keys" in own else np.arange(t.samples)
    fragments.add_to(tracks)
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in track.ranges())


def feature(track: Track) -> str:
    """Codec, duration in samples and seconds, sample and keyframe counts, and a digest of the keyframes' byte ranges with the first and last of them."""
    ranges = track.ranges(track.keys)
    text = ",".join(f"{a}-{b}" for a, b in ranges)
    ends = f"{ranges[0][0]}-{ranges[0][1]}..{ranges[-1][0]}-{ranges[-1][1]}" if ranges else ""
    return f"codec={track.codec};handler={track.handler};duration={track.duration}/{track.timescale};samples={track.samples};keys={len(track.keys)};key_ranges={ends};key_crc32={zlib.crc32(text.encode()):08x}"


INSPECT_SCHEMA = "media binary, problem string, tracks array<struct<handler: string, codec: string, timescale: long, duration: long, seconds: double, samples: long, key_starts: array<long>, key_ends: array<long>>>"


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("samples", pa.int64()), ("key_starts", pa.list_(pa.int64())), ("key_ends", pa.list_(pa.int64()))]))
    for batch in slices(batches, "media"):
        problems, rows = [], []
        for data in batch.column(0).to_pylist():
            try:
                found = read_container(data or b"")
                rows.append([{"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "seconds": t.duration / t.timescale if t.timescale else None, "samples": t.samples, "key_starts": t.offsets[t.keys].tolist(), "key_ends": (t.offsets + t.sizes)[t.keys].tolist()} for t in found])
                problems.append(None)
            except ValueError as e:
                rows.append([])
                problems.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(problems, pa.string()), pa.array(rows, kind)], ["media", "problem", "tracks"])


def inspect(media: DataFrame, column: str = "media") -> DataFrame:
    """For each row of bytes: its tracks with codec, duration and keyframe byte ranges, or the problem."""
    return bounded(media).select(F.col(column).cast("binary").alias("media")).mapInArrow(_inspect, INSPECT_SCHEMA)


STORE_SCHEMA = "doc_id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([write_container(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a container, in a column of bytes of a table that is written to the shared folder and read again."""
    return stored(bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(_store, STORE_SCHEMA), "media")


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, key_starts array<long>, key_ends array<long>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    for batch in slices(batches, "media"):
        rows, starts, ends = [], [], []
        for data in batch.column(2).to_pylist():
            track = read_container(data)[0]
            payload = payload_of(data, track)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track.codec, track.duration))
            starts.append(track.offsets[track.keys])
            ends.append(starts[-1] + track.sizes[track.keys])
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (starts, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, zip(*rows, strict=True)), *lists], names)


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the containers of store(): digests, codec, duration and the byte range of each keyframe."""
    return media.mapInArrow(_digest, DIGEST_SCHEMA)
