"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model has a whitespace marker after another character, no
piece crosses from one marked word into the next. A text is then cut into
marked words (a run of markers and the word behind it); each distinct one is
segmented once by the library, and the ids are joined back by position. The
table lives in the task and is emptied when it holds TABLE_WORDS words, so its
memory is bounded whatever the corpus holds. Models for which the condition or
the plain normalization does not hold are encoded text by text.

Results in edge cases: a null or empty text has no ids and decodes to the empty
text; a text of one very long word is one chunk; repeated rows give repeated
results. Bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, text_bytes

TABLE_WORDS = 400_000
MARK = "▁"
#: A word longer than this many characters is segmented but not kept in the table.
KEPT_CHARS = 64
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(maxsize=4)
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Codec:
    """Encodes and decodes with one model. encode() and decode() equal the library's."""

    def __init__(self, path: str) -> None:
        self.model = _processor(path)
        n = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        ordinary = [p for i, p in enumerate(self.pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        probe = "  a ﬁ①  \tB́ \n c  "
        shown = self.model.decode(self.model.encode(probe))
        self.prefixed = self.model.encode("a", out_type=str)[:1] == [f"{MARK}a"] or self.model.encode("a", out_type=str)[:1] == [MARK]
        apart = not any(MARK in p.lstrip(MARK) for p in ordinary)
        self.by_chunk = apart and self.prefixed and shown == probe and self._agrees(probe)
        self.table: dict[str, tuple[int, str, str]] = {}

    def _agrees(self, probe: str) -> bool:
        whole = self.model.encode(probe)
        return whole == [i for c in _MARKED.findall(self._marked(probe)) for i in self._segment([c])[0]]

    @staticmethod
    def _marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of marked words. The library puts one marker before what it gets, so the first is left out."""
        return self.model.encode([c[1:] for c in chunks], num_threads=1) if all(len(c) > 1 for c in chunks) else [self.model.encode(c[1:]) if len(c) > 1 else [self.model.piece_to_id(MARK)] for c in chunks]

    def _plain(self, ids: list[int]) -> str:
        """What ids of whole marked words stand for, with a blank for each marker."""
        out, pending = [], bytearray()
        for i in ids:
            if self.model.is_byte(i):
                pending.append(int(self.pieces[i][3:5], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[i].replace(MARK, " "))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, the decimal ids joined by commas, and what the ids decode to."""
        if not self.by_chunk:
            for t in texts:
                ids = self.model.encode(t)
                yield len(ids), ",".join(map(str, ids)), self.model.decode(ids)
            return
        cut = [self._chunks(t) for t in texts]
        wanted = {c for x in cut for c in x}
        missing = list(wanted - self.table.keys())
        if len(self.table) + len(missing) > TABLE_WORDS:
            self.table.clear()
            missing = list(wanted)
        long = {}
        for chunk, ids in zip(missing, self._segment(missing), strict=True):
            entry = (len(ids), ",".join(map(str, ids)), self._plain(ids))
            if len(chunk) <= KEPT_CHARS and len(self.table) < TABLE_WORDS:
                self.table[chunk] = entry
            else:
                long[chunk] = entry
        look = self.table.__getitem__ if not long else lambda c: self.table.get(c) or long[c]
        for x in cut:
            if not x:
                yield 0, "", ""
                continue
            counts, ids, plain = zip(*map(look, x), strict=True)
            yield sum(counts), ",".join(ids), "".join(plain)[1:]

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return [MARK + w for w in text.split(" ")]
        return _MARKED.findall(self._marked(text))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, "text"):
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()) for n, ids, plain in own.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids."""
    where = docs.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in slices(batches, text):
            texts = [t or "" for t in batch.column(where).to_pylist()]
            rows = [[int(i) for i in joined.split(",")] if n else [] for n, joined, _ in own.encode_all(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int32()))], [*batch.schema.names, ids])

    return bounded(docs).mapInArrow(run, f"{fields}, `{ids}` array<int>")


def decoded(frame: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """frame with the text that each row's ids stand for."""
    where = frame.columns.index(ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _processor(model)
        for batch in batches:
            rows = [library.decode(x) if x else "" for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], [*batch.schema.names, text])

    return bounded(frame).mapInArrow(run, f"{fields}, `{text}` string")
