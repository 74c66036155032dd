"""Repetition coverage: how much of a text lies inside duplicated n-grams and lines.

Every text is read once, without a shuffle. For each slice of texts the words
become 64-bit numbers, and rolling hashes of several n-gram lengths are built in
numpy from one another. Only windows whose shorter window is repeated can be
repeated themselves, so the candidates shrink as the length grows. Windows of
equal hashes are confirmed by the 64-bit hashes of each of their words.

Results in edge cases: a null or empty text has no words and fails the base
rule; repeated rows are judged one by one; an empty table gives an empty result;
other columns of the input are ignored by judge() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, text_bytes

#: Largest share of the characters of a text that may lie in repeats of an n-gram that came before, by length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of the characters in lines that may lie in repeats of an earlier line. The share of lines is measured
#: but not judged: in a text of a few lines, one short repeated line says nothing.
LINE_CHAR_LIMIT = 0.20
BASE_WINDOW, BASE_MIN_WORDS, BASE_PERCENT = 8, 20, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_share double, dup_line_char_share double, dup_ngram_shares array<double>, base_failed boolean, kept boolean"
)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(hashes: np.ndarray, owner: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that start at `at`: those whose words occur elsewhere in their text, and those that occur earlier in it."""
    if not len(at):
        return at, at
    key = hashes ^ (owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    key, place = key[order], at[order]
    same = key[1:] == key[:-1]
    if same.any():  # a hash alone proves nothing
        hit = np.flatnonzero(same)
        equal = owner[place[hit]] == owner[place[hit + 1]]
        for k in range(length):
            equal &= ids[place[hit] + k] == ids[place[hit + 1] + k]
        same[hit] = equal
    later = np.concatenate([[False], same])
    return np.sort(place[later | np.concatenate([same, [False]])]), np.sort(place[later])


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of that length from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The measures of each text."""
    lists = [t.split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    n = int(counts.sum())
    words = [w for x in lists for w in x]
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    first = ends - counts
    if n:  # code points of a word: its bytes but for the continuation bytes
        joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        width = np.fromiter(map(len, words), np.int64, n) + 1
        chars = np.add.reduceat((joined & 0xC0) != 0x80, np.cumsum(width) - width, dtype=np.int64) - 1
    else:
        chars = np.zeros(0, np.int64)

    def by_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[ends] - total[first]

    out = {"n_words": counts, "word_chars": by_text(chars)}
    everything = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.cumsum([0, *map(len, texts)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[everything], dtype=np.int64)])
    out["n_symbols"] = symbols[sizes[1:]] - symbols[sizes[:-1]]

    dup_lines, lines, dup_chars, line_chars = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i] = len(own)
        line_chars[i] = sum(map(len, own))
        if len(own) > len(set(own)):
            seen: set[bytes] = set()
            for x in own:
                if x in seen:
                    dup_lines[i] += 1
                    dup_chars[i] += len(x)
                else:
                    seen.add(x)
    out |= {"n_dup_lines": dup_lines, "dup_line_share": dup_lines / np.maximum(lines, 1), "dup_line_char_share": dup_chars / np.maximum(line_chars, 1)}

    shares, out["n_repeat_words"] = [], np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        rolling, length, alive = ids, 1, None
        for goal in sorted({*lengths, BASE_WINDOW}):
            while length < goal:
                m = max(len(rolling) - 1, 0)
                rolling = rolling[:m] * _MULTIPLIER + ids[length : length + m]
                length += 1
            at = np.arange(len(rolling)) if alive is None else alive[alive < len(rolling)]
            at = at[owner[at] == owner[at + goal - 1]] if len(at) else at
            alive, later = _repeated(rolling[at], owner, at, ids, goal)
            if goal == BASE_WINDOW:
                out["n_repeat_words"] = by_text(_covered(alive, goal, n))
            if goal in lengths:
                shares.append(by_text(np.where(_covered(later, goal, n), chars, 0)) / np.maximum(out["word_chars"], 1))
    out["dup_ngram_shares"] = np.array(shares).T if shares else np.zeros((len(texts), 0))
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limits = np.array(list(NGRAM_LIMITS.values()))
    for batch in slices(batches, "text"):
        m = measure(batch.column(1).to_pylist())
        failed = (m["n_words"] < BASE_MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
        good = (m["dup_line_char_share"] <= LINE_CHAR_LIMIT) & (m["dup_ngram_shares"] <= limits).all(1)
        own = [pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "dup_line_char_share")]
        shares = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(limits), m["dup_ngram_shares"].ravel())
        columns = [batch.column(0), *own, shares, pa.array(failed), pa.array(good & ~failed)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "dup_line_char_share", "dup_ngram_shares", "base_failed", "kept"])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of measures and verdicts for each row of docs."""
    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(_judge, SCHEMA)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns: one pass, no join."""
    kinds = docs.schema
    names = docs.columns
    where = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw = batch.column(where)
            id_free = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), raw.cast(pa.binary()).fill_null(b"")], ["doc_id", "text"])
            for verdict in _judge(iter([id_free])):
                yield batch.filter(verdict.column(verdict.num_columns - 1))

    return bounded(docs).mapInArrow(run, kinds)
