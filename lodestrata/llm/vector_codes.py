"""Compression of vectors to codes: each part of a vector becomes the index of its nearest codebook entry.

Components become integers, so all distances are exact. Entries of a codebook are
sorted by norm. An entry whose norm differs from a part's by more than the best
distance so far cannot be nearer, so the entries that may still win are an
interval of norms; a binary search finds its ends, again after each better entry,
and only entries inside, ends included, are evaluated. Entries at the distance
of the best stay inside, so ties go to the lower index as they should.

Codebooks are learned in rounds over a stored table of integer vectors. A task adds
up what it has assigned; at most a row for each part and entry leaves it, and
a round brings one row for each component of each codebook to the driver,
however many vectors there are.

Results in edge cases: rows whose vector is null or holds null or non-finite
components are left out. The first of the other rows (smallest id, a null id last,
equal ids by vector) sets the length; a vector of another length stays, with null
code and error. Lengths that PARTS does not divide are cut as evenly as can be; a
part of no components has code 0 and error 0. Fewer rows than ENTRIES give fewer
entries, no rows an empty result. Repeated rows give repeated results. Components
beyond LIMIT / SCALE are brought to it, so that distances fit 64 bits up to 128
components. An error sum of a label beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest integer component.
LIMIT = 2**27
#: A label with more than this share of the rows is joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 0.001


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the index of the nearest row of book, the squared distance, and how many distances were evaluated."""
    n, k = len(x), len(book)
    squares = (book * book).sum(axis=1)
    order = np.argsort(squares, kind="stable")
    entries, norms = book[order], np.sqrt(squares[order].astype(np.float64))
    own = np.sqrt((x * x).sum(axis=1).astype(np.float64))

    at = np.clip(np.searchsorted(norms, own), 0, k - 1)
    before = np.maximum(at - 1, 0)
    at = np.where(np.abs(norms[before] - own) <= np.abs(norms[at] - own), before, at)
    best = ((x - entries[at]) ** 2).sum(axis=1)
    winner, evaluated = order[at], n

    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def narrow(rows: np.ndarray) -> None:
        # what rounding could move an end by is far below this
        radius = np.sqrt(best[rows].astype(np.float64)) + 1e-9 * (own[rows] + norms[-1]) + 1e-6
        low[rows], high[rows] = np.searchsorted(norms, own[rows] - radius, "left"), np.searchsorted(norms, own[rows] + radius, "right")

    narrow(np.arange(n))
    for step in range(1, k):
        for j in (at - step, at + step):
            rows = np.flatnonzero((low <= j) & (j < high))
            if not len(rows):
                continue
            evaluated += len(rows)
            distance, index = ((x[rows] - entries[j[rows]]) ** 2).sum(axis=1), order[j[rows]]
            better = (distance < best[rows]) | ((distance == best[rows]) & (index < winner[rows]))
            gained = rows[better]
            best[gained], winner[gained] = distance[better], index[better]
            narrow(gained)
        if not ((low <= at - step) | (at + step < high)).any():
            break
    return winner, best, evaluated


def bounds(length: int, parts: int = PARTS) -> list[int]:
    """Where parts begin, and the length."""
    return [length * p // parts for p in range(parts + 1)]


@dataclass(frozen=True)
class Codebooks:
    """length: of a vector. books: for each part its entries, each a tuple of integers."""

    length: int
    books: tuple[tuple[tuple[int, ...], ...], ...]

    def arrays(self) -> list[np.ndarray]:
        cuts = bounds(self.length, len(self.books))
        return [np.array(b, np.int64).reshape(len(b), cuts[p + 1] - cuts[p]) for p, b in enumerate(self.books)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book for v in entry).encode()).hexdigest()


def quantized(frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and the integer vector q of the rows whose vector is whole and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(x.cast("double") * SCALE).cast("double"))).cast("int")
    # floor of a double beyond 64 bits saturates there
    return frame.where(F.col(vector).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(vector, whole).alias("q"))


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the right length as a matrix, and which these are."""
    right = np.asarray(pa.compute.list_value_length(column)) == length
    kept = column.filter(pa.array(right))
    return np.asarray(kept.flatten(), dtype=np.int64).reshape(len(kept), length), right


def _sums(books: Codebooks):
    """A pass that gives, for each part and entry, the number of parts that it is nearest to and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, cuts = books.arrays(), bounds(books.length, len(books.books))
        counts = [np.zeros(len(b), np.int64) for b in arrays]
        sums = [np.zeros(b.shape, np.int64) for b in arrays]
        for batch in batches:
            matrix, _ = _matrix(batch.column(0), books.length)
            for p, book in enumerate(arrays):
                part = matrix[:, cuts[p] : cuts[p + 1]]
                index, _, _ = nearest(part, book)
                counts[p] += np.bincount(index, minlength=len(book))
                for e in range(len(book)):
                    sums[p][e] += part[index == e].sum(axis=0)
        rows = [(p, e, int(n), sums[p][e].tolist()) for p in range(len(arrays)) for e, n in enumerate(counts[p]) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "sums"])

    return run


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, cuts = books.arrays(), bounds(books.length, len(books.books))
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            matrix, right = _matrix(batch.column(2), books.length)
            error, code = np.zeros(len(matrix), np.int64), np.full(len(matrix), "", "<U1")
            for p, book in enumerate(arrays):
                index, distance, _ = nearest(matrix[:, cuts[p] : cuts[p + 1]], book)
                error += distance
                code = np.char.add(code, digits[index])
            place = np.where(right, np.cumsum(right) - 1, -1)
            take = pa.array(place, mask=place < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()).take(take), pa.array(error).take(take)], ["vec_id", "label", "code", "error"])

    return run


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the stored rows of quantized(); None for no rows. entries is at most 256."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    if not first:
        return None
    length = len(first[0].q)
    cuts = bounds(length, parts)
    seeds = [r.q for r in first if len(r.q) == length]
    books = Codebooks(length, tuple(tuple(tuple(q[cuts[p] : cuts[p + 1]]) for q in seeds) for p in range(parts)))
    for _ in range(rounds):
        each = bounded(rows).select("q").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        # a null position stands for the count, so that empty parts have one too
        cells = each.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
        total = {(r.part, r.entry, r["at"]): int(r.value) for r in cells.groupBy("part", "entry", "at").agg(exact("value").alias("value")).collect()}
        moved = lambda p, e, old: tuple(total[p, e, i + 1] // total[p, e, 0] for i in range(len(old))) if (p, e, 0) in total else old
        books = Codebooks(length, tuple(tuple(moved(p, e, old) for e, old in enumerate(book)) for p, book in enumerate(books.books)))
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error of the rows of quantized()."""
    kind = rows.schema["label"].dataType.simpleString()
    return bounded(rows).select("vec_id", "label", "q").mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long")


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", vector: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for, at the middle of what its integers hold; null for a null code."""
    table = F.array(*(F.array(*(F.array(*(F.lit((v + 0.5) / SCALE) for v in entry)) for entry in book)) for book in books.books))
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(table, F.lit(p)), index(p)) for p in range(len(books.books))]
    return codes.withColumn(vector, F.when(F.col(code).isNotNull(), F.concat(*parts)))


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes, a stored table, with label_error: the sum of error over equal labels, nulls together.

    Labels with many rows are few, so their sums are broadcast and their rows stay where they are; the others are joined by label.
    """
    sums = stored(codes.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    rows = sums.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") > HOT_SHARE * rows
    few, rest = F.broadcast(sums.where(hot).drop("_n")), sums.where(~hot).drop("_n")
    join = lambda left, right, how: left.alias("l").join(right.alias("r"), F.col("l.label").eqNullSafe(F.col("r.label")), how)
    fields = [*(F.col(f"l.{c}") for c in codes.columns), "r.label_error"]
    return join(codes, few, "inner").select(*fields).unionByName(join(join(codes, few, "left_anti").select("l.*"), rest, "inner").select(*fields))


def compressed(frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each row with a whole, finite vector."""
    rows = stored(quantized(frame, vec_id, vector, label), "vectors")
    books = fit(rows)
    if books is None:
        return rows.select("vec_id", "label", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    return with_label_error(stored(encoded(rows, books), "codes")).withColumn("codebooks_sha256", F.lit(books.sha256()))


def _sql() -> str:
    """The rounds as one query over lists, with an integer square for each component."""
    w = f"len(v) // {PARTS}"
    distance = "list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        "q AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings\n  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"s AS MATERIALIZED (SELECT n, p, list_slice(v, p * ({w}) + 1, (p + 1) * ({w})) AS v FROM q, (SELECT unnest(range({PARTS})) AS p))",
        f"b0 AS (SELECT p, n - 1 AS e, v FROM s WHERE n <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"d{r} AS (SELECT s.n, s.p, b.e, {distance} AS d FROM s JOIN b{r} b ON s.p = b.p)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT n, p, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e FROM d{r} GROUP BY 1, 2)")
        if r < ROUNDS:
            ctes.append(f"t{r} AS (SELECT p, e, i, sum(x)::BIGINT AS t, count(*) AS c FROM (SELECT a.p, a.e, unnest(range(len(s.v))) AS i, unnest(s.v) AS x FROM a{r} a JOIN s ON a.n = s.n AND a.p = s.p) GROUP BY 1, 2, 3)")
            ctes.append(f"m{r} AS (SELECT p, e, list((t - (((t % c) + c) % c)) // c ORDER BY i) AS v FROM t{r} GROUP BY 1, 2)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    ctes.append(f"o AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    joined = ",\n".join(ctes)
    return f"WITH {joined}\nSELECT q.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY q.label))::BIGINT AS label_error, h.codebooks_sha256 FROM q JOIN o ON q.n = o.n, h"


OP11_SQL = _sql()
