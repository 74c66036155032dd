"""SimHash near-duplicates by tiled exact comparison.

1. Fingerprints: one pass over the texts. Equal fingerprints become one node at
   once (with map-side combination), so exact copies cost nothing later.
2. Tiles: fingerprints are sorted by population count and cut into tiles; tiles
   are compared with numpy exclusive-or and bit counts, but for tile pairs whose
   population counts differ beyond the radius. links() does so within what shares
   a key: a fingerprint is cut into radius + 2 blocks, and two that differ in at
   most `radius` bits agree in two blocks at least, so they meet under one of the
   keys made of two blocks. tiled_links() does so over all fingerprints, whose
   work grows with their square. Both find every link, and the tests hold them
   against one another; near_duplicates() takes the first unless told otherwise.
   What is more than GROUP fingerprints is dealt out as pairs of parts.
3. A task reports the spanning forest of the links that it has found, never all
   pairs; star contraction joins the forests to components.

near_copies() is for near-duplicates by words: the same tiles, within what shares
a word shingle that two sets of the wanted similarity must share, give candidate
groups; there the exact Jaccard similarity of the shingle sets decides.

Results in edge cases: texts without words have the fingerprint zero and are
linked like any other; a null text counts as empty; rows with a null id get a
component like others (the smallest id that is not null, null if there is none),
but near_copies() gives them a null component; repeated rows are repeated in the
result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded, discard, free_name, slices, stored, text_bytes

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one key that one task compares, and those of one tile.
GROUP, TILE = 16_384, 1_024
#: Near-duplicates by words: their least Jaccard similarity, the words of a shingle, and the radius of the fingerprints of 128 bits
#: that are compared by their shingles. At a similarity of 0.8 they differ in 19.4 bits on average, with a deviation of 4.1; those
#: of unrelated texts in 64, with a deviation of 5.7.
SIMILARITY, NEAR_SHINGLE, NEAR_RADIUS = 0.8, 5, 36
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose shingle sets one task compares with one another.
CELL_BYTES = 500_000


def _shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts, repeats included, and how many each text has."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(xxh64_intdigest(line, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        hashes += [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        counts[i] = len(starts)
    return np.array(hashes, np.uint64), counts


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that over half the hashes of a text have."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(counts) - counts)[full]
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    return _majority(*_shingle_hashes(texts, shingle))


def shingle_sets(texts: list[bytes], shingle: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    hashes, counts = _shingle_hashes(texts, shingle)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(texts) else []


def _wide(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of 128 bits, in two rows."""
    with np.errstate(over="ignore"):
        other = (hashes ^ hashes >> np.uint64(32)) * _MIX
    return np.stack([_majority(hashes, counts), _majority(other ^ other >> np.uint64(29), counts)])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1_000_000):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist()).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


def _key_columns(radius: int) -> F.Column:
    """The keys of a fingerprint: each pair of blocks with its number."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    width = max(hi - lo for lo, hi in zip(edges, edges[1:], strict=False))
    keys = []
    for n, (a, b) in enumerate(combinations(range(blocks), 2)):
        keys.append(F.lit(n << (2 * width)).cast("long").bitwiseOR(F.shiftleft(block[a], width)).bitwiseOR(block[b]))
    return F.array(*keys)


class _Forest:
    """Union-find whose roots can be read as an array."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join the ends of all links. Each round joins the first open link of every root, so dense tiles end after a few rounds."""
        while len(left):
            roots = self.roots()
            a, b = roots[left], roots[right]
            open_ = a != b
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            if not len(left):
                return
            _, first = np.unique(np.maximum(a, b), return_index=True)
            self.parent[np.maximum(a, b)[first]] = np.minimum(a, b)[first]


def forest(values: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS, size: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of links that join all values within the radius of one another (through others, too). values: fingerprints, or rows of their words. With sides, only values of different sides are compared; with sizes, only links between sizes of the similarity count."""
    values = np.atleast_2d(values)
    weight = np.bitwise_count(values).sum(0, dtype=np.int16)
    order = np.argsort(weight, kind="stable")
    values, weight = values[:, order], weight[order]
    side = None if side is None else side[order]
    size = None if size is None else size[order]
    found = _Forest(len(order))
    cuts = range(0, len(order), TILE)
    for a in cuts:
        one = values[:, a : a + TILE, None]
        for b in cuts:
            if b < a:
                continue
            if int(weight[b]) - int(weight[min(a + TILE, len(order)) - 1]) > radius:
                break  # the tiles behind are heavier still
            apart = np.bitwise_count(one[0] ^ values[0, None, b : b + TILE])
            for k in range(1, len(values)):
                apart += np.bitwise_count(one[k] ^ values[k, None, b : b + TILE])
            near = apart <= radius
            if side is not None:
                near &= side[a : a + TILE, None] != side[None, b : b + TILE]
            left, right = np.nonzero(near)
            left, right = left + a, right + b
            if size is not None:
                alike = np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right]) - 1e-9
                left, right = left[alike], right[alike]
            found.link(left, right)
    roots = found.roots()
    own = np.flatnonzero(roots != np.arange(len(order)))
    return order[own], order[roots[own]]


def _compare(radius: int, similarity: float = 0.0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and cell; a group that goes on in the next batch waits for it. Columns: key, cell, side, fp; or also the fingerprint's other half, the size of the set, and what a link names."""
        rest: list[np.ndarray] | None = None
        for last, batch in _with_last(batches):
            cols = None if batch is None else [np.asarray(c) for c in batch.columns]
            if rest is not None:
                cols = rest if cols is None else [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            group, cell, side, fp = cols[:4]
            wide = len(cols) > 4
            node, size = (cols[6], cols[5]) if wide else (fp, None)
            words = np.stack(cols[3:5] if wide else cols[3:4]).view(np.uint64)
            new = np.flatnonzero((group[1:] != group[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(group)]])
            if not last:
                rest = [c[bounds[-2] :] for c in cols]
                bounds = bounds[:-1]
            sizes = np.diff(bounds)
            left, right = [], []
            pairs = np.flatnonzero(sizes == 2)  # most groups of more than one: no loop
            at = bounds[pairs]
            near = np.bitwise_count(words[:, at] ^ words[:, at + 1]).sum(0) <= radius
            near &= (side[at] != side[at + 1]) | (cell[at] < 0)
            if wide:
                near &= np.minimum(size[at], size[at + 1]) >= similarity * np.maximum(size[at], size[at + 1]) - 1e-9
            left.append(node[at][near])
            right.append(node[at + 1][near])
            for k in np.flatnonzero(sizes > 2):
                a, b = bounds[k], bounds[k + 1]
                x, y = forest(words[:, a:b], None if cell[a] < 0 else side[a:b], radius, size[a:b] if wide else None, similarity)
                left.append(node[a:b][x])
                right.append(node[a:b][y])
            x, y = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


def _grouped_links(keyed: DataFrame, radius: int, group: int, similarity: float = 0.0) -> DataFrame:
    """A spanning forest (a, b) of the links within each key. keyed: key, fp; or key, fp, fp2, n, node."""
    names = [c for c in keyed.columns if c != "key"]
    # as a table its size is known when the join is planned: where it is small, keys are shuffled once only
    large = stored(keyed.groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / group).cast("int").alias("parts")), "large")
    part = F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")
    low, high = F.least(F.col("part"), F.col("other")), F.greatest(F.col("part"), F.col("other"))
    dealt = (
        keyed.join(large, "key", "left")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        .select(
            "key",
            # -1: compare all with all; else the pair of parts, of which equal parts are compared all with all, too
            F.when(F.col("parts").isNull(), F.lit(-1).cast("long")).when(low == high, -2 - low.cast("long")).otherwise(low.cast("long") * F.col("parts") + high).alias("cell"),
            F.coalesce(F.col("part"), F.lit(0)).cast("long").alias("side"),
            *names,
        )
    )
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare(radius, similarity), "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """A spanning forest (a, b) of all pairs of fingerprints in nodes.fp that differ in at most `radius` bits. nodes.fp must be distinct."""
    return _grouped_links(nodes.select(F.explode(_key_columns(radius)).alias("key"), "fp"), radius, group)


def tiled_links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """The same links from tiles over all fingerprints: those of a population count are dealt out to parts of about `group`, and each pair of parts within the radius is compared by one task. A fingerprint goes to as many tasks as there are such parts."""
    weighed = nodes.select("fp", F.bit_count("fp").alias("weight"))
    sizes = {r.weight: r["count"] for r in weighed.groupBy("weight").count().collect()}  # 65 rows at most
    parts = {w: -(-n // group) for w, n in sizes.items()}
    first = {w: sum(parts[v] for v in parts if v < w) for w in parts}
    own, cells = None, None
    for w in sorted(parts):
        mine = F.pmod(F.xxhash64("fp"), F.lit(parts[w])) + first[w]
        reach = [v for v in parts if abs(v - w) <= radius]
        others = F.sequence(F.lit(first[min(reach)]).cast("long"), F.lit(first[max(reach)] + parts[max(reach)] - 1).cast("long"))
        own = F.when(F.col("weight") == w, mine) if own is None else own.when(F.col("weight") == w, mine)
        cells = F.when(F.col("weight") == w, others) if cells is None else cells.when(F.col("weight") == w, others)
    if own is None:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    dealt = weighed.select("fp", own.alias("part"), F.explode(cells).alias("other"))
    dealt = dealt.select(low.alias("key"), F.when(low == high, F.lit(-1).cast("long")).otherwise(high).alias("cell"), F.col("part").alias("side"), "fp")
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each end of an edge (a, b): large and small stars in turn, each round cut off by a table in the shared folder.

    The joins are on the complement of the key: an exchange then stands on either
    side, which adaptive execution can split where a star's centre is frequent.
    Rounds grow with the logarithm of a component's diameter; beyond `rounds` it raises.
    """
    up = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = stored(up(edges), "edges")
    before, other = None, F.bitwise_not("a").alias("other")
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.select("*", other).join(least.select(other, "m"), "other").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.select("*", other).join(lower.select(other, "m"), "other").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = stored(up(small), "edges")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        discard(state)
        state = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", all_tiles: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs. all_tiles: compare the tiles of all fingerprints."""
    prints = stored(fingerprints(docs, doc_id, text), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components((tiled_links if all_tiles else links)(nodes.select("fp"), radius))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least, other = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), F.bitwise_not("root").alias("other")
    named = rooted.select("fp", other).join(least.select(other, "component_id"), "other").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


PRINTED = "doc_id long, fp long, fp2 long, set_hash long, n int, prefix array<long>"


def _print_sets(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = shingle_sets(batch.column(1).to_pylist(), shingle)
            sizes = np.array([len(x) for x in sets], np.int64)
            prefix = [x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1] if len(x) else x for x in sets]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            own = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefix).view(np.int64)))
            hashed = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fp, fp2 = _wide(np.concatenate(sets), sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(fp2), pa.array(hashed), pa.array(sizes.astype(np.int32)), own], ["doc_id", "fp", "fp2", "set_hash", "n", "prefix"])

    return run


def near_sets(sets: list[np.ndarray], fp: np.ndarray, side: np.ndarray | None, similarity: float, radius: int) -> list[tuple[int, int]]:
    """Places of the ends of links that join all sets of the Jaccard similarity (through others, too), whose fingerprints are within the radius. With sides, only sets of different sides are compared."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    n, fp = sizes[order], fp[:, order]
    _, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    flat = flat.astype(np.int32)
    ends = np.cumsum(n)
    starts = ends - n
    label, mark, out = np.arange(len(sets)), np.zeros(int(flat.max(initial=-1)) + 1, bool), []
    side = None if side is None else side[order]
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(n, n[i] / similarity + 1e-9, "right"))  # larger sets cannot be similar
        near = (np.bitwise_count(fp[:, i + 1 : stop] ^ fp[:, i, None]).sum(0) <= radius) & (label[i + 1 : stop] != label[i])
        if side is not None:
            near &= side[i + 1 : stop] != side[i]
        for_ = np.flatnonzero(near) + i + 1
        if not len(for_):
            continue
        mark[flat[starts[i] : ends[i]]] = True
        for j in for_:
            if label[j] == label[i]:
                continue
            common = int(np.count_nonzero(mark[flat[starts[j] : ends[j]]]))
            if common >= similarity * (n[i] + n[j] - common) - 1e-9:
                label[label == label[j]] = label[i]
                out.append((int(order[i]), int(order[j])))
        mark[flat[starts[i] : ends[i]]] = False
    return out


def _compare_sets(shingle: int, similarity: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and cell; a cell is compared when its last row has come. Only sets and fingerprints are held."""
        own, ids, sides, sets, prints = None, [], [], [], []

        def found() -> pa.RecordBatch:
            kept = near_sets(sets, np.concatenate(prints, 1), None if own[1] < 0 else np.array(sides), similarity, radius) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in kept], pa.int64()), pa.array([ids[j] for _, j in kept], pa.int64())], ["a", "b"])

        for batch in slices(batches, "text", 1_000_000):
            new = shingle_sets(batch.column(4).to_pylist(), shingle)
            fp = _wide(np.concatenate(new), np.array([len(x) for x in new], np.int64))
            for k, (*key, part, doc) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if key != own:
                    if own:
                        yield found()
                    own, ids, sides, sets, prints = key, [], [], [], []
                ids.append(doc)
                sides.append(part)
                sets.append(new[k])
                prints.append(fp[:, k : k + 1])
        if own:
            yield found()

    return run


def _similar_to_root(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            out = []
            for doc, root, text, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = shingle_sets([text, of], shingle)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= similarity * (len(a) + len(b) - common) - 1e-9:
                    out.append((doc, root))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return run


def _exact_links(members: DataFrame, shingle: int, similarity: float, radius: int, cell_bytes: int) -> DataFrame:
    """Links (a, b) that join what is similar within each candidate group (root, doc_id, text).

    A group of up to cell_bytes is compared in one task. Of a larger one, each text is
    first compared with the group's first, which is dealt out with the parts; only
    texts that are not similar to it are then compared with all, part by part.
    """
    size = members.groupBy("root").agg(F.sum(F.octet_length("text") + 8).alias("bytes"))
    large = stored(size.where(F.col("bytes") > cell_bytes).select("root", F.ceil(F.col("bytes") / cell_bytes).cast("int").alias("parts")), "large")
    compare = lambda df: df.repartition("root", "cell").sortWithinPartitions("root", "cell").select("root", "cell", "side", "doc_id", "text").mapInArrow(_compare_sets(shingle, similarity, radius), "a long, b long")
    small = compare(members.join(large, "root", "left_anti").select("root", F.lit(-1).alias("cell"), F.lit(0).alias("side"), "doc_id", "text"))
    if large.isEmpty():
        return small
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    hot = members.join(large, "root").withColumn("part", dealt("parts"))
    first = hot.where("doc_id = root").select("root", F.col("text").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).dropDuplicates(["root", "part"])
    star = stored(hot.join(first, ["root", "part"]).select("doc_id", "root", "text", "of").mapInArrow(_similar_to_root(shingle, similarity), "a long, b long").distinct(), "star")
    other = stored(hot.join(star, hot.doc_id == star.a, "left_anti"), "other")
    rows = other.groupBy("root").agg(F.ceil(F.sum(F.octet_length("text") + 8) / cell_bytes).cast("int").alias("rows"))
    left = other.join(rows, "root").select("root", dealt("rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(0).alias("side"), "doc_id", "text")
    right = hot.join(rows, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "part", "parts", F.lit(1).alias("side"), "doc_id", "text")
    grid = left.unionByName(right).select("root", (F.col("row") * F.col("parts") + F.col("part")).alias("cell"), "side", "doc_id", "text")
    return small.unionByName(star).unionByName(compare(grid))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, radius: int = NEAR_RADIUS, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(doc_id, component_id) for each row of docs: the smallest id that is reachable over pairs of texts whose sets of word shingles have the Jaccard similarity or more.

    Of two sets that similar, the smallest common hash is among the size -
    ceil(similarity * size) + 1 smallest of either. What shares such a hash is
    compared in tiles of fingerprints, and what is linked so is a candidate group.
    Similar pairs beyond the radius are missed: at 0.8, about one in 40,000.
    """
    base = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    prints = stored(base.mapInArrow(_print_sets(shingle, similarity), PRINTED), "prints")
    same = ["set_hash", "fp", "n"]
    nodes = stored(prints.where("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node")), "nodes")
    own = prints.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    loose = components(_grouped_links(own.select(F.explode("prefix").alias("key"), "fp", "fp2", "n", F.col("doc_id").alias("node")), radius, group, similarity))
    members = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("doc_id"), "root")
    members = stored(base.join(members, "doc_id").select("root", "doc_id", "text"), "members")
    found = components(_exact_links(members, shingle, similarity, radius, cell_bytes)).withColumnRenamed("root", "least")
    named = nodes.join(found, "node", "left").select(*same, F.coalesce("least", "node").alias("component_id"))
    known = prints.where("doc_id is not null").join(named, same).select("doc_id", "component_id")
    return known.unionByName(prints.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id")))


def _firsts(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of each component the row of docs with the smallest id, once. Rows with a null id stay."""
    mark, number = free_name(docs, "_kept_id"), free_name(docs, "_row")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id).cast("long") == F.col(mark), "left_semi")
    # repeated rows of one id have one row left; the join has put an id's rows together
    once = named.withColumn(number, F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(text)))).where(F.col(number) == 1).drop(number)
    return once.unionByName(docs.where(F.col(doc_id).isNull()))


def one_of_each(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates by fingerprint: of each component the row with the smallest id stays, once. Rows with a null id stay."""
    return _firsts(docs, near_duplicates(docs, radius, doc_id, text), doc_id, text)


def one_of_copies(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates by words: of each component of near_copies() the row with the smallest id stays, once. Rows with a null id stay."""
    return _firsts(docs, near_copies(docs, similarity, doc_id=doc_id, text=text), doc_id, text)
