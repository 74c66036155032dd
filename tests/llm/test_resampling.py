"""Importance resampling against a plain version by definition, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lodestrata.llm import resampling as rs

SF = "/root/testdata/sf0.001"


def features(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, Counter(w) + Counter(a + b" " + b for a, b in zip(w, w[1:]))


def plain(docs, target):
    bucket = lambda f: zlib.crc32(f) % 10_000
    count = lambda texts: sum((Counter({b: 0}) for b in ()), Counter(b for t in texts for f, n in features(t)[1].items() for b in [bucket(f)] * n))
    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000))))
    rows = []
    for i, x in docs:
        w, f = features(x)
        n = f.total()
        weight = sum(gain(bucket(g)) * c for g, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    k = 25 * len(fit) // 100
    return fit[:k], rows


def check(got, docs, target):
    top, rows = plain(docs, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted((r[:4] for r in rows), key=repr)
    ranks = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [(r.rank, r.doc_id, r.n_features, r.weight, r.score) for r in ranks] == [(k + 1, *r[:4]) for k, r in enumerate(top)]


@pytest.mark.parametrize("size", [rs.SLICE_BYTES, 20_000])
def test_draw_equals_the_definition(spark, monkeypatch, size):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    if size != rs.SLICE_BYTES:  # more slices than one: as many partitions, as workers have the constant of the module
        docs = docs.repartition(9)
    got = rs.drawn(docs, target).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_edge_cases(spark):
    long = "Alpha beta " * 40
    texts = [(1, None), (2, ""), (3, " ,.; "), (4, "One"), (5, "two TWO two"), (6, long), (6, long), (6, long + "x"), (None, long), (7, "é É 日本 a1-b2 " * 10), (8, "z" * 300_000), (9, "a\x00b\nc " * 30)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id long, text string, score int, slice string").repartition(3)
    target = spark.createDataFrame([(1, "alpha beta two"), (2, None), (3, "")], "item_id long, text string")
    check(rs.drawn(docs, target).collect(), texts, ["alpha beta two", None, ""])
    check(rs.drawn(docs, target.limit(0)).collect(), texts, [])
    assert rs.drawn(docs.limit(0), target).collect() == []


def test_slices_are_cut_by_bytes(spark):
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(range(5)), "text": [b"a b c " * 600_000] * 5})
    rows = [b.to_pylist()[0] for b in rs._slice(iter([batch]))]
    assert [r["ids"] for r in rows] == [[0, 1], [2, 3], [4]] and len({r["slice"] for r in rows}) == 3
