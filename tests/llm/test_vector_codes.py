"""Vector codes against a plain version by definition, and their edge cases."""

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """rows: (vec_id, vector of 8 * w components, label). By the definition, in Python's integers."""
    kept = sorted((i, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], lab) for i, v, lab in rows)
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(8):
                members[p, near(v, p)[1]].append(part(v, p))
        books = [[[sum(c) // len(c) for c in zip(*members[p, k], strict=True)] if (p, k) in members else e for k, e in enumerate(books[p])] for p in range(8)]
    out, by_label = {}, defaultdict(int)
    for i, v, lab in kept:
        found = [near(v, p) for p in range(8)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab)
        by_label[lab] += out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, by_label[lab], digest) for i, (c, e, lab) in out.items()}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 16), st.integers(1, 40), st.integers(1, 4), st.integers(1, 6), st.randoms(use_true_random=False))
def test_pruned_search_equals_all_distances(k, n, w, spread, random):
    x, book = (np.array([[random.randint(-spread, spread) for _ in range(w)] for _ in range(m)], np.int64) for m in (n, k))
    index, distance, evaluated = vc.nearest(x, book)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and n <= evaluated <= n * k


def test_search_of_spread_norms_evaluates_few():
    rng = np.random.default_rng(1)
    book = (np.arange(1, 17)[:, None] * 10_000) * np.ones((1, 8), np.int64)
    x = book[rng.integers(0, 16, 1000)] + rng.integers(-50, 50, (1000, 8))
    assert vc.nearest(x, book)[2] == 1000
    far = np.array([[vc.LIMIT] * 8, [-vc.LIMIT] * 8], np.int64)
    assert vc.nearest(far, far)[1].tolist() == [0, 0]


def test_codes_equal_the_definition(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=16).astype("f4")], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(120)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(60)]
    got = vc.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == plain(rows)


def test_few_rows_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None] + [0.0] * 6, 1), (3, [nan] * 8, 1), (4, [inf] * 8, 1), (5, [0.5] * 8, 1), (6, [0.5] * 8, None), (6, [0.5] * 8, None), (None, [-0.5] * 8, 2), (9, [1.0] * 3, 1), (10, [3e38] * 8, 3)]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vc.compressed(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert len(got) == 6 and (9, None, None, 0) in got
    assert [g[1:] for g in got if g[0] == 6] == [("00" * 8, 0, 0)] * 2
    assert {g[0]: g[2] for g in got if g[0] != 9} == {5: 0, 6: 0, None: 0, 10: 0}
    for empty in ([], rows[:4]):
        assert vc.compressed(spark.createDataFrame(empty, SCHEMA)).collect() == []
    short = vc.compressed(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, "x", 1), (2, [], 0, "x", 1), (3, [1.0, 2.0, 3.0], 0, "x", 1)], "vec_id long, embedding array<double>, label int, code string, error int")).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in short) == [(1, "00" * 8, 0), (2, None, None), (3, "00" * 8, 0)]


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(40)], "vec_id long, embedding array<double>, label int")
    rows = vc.quantized(frame)
    books = vc.fit(rows)
    back = {r.vec_id: r for r in vc.decoded(vc.encoded(rows, books), books).collect()}
    for r in frame.collect():
        assert abs(((np.array(r.embedding) - back[r.vec_id].vector) ** 2).sum() * 4096**2 - back[r.vec_id].error) <= 0.1 * back[r.vec_id].error + 64 * 4096
