"""Operators for training data: brute-force twins on small fixtures, round trips, edge cases and planted cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from lodestrata.llm import byte_bpe, host_reputation, licenses, lm_scoring, media, packing, pieces, quality, queries, simhash, substrings, token_files

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "amber birch cedar dusk ember fjord grove heath inlet jetty knoll larch moor north ocean pine quay ridge shore tarn umber vale weald yew zephyr".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(v) for k, v in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n), strict=True))


def edge_texts():
    """Nulls, empty and odd texts, ties, repeats, other alphabets, one very long text, one very long word."""
    passage = prose(1, 70)
    return [
        None, "", " ", "\n\n", "one", "One two THREE four", "a\tb\x0bc\x0cd\r\ne", prose(2, 120), prose(2, 120), prose(3, 60) + " " + passage, passage + " " + prose(4, 55), passage,
        "日本 語 😀 ß É ﬁ", "  two  spaces  here ", "x" * 5000, prose(5, 4000), "line one here\n" * 30, "Released under the MIT License.", "▁ marks ▁▁ here", "a\x00b", "word " * 200, "MIT License, mit license; general-public license",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(edge_texts())]
    rows += [rows[7], (None, prose(2, 120), None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def local(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def every(frame, *columns):
    """doc_id and columns of all rows, in an order that does not depend on how they were dealt."""
    return sorted((tuple(r) for r in frame.select("doc_id", *columns).collect()), key=repr)


def words_of(text):
    return (text or "").encode().split()


def both(docs, small):
    return docs, small


# ---- language-model scores

def brute_tree(texts, least=None):
    """The score by definition. least: how often contexts of three and four bytes must occur to be in the tree; None: two bytes are all."""
    counts, seen = {}, Counter()
    for t in texts:
        s = b"\xff" * 4 + t + b"\xff"
        for i in range(4, len(s)):
            for depth in range(5):
                seen[s[i - depth : i]] += 1
                for k in range(8):
                    counts.setdefault((s[i - depth : i], k, s[i] >> (8 - k)), [0, 0])[s[i] >> (7 - k) & 1] += 1

    def held(ctx):
        return ctx in seen and (len(ctx) < 3 or (least is not None and len(ctx) < 5 and b"\xff" * 3 not in ctx and seen[ctx] >= least and held(ctx[1:])))

    kids = {c: [k for k in seen if len(k) == len(c) + 1 and k[1:] == c and held(k)] for c in seen if held(c)}

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pair(ctx, k, p):
        return counts.get((ctx, k, p), (0, 0))

    def rest(ctx, k, p):
        a, b = pair(ctx, k, p)
        return a - sum(pair(c, k, p)[0] for c in kids[ctx]), b - sum(pair(c, k, p)[1] for c in kids[ctx])

    def weighted(ctx, k, p):
        if not kids[ctx]:
            return log_kt(*pair(ctx, k, p))
        return math.log(0.5) + np.logaddexp(log_kt(*pair(ctx, k, p)), log_kt(*rest(ctx, k, p)) + sum(weighted(c, k, p) for c in kids[ctx]))

    def score(t):
        s, total = b"\xff" * 4 + t + b"\xff", 0.0
        for i in range(4, len(s)):
            path = [b""]
            while kids[path[-1]] and len(path) < 5 and s[i - len(path) : i] in kids[path[-1]]:
                path.append(s[i - len(path) : i])
            for k in range(8):
                p = s[i] >> (8 - k)
                deepest = rest(path[-1], k, p) if kids[path[-1]] else pair(path[-1], k, p)
                q = (deepest[1] + 0.5) / (sum(deepest) + 1)
                for ctx in reversed(path if kids[path[-1]] else path[:-1]):
                    a, b = pair(ctx, k, p)
                    stop = math.exp(math.log(0.5) + log_kt(a, b) - weighted(ctx, k, p))
                    q = stop * (b + 0.5) / (a + b + 1) + (1 - stop) * q
                total += math.log10(q if s[i] >> (7 - k) & 1 else 1 - q)
        return total

    return score


def test_tree_equals_its_definition():
    texts = [b"abracadabra", b"abcabc", b"", b"zz"]
    codes, counts = lm_scoring.triples(texts)
    tree, brute = lm_scoring.ByteTree.trained(codes.astype(np.int64), counts), brute_tree(texts)
    for t in (b"", b"abra", b"zebra", b"\xc3\xa9"):
        assert tree.scores([b"x", t])[1] == pytest.approx(brute(t), abs=1e-5)


def test_deep_tree_equals_its_definition(spark):
    texts = ["abracadabra abracadabra", "abcabcabcabc", None, "zz abra", "abrab cabra"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model, brute = lm_scoring.train(frame, share=4 / 60), brute_tree([(t or "").encode() for t in texts], 4)
    assert len(model.tree.child) > 10
    for t in (b"", b"abracadabra", b"cabcab", b"zebra", b"\xc3\xa9"):
        assert model.tree.scores([b"x", t, b""])[1] == pytest.approx(brute(t), abs=1e-5)
    assert np.allclose((10.0 ** model.tree.table.astype(np.float64)).sum(1), 1, atol=1e-4)


def test_tree_is_a_distribution():
    codes, counts = lm_scoring.triples([b"some text", b"and more of it"])
    tree = lm_scoring.ByteTree.trained(codes.astype(np.int64), counts)
    assert np.allclose((10.0 ** tree.table.astype(np.float64)).sum(1), 1, atol=1e-4)


def test_scores_and_base(docs, small):
    for frame in both(docs, small):
        rows = local(frame)
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        low = lambda t: (t or "").encode().lower().split()
        c, ends = Counter(), 0
        for i, t in rows:
            if not held(i):
                c.update(low(t))
                ends += 1
        n, v = sum(c.values()) + ends, len(c) + 1
        want = sorted(((i, held(i), len(low(t)) + 1, sum(c[w] > 0 for w in low(t)) + 1, n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)) + math.log10((ends + 1) / (n + v + 1)), 5)) for i, t in rows), key=repr)
        found = lm_scoring.learn_and_score(frame)
        got = every(found.withColumn("base_score", F.round("base_score", 5)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=2e-5)
        assert found.where("score > 0 or score is null").count() == 0


def test_rare_words_are_looked_up_whatever_the_head(small):
    train = small.where("doc_id % 2 = 0")
    few, all_ = (every(lm_scoring.score(small, lm_scoring.train(train, head=h)).withColumn("b", F.round("base_score", 6)), "n_known", "b") for h in (3, 200_000))
    assert few == all_


def test_trained_model_beats_an_untrained_one_on_held_out_texts(small):
    found = lm_scoring.learn_and_score(small).where("held_out")
    assert found.agg(F.sum("score") / F.sum("n_tokens")).first()[0] < 0 and found.agg(F.avg("bits_per_byte")).first()[0] < 4


def brute_whole_tree(texts):
    """The score by definition over contexts of up to lm_scoring.DEPTH bytes: all of up to three that were seen, longer ones that were seen at least lm_scoring.LEAST times."""
    top, counts, seen = lm_scoring.DEPTH, {}, Counter()
    for t in texts:
        s = b"\xff" * top + t + b"\xff"
        for i in range(top, len(s)):
            for depth in range(top + 1):
                seen[s[i - depth : i]] += 1
                for k in range(8):
                    counts.setdefault((s[i - depth : i], k, s[i] >> (8 - k)), [0, 0])[s[i] >> (7 - k) & 1] += 1
    kids = {}
    for c, n in seen.items():
        if c and (len(c) <= 3 or n >= lm_scoring.LEAST):
            kids.setdefault(c[1:], []).append(c)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pair(ctx, k, p):
        return counts.get((ctx, k, p), (0, 0))

    def rest(ctx, k, p):
        return tuple(pair(ctx, k, p)[j] - sum(pair(c, k, p)[j] for c in kids.get(ctx, [])) for j in (0, 1))

    def weighted(ctx, k, p):
        if ctx not in kids:
            return log_kt(*pair(ctx, k, p))
        return math.log(0.5) + np.logaddexp(log_kt(*pair(ctx, k, p)), log_kt(*rest(ctx, k, p)) + sum(weighted(c, k, p) for c in kids[ctx]))

    def score(t):
        s, total = b"\xff" * top + t + b"\xff", 0.0
        for i in range(top, len(s)):
            path = [b""]
            while s[i - len(path) : i] in kids.get(path[-1], []):
                path.append(s[i - len(path) : i])
            for k in range(8):
                p = s[i] >> (8 - k)
                a, b = rest(path[-1], k, p)
                q = (b + 0.5) / (a + b + 1)
                for ctx in reversed(path):
                    a, b = pair(ctx, k, p)
                    stop = math.exp(math.log(0.5) + log_kt(a, b) - weighted(ctx, k, p)) if ctx in kids else 1
                    q = stop * (b + 0.5) / (a + b + 1) + (1 - stop) * q
                total += math.log10(q if s[i] >> (7 - k) & 1 else 1 - q)
        return total

    return score


@pytest.mark.parametrize("gram_head", [0, 40, 4_000_000])
def test_scores_equal_the_whole_tree_whatever_the_head(spark, gram_head):
    texts = ["abracadabra abracadabra", "abcabcabcabc", None, "zz abra", "abrab cabra"]
    asked = [*texts, "", "abracadabra", "cabcab", "zebra", "é"]
    brute = brute_whole_tree([(t or "").encode() for t in texts])
    model = lm_scoring.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score(frame, model, gram_head=gram_head).collect()}
    assert [got[k] for k in range(len(asked))] == pytest.approx([brute((t or "").encode()) for t in asked], abs=1e-4)


def test_no_share_of_the_corpus_is_asked_of_a_context(spark):
    passage = "quixotic zephyrs vex jumbled wyverns"
    frame = spark.createDataFrame([(k, prose(k, 400)) for k in range(60)] + [(100 + k, passage) for k in range(8)], "doc_id long, text string")
    model = lm_scoring.train(frame, share=1 / 32)
    found = lm_scoring.score(spark.createDataFrame([(0, passage)], "doc_id long, text string"), model).first()
    assert found.score > model.tree.scores([passage.encode()])[0] + 5


def test_bits_that_a_frequent_context_never_took_have_finite_scores():
    """Less than what single precision holds beside 1: as of a context of 10**8 line ends of which none has another bit at a node."""
    rng = np.random.default_rng(0)
    for n in np.geomspace(1e6, 1e9, 60):
        codes, counts = np.array([0x0A0A0A, 0x0A780A]), np.array([n, n * rng.uniform()])
        nodes = np.sort(np.add.outer(codes >> 8 << 8, np.arange(255)).ravel())
        top = lm_scoring.Top.trained(codes, counts, nodes, np.full(len(nodes), lm_scoring._log_kt(np.zeros(1), np.array([n]))[0] + rng.uniform(-20, 20)))
        rare, given = 0.5 / (n + 1), np.full((1, 8), 1.0)
        given[0, 4] = rare  # line ends are 0000 1010, the symbol is 0000 0010
        found = top.logs(np.array([0x0A0A << 40 | 0x0A0A0A0A << 8 | 0x02]), given)
        assert np.isfinite(found).all() and found[0] > math.log10(rare) - 2
    assert np.allclose(top.zero + top.one + top.left, 1, atol=1e-6)


# ---- URLs

URLS = [None, "", "no-scheme.example.com/x", "HTTP://WWW.Example.COM/en/1?q#f", "https://example.com/en/x", "https://a.example.com/en/", "https://example.com/fr/en/", "https://x.net/es/1", "https://net/fr/2", "https://x.netz/es/1", "https://example.com", "https://example.com?x=/en/", "https://u@h.co.uk:8080/p", "https://10.0.0.1/x", "a://b.com/x://y/"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)] + [(None, "https://example.com/en/x")], "page_id long, url string")
    got = {r.page_id: r for r in host_reputation.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    low = str.maketrans(host_reputation.UPPER, host_reputation.LOWER)
    rules = [(h, p, v) for h, p, v in host_reputation.RULES]
    for k, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.split("[/?#]", rest, maxsplit=1)[0].translate(low) if rest is not None else ""
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0] if rest is not None else ""
        fits = sorted(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        r = got[k]
        assert (r.host, r.path, r["rule"], r.verdict) == (host, path, fits[0][1] if fits else None, fits[0][2] if fits else "allow"), u
    assert got[None]["rule"] == "example.com/en/"


def test_bad_hosts_are_blocked_and_thin_evidence_is_shrunk(spark):
    rows = [(k, f"https://{'spam' if k % 2 else 'good'}.site{k % 20}.org/{k}") for k in range(400)] + [(1000, "https://new.site1.org/x"), (1001, "https://once.site2.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2 == 1) for k in range(400)] + [(1001, True), (5, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in host_reputation.judge(pages, labels).collect()}
    assert {got[k].verdict for k in range(1, 400, 2)} == {"block"} and {got[k].verdict for k in range(0, 400, 2)} == {"allow"}
    assert got[1001].verdict == "allow" and len(got) == 402


@pytest.mark.parametrize("limit", [0.5, 0.2])
def test_posterior_mass_equals_an_integral(spark, limit):
    cases = [(a, b) for a in (0.05, 0.7, 1.0, 3.5, 40.0, 4000.0) for b in (0.05, 1.0, 2.5, 90.0, 4200.0)]
    frame = spark.createDataFrame([(a / (a + b), a + b) for a, b in cases], "rate double, total double")
    got = [r[0] for r in frame.coalesce(1).select(host_reputation.below(F.col("rate"), F.col("total"), limit)).collect()]

    def brute(a, b):
        u = np.linspace(-800, 800, 4_000_001)
        log = -a * np.logaddexp(0, -u) - b * np.logaddexp(0, u)
        mass = np.exp(log - log.max())
        return mass[u <= math.log(limit / (1 - limit))].sum() / mass.sum()

    assert got == pytest.approx([brute(a, b) for a, b in cases], abs=5e-4)


def test_suffixes_are_a_parameter(spark):
    pages = spark.createDataFrame([(1, "https://a.b.co.uk/x"), (2, "https://a.b.my.tld/x"), (3, "https://10.0.0.1:80/x"), (4, "https://u@co.uk/")], "page_id long, url string")
    of = lambda *s: {r.page_id: (r.domain, r.suffix) for r in host_reputation.with_parts(pages, "url", *s).collect()}
    assert of() == {1: ("b.co.uk", "co.uk"), 2: ("my.tld", "tld"), 3: ("10.0.0.1", "address"), 4: ("co.uk", "co.uk")}
    assert of(("my.tld",)) == {1: ("co.uk", "uk"), 2: ("b.my.tld", "my.tld"), 3: ("10.0.0.1", "address"), 4: ("co.uk", "uk")}


def test_of_repeated_labels_the_worst_counts_and_other_columns_change_nothing(spark):
    pages = spark.createDataFrame([(k, f"https://h{k % 3}.org/{k}") for k in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 3 == 1) for k in range(60)] + [(1, False), (1, True), (None, True)], "page_id long, bad boolean")
    wide = pages.withColumns({n: F.lit("x") for n in ("host", "path", "domain", "suffix", "bad", "n", "rate", "_url", "prior")})
    got = [sorted(map(repr, host_reputation.judge(p, labels).select("page_id", "host", "verdict").collect())) for p in (pages, wide)]
    assert got[0] == got[1] and sum("block" in r for r in got[0]) == 20


def test_url_filter_on_an_empty_table(spark):
    assert host_reputation.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


# ---- SimHash

def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def brute_components(prints, radius=4):
    """prints: (id, fingerprint). The smallest id that is reachable, by fingerprint."""
    values = sorted({f for _, f in prints})
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {v: least.get(find(v)) for v in values}


def test_fingerprints_and_components(docs, small):
    for frame in both(docs, small):
        prints = [(i, brute_print(t)) for i, t in local(frame)]
        named = brute_components(prints)
        want = sorted(((i, f, named[f]) for i, f in prints), key=repr)
        got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=repr)
        assert got == want


@pytest.mark.parametrize("group, radius", [(16_384, 4), (7, 4), (3, 2)])
def test_links_of_dense_groups_whole_and_dealt_out(spark, group, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    chain = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(12))])
    values = np.unique(chain)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, radius, group)).collect()}
    named = brute_components([(int(v), int(v)) for v in values], radius)
    classes = {}
    for v in values:
        signed = int(v.view(np.int64))
        classes.setdefault(roots.get(signed, signed), set()).add(named[int(v)])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len(set(named.values()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_forest_joins_what_is_near(values, radius):
    array = np.array(values, np.uint64)
    found = {int(v): int(v) for v in array}
    for a, b in zip(*simhash.forest(array, None, radius), strict=True):
        found[int(array[a])] = int(array[b])
    named = brute_components([(v, v) for v in values], radius)
    assert len({found[v] for v in values}) == len(set(named.values()))


def brute_copies(rows, similarity=0.8):
    """By id, the smallest id that is reachable over pairs whose sets of five-word shingles have the Jaccard similarity."""
    sets, where = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for i, own in sets.items():
        for x in own:
            where.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("group, cell_bytes", [(simhash.GROUP, simhash.CELL_BYTES), (30, 3_000)])
def test_near_copies_equal_brute_force(docs, spark, group, cell_bytes):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame in (docs, whole):
        found = simhash.near_copies(frame, group=group, cell_bytes=cell_bytes).collect()
        want = brute_copies(local(frame))
        assert len(found) == frame.count() and all(r.component_id == want.get(r.doc_id) for r in found)


def test_a_large_group_of_near_copies_is_joined_through_others(spark):
    """A chain: neighbours are similar, its ends are not, and the group goes to many cells."""
    words = prose(8, 400).split()
    rows = [(k, " ".join(words[k : k + 120])) for k in range(0, 240, 4)] + [(1000 + k, prose(k, 120)) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame, group=8, cell_bytes=5_000).collect()}
    assert found == brute_copies(rows) and {found[k] for k in range(0, 240, 4)} == {0} and all(found[1000 + k] == 1000 + k for k in range(20))


def test_tiles_over_all_fingerprints_find_the_same_links(docs, small):
    for frame in both(docs, small):
        assert every(simhash.near_duplicates(frame, all_tiles=True), "fp", "component_id") == every(simhash.near_duplicates(frame), "fp", "component_id")
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40)
    values = np.unique(np.concatenate([base, base ^ (1 << rng.integers(0, 63, 40)), base ^ (1 << rng.integers(0, 63, 40))]))
    nodes = small.sparkSession.createDataFrame([(int(v),) for v in values], "fp long")
    few, all_ = ({(r.node, r.root) for r in simhash.components(f(nodes, 4, 16)).collect()} for f in (simhash.links, simhash.tiled_links))
    assert few == all_ and few


def test_one_of_copies_stays(docs):
    kept = [r.doc_id for r in simhash.one_of_copies(docs).collect()]
    assert kept.count(7) == 1 and 8 not in kept and kept.count(None) == 2
    assert simhash.one_of_copies(docs).columns == docs.columns and simhash.one_of_copies(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(docs, spark):
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert kept.count(7) == 1 and 8 not in kept and kept.count(None) == 2
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ---- SentencePiece

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def test_pieces_equal_the_library(docs, small, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for frame in both(docs, small):
        want = []
        for i, t in local(frame):
            ids = library.encode(t or "")
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
        assert every(pieces.digests(frame, queries.PIECE_MODEL), "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" ▁ab\n\té日😀\u00a0\u3000.", max_size=30))
def test_pieces_of_odd_texts(text):
    model = pieces.codec(queries.PIECE_MODEL)
    assert model.by_chunk
    ids = model.model.encode(text)
    assert next(model.encode_all([text])) == (len(ids), ",".join(map(str, ids)), model.model.decode(ids) if ids else "")


def test_piece_round_trip(docs):
    back = pieces.decoded(pieces.encoded(docs, queries.PIECE_MODEL), queries.PIECE_MODEL)
    assert all((r.text or "").replace("▁", " ") == r.decoded for r in back.collect()) and back.columns == [*docs.columns, "ids", "decoded"]


# ---- quality

def brute_quality(text):
    t = text or ""
    w = words_of(t)
    starts = {}
    for k in range(len(w) - 7):
        starts.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {q for ks in starts.values() if len(ks) > 1 for k in ks for q in range(k, k + 8)}
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_quality_measures(docs, small):
    for frame in both(docs, small):
        got = every(quality.judge(frame), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        assert [g[:-1] for g in got] == sorted(((i, *brute_quality(t)) for i, t in local(frame)), key=repr)
        assert not any(g[-1] and g[-2] for g in got)


@pytest.mark.parametrize("texts", [[], [b""], [b"a"], [b"", b"a b c d e f", b""], [b"a b c d e f g h"]])
def test_quality_of_few_words(texts):
    assert list(quality.measure(texts)["n_words"]) == [len(t.split()) for t in texts]


def test_quality_keeps_clean_texts_and_drops_repetition(docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert {7, 9, 10, 15} <= ids and not {16, 20, 0, 1} & ids


# ---- packing

def test_packing_is_whole_and_tight(docs, small):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    for frame in both(docs, small):
        rows = local(frame)
        ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
        want = Counter()
        for (i, _), x in zip(rows, ids, strict=True):
            for k, (s, n) in enumerate(packing.cut(len(x))):
                want[i, k, s, n, zlib.crc32(x[s : s + n].tobytes())] += 1
        got = packing.packed(frame, queries.BYTE_BPE).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 1024
        total = sum(map(len, ids))
        assert len(bins) <= -(-total // 1024) + 2 + sum(len(x) % 1024 > 512 for x in ids) // 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_local_search_keeps_bins_whole_and_never_adds_one(lengths):
    array = np.array(lengths, np.int64)
    number, place = packing.pack(array, 40)
    first = packing.best_fit(np.sort(array)[::-1], 40)
    assert len(set(number.tolist())) <= len(first)
    for b in set(number.tolist()):
        own = sorted((int(place[i]), int(array[i])) for i in np.flatnonzero(number == b))
        assert [p for p, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 40


def triplets(seed, bins=40, most=1000):
    """Lengths that fill so many bins by threes."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < 3 * bins:
        a, b = rng.integers(260, 480, 2)
        if 250 < most - a - b < 500:
            out += [a, b, most - a - b]
    return np.array(out)


def test_swaps_empty_bins_where_best_fit_does_not():
    for seed in range(15):
        lengths = triplets(seed)
        first, ours = len(packing.best_fit(np.sort(lengths)[::-1], 1000)), len(set(packing.pack(lengths, 1000)[0].tolist()))
        assert 40 <= ours < first and ours <= 42


def test_cut():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


# ---- token files

def test_fast_engine_is_the_same():
    own = byte_bpe.Encoder(queries.BYTE_BPE)
    assert own.fast is not None
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    for t in [t or "" for t in edge_texts()] + ["don't  DON'T 12a3", "<|endoftext|> x", "a\x1c b\x85c"]:
        assert own.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_use_their_library():
    own = byte_bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert own.fast is None and own.encode(["Some words"])[0].size


def test_token_files_hold_all_ids_in_order(docs, small):
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    for frame in both(docs, small):
        rows = sorted(local(frame), key=lambda r: (r[0] is not None, r[0]))
        at, want = 0, []
        for i, t in rows:
            x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((i, at, len(x), zlib.crc32(x.tobytes())))
            at += len(x)
        got = [tuple(r) for r in token_files.read(token_files.write(frame, queries.BYTE_BPE)).collect()]
        known = lambda rs: sorted((r for r in rs if r[0] is not None), key=repr)
        assert known(got) == known(want)
        assert sorted(r[2:] for r in got if r[0] is None) == sorted(r[2:] for r in want if r[0] is None)


def test_token_files_over_several_parts_and_blocks(small, monkeypatch):
    whole = sorted(map(tuple, token_files.read(token_files.write(small, queries.BYTE_BPE)).collect()))
    monkeypatch.setattr(token_files, "PART_IDS", 20_000)
    files = token_files.write(small, queries.BYTE_BPE)
    assert files.select("part").distinct().count() > 5
    assert sorted(map(tuple, token_files.read(files).collect())) == whole
    assert {r.doc_id: len(r.ids) for r in token_files.token_ids(files).collect()} == {r[0]: r[2] for r in whole}


def test_token_files_of_an_empty_table(docs):
    assert token_files.read(token_files.write(docs.limit(0), queries.BYTE_BPE)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=900), st.integers(6, 12))
def test_codes_are_limited_prefix_codes(ids, most):
    array = np.array(ids)
    counts = np.bincount(array, minlength=50)
    lengths = token_files.code_lengths(counts, most)
    assert lengths.max() <= most and sum(2.0 ** -int(n) for n in lengths if n) <= 1
    code = token_files.Code(lengths)
    data, offsets = code.encode(array)
    assert (code.decode(data, len(array), offsets) == array).all()


def test_code_lengths_are_optimal_without_a_limit():
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64])
    assert token_files.code_lengths(counts, 18).tolist() == [7, 7, 6, 5, 4, 3, 2, 1]
    assert token_files.code_lengths(counts, 4).max() == 4
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(20, np.int64), 4)


def test_more_ids_than_the_limit_has_room_for_widen_it():
    lengths = token_files.code_lengths(np.ones((1 << 18) + 5, np.int64))
    assert lengths.max() > 18 and token_files.Code(lengths).most == lengths.max()
    ids = np.array([0, 7, (1 << 18) + 4] * 300)
    data, offsets = token_files.Code(lengths).encode(ids)
    assert (token_files.Code(lengths).decode(data, len(ids), offsets) == ids).all()


def test_one_id_with_most_rows_goes_to_several_parts(spark, monkeypatch):
    frame = spark.createDataFrame([(5, prose(3, 40))] * 300 + [(None, "x y")] * 200 + [(k, "a b c") for k in range(20)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(token_files, "PART_IDS", 2_000)
    files = token_files.write(frame, queries.BYTE_BPE)
    assert files.where("part >= 0").groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 8_000
    found = token_files.read(files).orderBy("start").collect()
    assert len(found) == 520 and [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids) and len({r.ids_crc32 for r in found if r.doc_id is None}) == 1


def test_repeated_rows_are_dealt_to_all_shards(spark):
    frame = spark.createDataFrame([(5, prose(3, 40))] * 400, "doc_id long, text string").repartition(4)
    pieces = packing.pieces(frame, queries.BYTE_BPE)
    got = packing.assign(pieces, shard=50).collect()
    assert len(got) == 400 and len({r.sequence_id // 3 >> 32 for r in got if r.sequence_id % 3 == 1}) != 1
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.2 * sum(fill.values()) / 1024 + 1


def test_damaged_blocks_are_found():
    code = token_files.Code(token_files.code_lengths(np.array([3, 2, 1])))
    block = token_files.write_block(np.array([1]), np.array([3]), np.array([0, 1, 2]), 0, code)
    assert token_files.read_block(block, code)[2].tolist() == [0, 1, 2]
    for bad in (b"XXXX" + block[4:], block[:-1], block[:-1] + bytes([block[-1] ^ 128])):
        with pytest.raises(ValueError):
            token_files.read_block(bad, code)


# ---- licenses

def brute_license(text):
    low = str.maketrans(licenses.UPPER, licenses.LOWER)
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate(low))
    w = find(text or "")
    places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    found, best = {label for _, label in places}, 0.0
    at = 0
    for line in (text or "").split("\n"):
        n = len(find(line))
        block = lambda t, a=at, z=at + n: set(w[a : z + len(t.split())]) & set(t.split())
        hits = [(len(block(t)), k, label, len(block(t)) / len(set(t.split()))) for k, (t, label) in enumerate(licenses.TEMPLATES)] if n else []
        at += n
        hits = [h for h in hits if h[3] >= licenses.THRESHOLD - 1e-9]
        if hits:
            found.add(max(hits)[2])
            best = max(best, *(h[3] for h in hits))
    starts = [k for k, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    return len(w), len(places), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(found)), 1.0 if places else best


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "Licensed under CC BY-NC 4.0.", "licensed under CC", "Licensed under the Apache License, Version 2.0",
    "/*\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted,\n */", "Copyright. Redistribution and use in\n\nsource and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:", "Licensed\nunder\nCC\nBY-NC\n4.0", "other words first, permission is hereby\r\ngranted, free of charge, to any person obtaining a copy\r\nof this software and associated documentation files",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "the of is a to", "x\nReleased under the MIT License\ny\nLicensed under CC BY 4.0",
]


def test_license_scan(docs, small, spark):
    more = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(NOTICES)], DOC)
    for frame in (docs, small, more):
        got = every(licenses.scan(frame).withColumn("score", F.round("score", 9)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        want = sorted(((i, *brute_license(t)[:6], round(brute_license(t)[6], 9)) for i, t in local(frame)), key=repr)
        assert got == want


def test_wrapped_notices_are_found(spark):
    text = {"isc": NOTICES[4], "bsd": NOTICES[5], "cc-by-nc": NOTICES[6], "mit": NOTICES[7]}
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(text.values())] + [(9, "Licensed to nobody\nunder a rock"), (10, "CC")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(frame).collect()} == dict(enumerate(text)) | {9: "", 10: ""}
    table = spark.createDataFrame(licenses.TEMPLATES, "text string, label string")
    assert every(licenses.scan(frame, table), "labels", "score") == every(licenses.scan(frame), "labels", "score")
    assert {r.labels for r in licenses.scan(frame, ()).collect()} == {""}


def test_license_join_at_other_thresholds(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(25)]
    templates = tuple((" ".join(rng.choice(vocabulary, 8, replace=False)), f"l{k}") for k in range(6))
    texts = ["\n".join(" ".join(rng.choice(vocabulary, 12)) for _ in range(4)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    for threshold in (0.5, 0.75, 1.0):
        want = set()
        for i, t in enumerate(texts):
            for b in range(4):
                want |= {(i, b, k) for k, (words, _) in enumerate(templates) if len(set(words.split()) & set(t.split()[12 * b : 12 * b + 20])) / 8 >= threshold}
        assert {(r.doc_id, r.block, r.template) for r in licenses.matches(frame, templates, threshold).collect()} == want


def test_native_plans_run_no_python(spark, small):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for frame in (licenses.scan(small), host_reputation.judge(pages.select("page_id", "url"), pages.select("page_id", F.lit(True).alias("bad")))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ---- media

def test_media_digests(docs, small):
    for frame in both(docs, small):
        want = []
        for i, t in local(frame):
            raw = (t or "").encode()
            padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
            want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
        found = media.digests(media.store(frame))
        assert every(found, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
        assert found.groupBy("payload_sha256").agg(F.count_distinct("media_sha256", "feature").alias("n")).where("n > 1").count() == 0


def test_media_tables_and_keyframes():
    data = media.write_container(media.pad(bytes(range(256)) * 100))
    (track,) = media.read_container(data)
    frames = -(-25600 // 192)
    assert (track.codec, track.handler, track.timescale, track.samples) == ("raw", "soun", 8000, frames)
    assert track.keys.tolist() == list(range(0, frames, 16)) and track.ranges(track.keys)[0] == (32, 224)
    assert media.payload_of(data, track)[:25600] == bytes(range(256)) * 100


def test_media_of_other_shapes():
    box = media._box
    full = media._full
    table = box(b"stbl", full(b"stsd", b"\0\0\0\1", box(b"avc1")), full(b"stsz", (0).to_bytes(4, "big"), (3).to_bytes(4, "big"), b"".join(n.to_bytes(4, "big") for n in (5, 6, 7))), full(b"stsc", (2).to_bytes(4, "big"), *(n.to_bytes(4, "big") for n in (1, 2, 1, 2, 1, 1))), full(b"co64", (2).to_bytes(4, "big"), (8).to_bytes(8, "big"), (40).to_bytes(8, "big")), full(b"stss", (1).to_bytes(4, "big"), (3).to_bytes(4, "big")))
    data = box(b"mdat", bytes(60)) + box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", bytes(8), (600).to_bytes(4, "big"), (1200).to_bytes(4, "big"), bytes(4)), box(b"minf", table))))
    (track,) = media.read_container(data)
    assert track.codec == "avc1" and track.ranges() == [(8, 19), (40, 47)] and track.ranges(track.keys) == [(40, 47)] and track.duration == 1200


def fragmented():
    """A movie without samples of its own, and two fragments of two samples each; the second runs from its moof, with flags by sample."""
    box, full = media._box, media._full
    u = lambda *n: b"".join(k.to_bytes(4, "big") for k in n)
    track = box(b"trak", full(b"tkhd", u(0, 0, 7, 0)), box(b"mdia", full(b"mdhd", u(0, 0, 600, 0)), box(b"minf", box(b"stbl", full(b"stsd", u(1), box(b"avc1"))))))
    movie = box(b"moov", track, box(b"mvex", full(b"trex", u(7, 1, 100, 5, media.NO_SYNC))))
    one = lambda at: box(b"moof", box(b"traf", full(b"tfhd", u(7), flags=0x20000), full(b"trun", u(2, at, 0), flags=0x5)))
    first = one(len(one(0)) + 8) + box(b"mdat", b"aaaaabbbbb")
    two = lambda at: box(b"moof", box(b"traf", full(b"tfhd", u(7), flags=0x20000), full(b"trun", u(2, at, 3, media.NO_SYNC, 4, 0), flags=0x601)))
    return movie + first + two(len(two(0)) + 8) + box(b"mdat", b"cccdddd")


def test_fragments_are_read(spark):
    data = fragmented()
    (track,) = media.read_container(data)
    assert media.payload_of(data, track) == b"aaaaabbbbbcccdddd" and track.samples == 4 and track.duration == 400
    assert [data[a:b] for a, b in track.ranges(track.keys)] == [b"aaaaa", b"dddd"]
    row = media.inspect(spark.createDataFrame([(data,), (data.replace((7).to_bytes(4, "big"), (8).to_bytes(4, "big"), 1),)], "media binary")).collect()
    assert row[0].problem is None and row[0].tracks[0].samples == 4 and row[1].problem


def test_compact_sizes_and_deep_boxes():
    u = lambda *n: b"".join(k.to_bytes(4, "big") for k in n)
    for width, raw in ((4, b"\x56\x70"), (8, b"\5\6\7"), (16, b"\0\5\0\6\0\7")):
        body = media._full(b"stz2", u(width, 3), raw)
        assert media._sizes(body, 8, len(body), b"stz2").tolist() == [5, 6, 7]
    data = b""
    for _ in range(3000):
        data = media._box(b"udta", data)
    assert sum(1 for _ in media.walk(data)) == 3000


def test_keyframe_ranges_are_columns(docs):
    row = media.digests(media.store(docs)).where("doc_id = 15").first()
    frames = row.payload_bytes // 192
    assert row.codec == "raw" and row.duration == row.payload_bytes and len(row.key_starts) == -(-frames // 16)
    assert all(b - a == 192 for a, b in zip(row.key_starts, row.key_ends, strict=True)) and row.key_starts[1] - row.key_starts[0] == 16 * 192


def test_damaged_media_is_reported(spark):
    whole = media.write_container(media.pad(b"x"))
    rows = [(None,), (b"",), (b"no box",), (whole[:300],), (whole[:-20],), (whole,), (b"\0\0\0\x08moov",)]
    found = media.inspect(spark.createDataFrame(rows, "media binary")).collect()
    assert [r.problem is None for r in found] == [False] * 5 + [True, False]
    assert found[5].tracks[0].codec == "raw" and found[5].tracks[0].key_starts == [32]


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 700), st.integers(0, 255))
def test_changed_bytes_never_crash_the_reader(at, value):
    data = bytearray(media.write_container(media.pad(b"x" * 200)))
    data[at % len(data)] = value
    try:
        media.read_container(bytes(data))
    except ValueError:
        pass


# ---- substrings

def brute_substrings(rows, window=50):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs, small):
    for frame in both(docs, small):
        assert every(substrings.digests(frame), "n_words", "n_removed", "kept_sha256") == brute_substrings(local(frame))


def test_substrings_with_other_windows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert every(substrings.digests(frame, 8, 4), "n_words", "n_removed", "kept_sha256") == brute_substrings(list(enumerate(texts)), 8)


def test_counting_every_window_gives_the_same(docs, small):
    for frame in both(docs, small):
        assert every(substrings.digests(frame, every=True), "n_words", "n_removed", "kept_sha256") == every(substrings.digests(frame), "n_words", "n_removed", "kept_sha256")


def test_removal_keeps_rows_columns_and_untouched_texts(docs):
    after = substrings.remove(docs)
    assert after.columns == docs.columns and after.count() == docs.count()
    texts = {r.doc_id: r.text for r in after.collect()}
    before = dict(local(docs))
    assert all(texts[i] == before[i] for i in (0, 1, 5, 6, 13, 15) if i in texts)
    assert texts[8] == "" and texts[11] == "" and texts[10].split() == prose(4, 55).split()


def test_removal_stores_only_what_is_read_twice(docs, monkeypatch):
    tables = {}
    monkeypatch.setattr(substrings, "stored", lambda df, label, f=substrings.stored: tables.setdefault(label, f(df, label)))
    substrings.remove(docs)
    assert set(tables) == {"prepared", "copies", "windows"}
    assert not any("text" in t.columns for t in tables.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_rolling_hashes_and_minimizers(values, length):
    ids = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = substrings.rabin_karp(ids, length, substrings._B1)
    want = []
    for k in range(len(values) - length + 1):
        h = 0
        for v in ids[k : k + length].tolist():
            h = (h * int(substrings._B1) + v) % (1 << 64)
        want.append(h)
    assert got.tolist() == want
    for width in range(1, len(got) + 1):
        assert substrings._sliding_min(got, width).tolist() == [min(want[k : k + width]) for k in range(len(want) - width + 1)]


# ---- all of them

def odd(spark, docs):
    """The documents with other kinds of columns beside them, whose names the operators use inside."""
    return docs.withColumns({n: F.lit(1) for n in ("row", "fp", "seeds", "text_hash", "starts", "kept", "word", "n", "_row", "key", "label")} | {"day": F.lit(datetime(2020, 1, 1))})


def test_clashing_columns_change_nothing(spark, docs):
    wide = odd(spark, docs)
    runs = (
        lambda f: simhash.near_duplicates(f), lambda f: quality.judge(f).drop("dup_ngram_shares"), lambda f: substrings.digests(f).drop("intervals"), lambda f: licenses.scan(f), lambda f: media.digests(media.store(f)),
        lambda f: pieces.digests(f, queries.PIECE_MODEL), lambda f: packing.packed(f, queries.BYTE_BPE).select("doc_id", "piece", "length", "ids_crc32"), lambda f: token_files.read(token_files.write(f, queries.BYTE_BPE)).select("doc_id", "n_tokens", "ids_crc32"),
    )
    for run in runs:
        a, b = run(docs), run(wide)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for stage in (quality.keep, substrings.remove, simhash.one_of_each, simhash.one_of_copies):
        assert stage(wide).columns == wide.columns


def test_empty_tables(docs):
    none = docs.limit(0)
    for found in (lm_scoring.learn_and_score(none), simhash.near_duplicates(none), pieces.digests(none, queries.PIECE_MODEL), quality.judge(none), packing.packed(none, queries.BYTE_BPE), licenses.scan(none), media.digests(media.store(none)), substrings.digests(none)):
        assert found.count() == 0


def test_stages_on_empty_tables(docs):
    none = docs.limit(0)
    for stage in (quality.keep, substrings.remove, simhash.one_of_each, simhash.one_of_copies):
        assert stage(none).count() == 0 and stage(none).columns == docs.columns


def test_scores_do_not_depend_on_other_columns(spark, docs):
    wide = odd(spark, docs)
    a, b = (every(lm_scoring.learn_and_score(f).withColumn("s", F.round("score", 3)), "n_tokens", "n_known", "s") for f in (docs, wide))
    assert a == b


def test_queries_are_registered():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


# ---- pipeline

def test_pipeline_equals_its_brute_force_twin(spark, small):
    rows = [r for r in sorted(local(small)) if not brute_quality(r[1])[5]]
    kept = {r.doc_id for r in quality.judge(small).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    named = brute_copies(rows)
    rows = [(i, t) for i, t in rows if named[i] == i]
    removed = {r[0]: r for r in brute_substrings(rows)}
    stage = None
    docs = small
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = f(spark, docs, SF)
        assert sorted(docs.columns) == sorted(small.columns), k
    stage = {r.doc_id: r for r in docs.collect()}
    assert stage.keys() == removed.keys()
    for i, r in stage.items():
        assert hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() == removed[i][3] and r.n_chars == len(r.text)
    out = corpus_pipeline.run(spark, SF).collect()
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    want = {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in stage.items()}
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert dict(got) == want
