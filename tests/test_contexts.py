"""Contexts, shapes and references over walked documents, against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import contexts, schema_graph
from lodestrata.operators.jsonwalk import walk


def terms_of(context):
    if isinstance(context, list):
        return {k: v for c in context for k, v in terms_of(c).items()}
    out = {}
    for k, v in (context or {}).items() if isinstance(context, dict) else ():
        if not k.startswith("@"):
            if isinstance(v, str) and ":" in v:
                out[k] = (v, None)
            elif isinstance(v, dict) and isinstance(v.get("@id"), str):
                out[k] = (v["@id"], v.get("@type"))
    return out


def plain(value, pointer="", inherited=()):
    """(pointer, term, coercion) of each member outside of contexts."""
    if isinstance(value, list):
        for k, x in enumerate(value):
            yield from plain(x, f"{pointer}/{k}", inherited)
    elif isinstance(value, dict):
        own = {**dict(inherited), **terms_of(value.get("@context"))}
        for k, x in value.items():
            if k != "@context":
                at = f"{pointer}/" + k.replace("~", "~0").replace("/", "~1")
                yield (at, *own.get(k, (k, None)))
                yield from plain(x, at, own)


def document(rng, depth=0):
    names = ["a", "b", "c/d", "e~f", "@type"]
    if depth > 4 or rng.random() < 0.2:
        return rng.choice(["text", 1, None, True, "x:y"])
    if rng.random() < 0.3:
        return [document(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    out = {rng.choice(names): document(rng, depth + 1) for _ in range(rng.randint(1, 4))}
    if rng.random() < 0.6:
        one = lambda: {rng.choice(names): rng.choice(["p:q", "plain", {"@id": "urn:t", "@type": "xsd:d"}, {"@id": 3}, None, {"@id": "urn:u", "a": "no:alias"}]) for _ in range(2)}
        out["@context"] = rng.choice([one(), [one(), one()], "https://x.example/", [[one()], "y"], None])
    return out


def test_terms_equal_plain_recursion(spark):
    rng = random.Random(5)
    docs = [{"root": document(rng), "@context": {"a": "top:a"}} for _ in range(150)]
    frame = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(docs)] + [(900, "no JSON"), (901, None), (902, "[]"), (903, "{}")], "key long, body string")
    got = sorted((r.key, r.pointer, r.term, r.coercion or "") for r in contexts.contextualized(walk(frame)).collect())
    want = sorted((k, at, term, kind or "") for k, x in enumerate(docs) for at, term, kind in plain(json.loads(json.dumps(x))))
    assert got == want and sum(t != p.rsplit("/", 1)[1] for _, p, t, _ in got) > 100


def shapes(value, shape=None, key=None, at=""):
    if key in ("sh:property",):
        for k, p in enumerate(value) if isinstance(value, list) else [("", value)]:
            path = p.get("sh:path") if isinstance(p, dict) else None
            path = path.get("@id") if isinstance(path, dict) else path
            if isinstance(path, str):
                yield (f"{at}/{k}" if k != "" else at, shape, path)
    if isinstance(value, list):
        for k, x in enumerate(value):
            yield from shapes(x, shape, None, f"{at}/{k}")
    elif isinstance(value, dict):
        own = value.get("@id") or value.get("id") or shape
        for k, x in value.items():
            yield from shapes(x, own, k, f"{at}/{k}")


def shape_document(rng, depth=0):
    out = {}
    if rng.random() < 0.4:
        out[rng.choice(["@id", "id"])] = f"urn:{rng.random()}"
    if depth < 5:
        for k in rng.sample(["sh:and", "sh:or", "sh:node", "sh:property"], rng.randint(1, 3)):
            inner = [shape_document(rng, depth + 1) for _ in range(rng.randint(1, 2))]
            out[k] = inner if rng.random() < 0.6 else inner[0]
    if rng.random() < 0.6:
        out["sh:path"] = rng.choice(["urn:p", {"@id": "urn:q"}])
    return out


def test_shapes_equal_plain_recursion(spark):
    rng = random.Random(6)
    docs = [shape_document(rng) for _ in range(60)]
    frame = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(docs)], "key long, body string")
    rows = contexts.shape_properties(frame).collect()
    assert sorted((r.key, r.pointer, r["shape"] or "", r.property_path) for r in rows) == sorted((k, p, s or "", t) for k, x in enumerate(docs) for p, s, t in shapes(x)) and len(rows) > 50


def test_shapes_through_a_context(spark):
    body = {"@context": {"prop": "http://www.w3.org/ns/shacl#property", "path": {"@id": "sh:path"}}, "@id": "urn:s", "prop": {"path": {"@id": "urn:p"}, "sh:name": "N"}}
    (row,) = contexts.shape_properties(spark.createDataFrame([(1, json.dumps(body))], "key long, body string")).collect()
    assert (row.pointer, row["shape"], row.property_path, row.label) == ("/prop", "urn:s", "urn:p", "N")


def test_paths_order_a_whole_walk(spark):
    doc = {"b": [1, {"z": 2, "a": 3}], "a": {"c": [4]}}
    rows = walk(spark.createDataFrame([(1, json.dumps(doc))], "key long, body string")).orderBy("path").select("pointer").collect()
    assert [r.pointer for r in rows] == ["", "/a", "/a/c", "/a/c/0", "/b", "/b/0", "/b/1", "/b/1/a", "/b/1/z"]


@pytest.fixture(scope="module")
def schemas(spark):
    bodies = {
        "https://e.example/a": {"properties": {"x": {"$ref": "b#/$defs/d"}, "y": {"$ref": "#/definitions/own"}}, "definitions": {"own": {"properties": {"z": {"$ref": "#"}}}}},
        "https://e.example/b": {"properties": {"q": {"type": "string"}}, "$defs": {"d": {"properties": {"deep": {"$ref": "https://other.example/c"}}}, "unused": {"properties": {"no": {}}}}},
        "https://e.example/d": {"$ref": 5, "properties": {"$ref": {"type": "string"}}},
    }
    return walk(spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "key string, body string"))


def test_references_and_their_closure(spark, schemas):
    edges = schema_graph.references(schemas)
    a, b, c = "https://e.example/a", "https://e.example/b", "https://other.example/c"
    assert {(r.source, r.target) for r in edges.collect()} == {(a, f"{b}#/$defs/d"), (a, f"{a}#/definitions/own"), (f"{a}#/definitions/own", a), (f"{b}#/$defs/d", c)}
    reached = schema_graph.closure(edges)
    own = {(r.target, r.steps) for r in reached.where(F.col("source") == a).collect()}
    assert own == {(f"{b}#/$defs/d", 1), (f"{a}#/definitions/own", 1), (a, 2), (c, 2)}
    assert {(r.place, r.property) for r in schema_graph.property_paths(schemas, reached).where(F.col("source") == a).collect()} == {(a, "x"), (a, "y"), (f"{a}#/definitions/own", "z"), (f"{b}#/$defs/d", "deep")}
    assert {r.target for r in schema_graph.contained(schemas).collect()} == {f"{a}#/definitions/own", f"{b}#/$defs/d", f"{b}#/$defs/unused"}
    assert schema_graph.closure(edges.limit(0)).collect() == []
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(6)], "source string, target string")
    with pytest.raises(RuntimeError):
        schema_graph.closure(chain, rounds=2)
