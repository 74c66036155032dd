"""Rules of the plain JSON formats over walked documents, on newly written documents."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import json_rules
from lodestrata.plans import report

AT = "https://town.example/doc"
ODD = ("[]", "3", '"x"', "null", '{"links": 3, "servers": 4, "paths": [], "datasets": {}, "collections": 1}')
SCHEMA = {"$id": "urn:s", "properties": {"a/b": {"items": {"properties": {"c": {}}}}, "z": {"properties": ["no"], "items": [{"properties": {"no": {}}}]}}, "allOf": [{"properties": {"d": {"$ref": "x.json"}}}], "enum": [{"properties": {"no": 1}}]}
API = {"openapi": "3.1.0", "info": {"title": ["", {"@value": "Trees"}]}, "servers": [3, {"url": "/v1"}, {"url": "/v2"}], "externalDocs": {"url": "d"}, "paths": {"/x": {"get": {"operationId": "x"}, "parameters": [], "POST": 3}, "/y": []}}
LANDING = {"conformsTo": ["http://www.opengis.net/spec/ogcapi-records-1/core"], "conforms_to": "urn:other", "links": [{"href": "c", "rel": "data"}, {"rel": "none"}], "collections": [{"id": "trees", "title": "Trees"}, {}]}
INDEX = {"base_url": "https://town.example/", "publisher": {"foaf:name": [{"other": "no"}, {"@value": "Town"}]}, "conforms_to": ["urn:p", ["urn:q"]], "links": [{"href": "/l"}], "datasets": [{"id": "trees"}, 3, {"dataset_id": "lamps", "url": "urn:lamps", "publisher": "Roads"}]}
DEEP = 40


def nested(value, depth, key):
    for _ in range(depth):
        value = {key: value}
    return value


DOCUMENTS = [
    ("json_schema", json.dumps(SCHEMA)), ("open_api", json.dumps(API)), ("ogc_landing", json.dumps(LANDING)), ("metadata_index", json.dumps(INDEX)),
    ("json_schema", json.dumps(nested({"properties": {"p": {"$ref": "a.json"}}}, DEEP, "items"))), ("json_schema", "[" * 100_000), ("open_api", ""), ("ogc_landing", None), ("open_api", '{"paths": {}, "paths": {}}'),
    ("json_schema", json.dumps({"properties": {"long": {"title": "é" * 400}, "b": {"x": "a, b: \"c\""}}})),
    *((kind, body) for kind in ("json_schema", "open_api", "ogc_landing", "metadata_index") for body in ODD),
]


@pytest.fixture(scope="module")
def said(spark):
    """The facts of DOCUMENTS by (document, kind of fact), in their order."""
    rows = [("r", k, f"a{k}", AT, AT, kind, body) for k, (kind, body) in enumerate(DOCUMENTS)]
    # a column of a name that the rules use themselves does no harm
    found = spark.createDataFrame(rows, "run_id string, ordinal int, artifact_id string, url string, at string, kind string, text string").withColumns({"role": F.lit("x"), "pointer": F.lit(1)})
    out = {}
    for r in sorted(json_rules.facts(found, set(json_rules.KINDS)).collect(), key=lambda r: (r.ordinal, r.fact, r.seq)):
        out.setdefault((r.ordinal, r.fact), []).append(r[r.fact])
    return out


def test_schema_properties_go_through_all_keywords_in_their_order(said):
    found = [(f.evidence.schema_pointer, f.evidence.property_path, f.evidence.property_name) for f in said[0, "finding"]]
    assert found == [("/properties/a~1b", "a/b", "a/b"), ("/properties/a~1b/items/properties/c", "a/b.c", "c"), ("/properties/z", "z", "z"), ("/allOf/0/properties/d", "d", "d")]
    assert [(x.href, x.evidence.pointer) for x in said[0, "link"]] == [("urn:s", "/$id"), ("x.json", "/allOf/0/properties/d/$ref")]
    assert said[0, "asset"][0].uri == "urn:s" and said[0, "claim"][0].predicate == "$schema"


def test_openapi_operations_and_servers(said):
    assert [(f.evidence.path, f.evidence.method, f.evidence.operation_id) for f in said[1, "finding"]] == [("/x", "post", None), ("/x", "get", "x")]
    (asset,) = said[1, "asset"]
    # the first entry that has a text is the empty one, so the title is that of the format
    assert asset.endpoint == "/v1" and asset.title == "OpenAPI description" and said[1, "claim"][0].version == "3.1.0"
    assert [(x.href, x.evidence.pointer) for x in said[1, "link"]] == [("d", "/externalDocs/url"), ("/v1", "/servers/1/url"), ("/v2", "/servers/2/url")]


def test_ogc_kind_overrides(said):
    assert said[2, "kind"][0].kind == "ogc_records" and said[2, "asset"][0].kind == "record_collection"
    assert said[2, "asset"][0].conforms == LANDING["conformsTo"]
    assert len(said[2, "link"]) == 1 and [f.evidence.collection_id for f in said[2, "finding"]] == ["trees"] and len(said[2, "claim"]) == 1


def test_metadata_index_names_datasets_below_its_base(said):
    catalog, trees, lamps = said[3, "asset"]
    assert (catalog.kind, catalog.uri, catalog.publisher, catalog.conforms) == ("catalog", AT, "Town", ["urn:p", "urn:q"])
    assert (trees.uri, trees.publisher, trees.title) == ("https://town.example/datasets/trees", "Town", None)
    assert (lamps.uri, lamps.publisher) == ("urn:lamps", "Roads") and [x.href for x in said[3, "link"]] == ["/l"]


def test_depth(said):
    assert [f.evidence.property_path for f in said[4, "finding"]] == ["p"]
    assert [x.evidence.pointer for x in said[4, "link"]] == ["/items" * DEEP + "/properties/p/$ref"]


@pytest.mark.parametrize("k", [5, 6, 7, 8])
def test_what_is_no_json_is_one_error(said, k):
    assert [(fact, len(rows)) for (n, fact), rows in said.items() if n == k] == [("error", 1)]


def test_evidence_is_cut_between_characters(said):
    short, long = (f.evidence.value for f in said[9, "finding"])
    assert short == '{"x": "a, b: \\"c\\""}'
    assert long.startswith('{"title": "é') and long.endswith("é...") and 510 <= len(long.encode()) <= 515


def test_odd_shapes_give_the_asset_of_their_kind(said):
    first = len(DOCUMENTS) - 4 * len(ODD)
    for k, (kind, _) in enumerate(DOCUMENTS[first:], first):
        found = {fact for n, fact in said if n == k}
        assert found == ({"asset", "claim"} if kind in ("json_schema", "open_api") else {"asset"} if kind == "ogc_landing" else set())


def test_no_documents(spark):
    none = spark.createDataFrame([], "run_id string, ordinal int, artifact_id string, url string, at string, kind string, text string")
    assert json_rules.facts(none, set(json_rules.KINDS)).count() == 0


def test_no_python_sees_a_body_of_plain_json(spark):
    """The plan of facts over such documents has no Python operator, and gives what the rules give."""
    body = spark.createDataFrame([("r", 0, AT, None, 200, "application/json", [], bytearray(json.dumps(API).encode()), None)], "run_id string, ordinal int, url string, final_url string, status int, media_type string, headers array<struct<name:string,value:string>>, body binary, discovered_from string")
    found = report.facts(report.classified(body))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and found.where("fact = 'finding'").count() == 2
