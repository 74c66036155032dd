"""Extractors of tree formats, on newly written documents."""

import json

import pytest

from lodestrata.operators import trees


def facts(kind, body, url="https://town.example/doc"):
    return trees.extract(kind, url, body if isinstance(body, str) else json.dumps(body))


def of(rows, table):
    return [p for t, p in rows if t == table]


def test_prefixed_and_full_types_are_the_same_kind():
    body = {"@graph": [{"@id": "https://town.example/a", "@type": "dcat:Dataset"}, {"@id": "https://town.example/b", "@type": "http://www.w3.org/ns/dcat#Dataset"}]}
    assert [a["kind"] for a in of(facts("dcat_catalog", body), "asset")] == ["dataset", "dataset"]


def test_public_service_with_products_is_a_registry_service():
    node = {"@id": "urn:s", "@type": "cpsv:PublicService"}
    assert of(facts("dcat_catalog", node), "asset")[0]["kind"] == "public_service"
    assert of(facts("dcat_catalog", node | {"cpsv:produces": "urn:x"}), "asset")[0]["kind"] == "public_registry_service"


def test_policy_by_its_permissions_with_sorted_hints():
    rows = facts("metadata_index", {"odrl:permission": {"odrl:target": "urn:t", "odrl:action": "odrl:use"}})
    policy = of(rows, "asset")[0]
    assert policy["kind"] == "policy" and policy["title"] == "Access policy"
    assert [h["label"] for h in policy["hints"]][1:] == ["odrl:action", "odrl:permission", "odrl:target"]


def test_signals_name_their_canonical_predicate():
    rows = facts("dcat_catalog", {"@id": "urn:d", "@type": "dcat:Dataset", "dct:modified": "2020", "publisher": {"name": "Town"}})
    assert {f["standard_iri"] for f in of(rows, "finding")} == {"dcterms:modified", "dcterms:publisher"}


def test_shape_is_inherited_from_the_nearest_object_with_an_id():
    body = {"@context": {"sh": "http://www.w3.org/ns/shacl#"}, "@id": "urn:Shape", "x": {"sh:property": [{"sh:path": {"@id": "urn:p"}, "sh:name": "P"}]}}
    (finding,) = of(facts("shacl", body), "finding")
    assert finding["evidence"]["shape"] == "urn:Shape" and finding["evidence"]["path"] == "urn:p"


def test_relations_of_unnamed_objects_are_blank_nodes():
    rows = facts("dcat_catalog", {"@id": "urn:s", "cv:hasChannel": {"dcterms:title": "Desk"}, "dcterms:type": "plain words"})
    (relation,) = of(rows, "relation")
    assert relation["predicate"] == "cv:hasChannel" and relation["object"]["node"].startswith("_:")


def test_turtle_assets_links_and_owners():
    body = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix t: <https://town.example/t#> .
    t:Shape a sh:NodeShape ; sh:property [ sh:path t:name ; sh:minCount 1 ] . # note
    t:Scheme a skos:ConceptScheme ; skos:prefLabel "Kinds"@en ; skos:exactMatch t:Other ."""
    rows = facts("shacl", body)
    assert {(a["kind"], a["title"]) for a in of(rows, "asset")} == {("shape_graph", None), ("concept_scheme", "Kinds"), ("alignment", "Kinds")}
    assert of(rows, "finding")[0]["evidence"]["shape"] == "https://town.example/t#Shape"


def test_turtle_terms():
    triples = trees.turtle_triples('@base <https://town.example/> . <a> <b> "x\\n\\u00e9"^^<c> , 1.5 , true ; <d> ( <e> ) , [] . _:n <b> """long "text\'""" .')
    assert triples[0] == ("https://town.example/a", "https://town.example/b", "x\né") and [t[2] for t in triples[1:3]] == ["1.5", "true"]
    assert triples[-1] == ("_:n", "https://town.example/b", "long \"text'")


def test_package_and_model():
    toml = '[package]\nname = "m"\nversion = "1"\n[[artifacts]]\nrole = "alignment"\npath = "a.ttl"\n[[artifacts]]\nrole = "other"\n'
    rows = facts("semantic_model_package", toml)
    assert [a["kind"] for a in of(rows, "asset")] == ["semantic_model_package", "alignment"] and [x["href"] for x in of(rows, "link")] == ["a.ttl"]
    yaml = "name: m\nprefixes: {t: {prefix_reference: 'https://town.example/'}}\nimports: ['t:base', other]\nclasses: {A: {description: x}}\nslots: {s: null}\nenums: {E: {}}\n"
    rows = facts("link_ml_schema", yaml)
    assert [a["kind"] for a in of(rows, "asset")] == ["semantic_model_package", "class", "property", "vocabulary"]
    assert [x["href"] for x in of(rows, "link")][:2] == ["https://town.example/base", "other"]


@pytest.mark.parametrize("kind, body", [("dcat_catalog", "{"), ("skos", "<a> <b>"), ("semantic_model_package", "= 1"), ("link_ml_schema", "a: [")])
def test_broken_bodies_are_one_error(kind, body):
    assert [t for t, _ in facts(kind, body)] == ["error"]


def test_evidence_is_cut_between_characters():
    text = trees.shorten("é" * 400)
    assert text.endswith("...") and len(text.encode()) <= 515


@pytest.mark.parametrize("kind", ["dcat_catalog", "metadata_index"])
@pytest.mark.parametrize("body", ["[]", "3", '"x"', "null", '{"links": 3, "servers": 4, "paths": [], "datasets": {}, "collections": 1}'])
def test_odd_shapes_do_not_crash(kind, body):
    facts(kind, body)


def nested(value, depth, key):
    for _ in range(depth):
        value = {key: value}
    return value


def test_depth_has_no_limit_of_its_own():
    assert trees.text_of(nested("x", 5000, "value")) == "x" and trees.text_of([[[[[[[[[[["y"]]]]]]]]]]]) == "y"
    deep = nested({"sh:property": {"sh:path": "urn:p"}}, 900, "x") | {"@id": "urn:s"}
    (finding,) = of(facts("shacl", json.dumps(deep)), "finding")
    assert finding["evidence"]["shape"] == "urn:s"


def test_what_a_parser_refuses_is_a_parse_error():
    deep = "[" * 100_000
    assert [t for t, _ in facts("dcat_catalog", deep)] == ["error"]
    assert [t for t, _ in facts("shacl", "<urn:a> <urn:p> " + "[ <urn:q> " * 400 + "1" + "]" * 400 + " .")] == ["error"]
