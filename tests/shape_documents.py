"""Small documents of all formats and varied shapes, as one run of artifacts: (file, media type, body)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.report import analyze
from lodestrata.sources.bundles import from_pages

BASE = "https://town.example/"

CATALOG = {
    "@context": [{"dcat": "http://www.w3.org/ns/dcat#", "t": {"@id": "https://town.example/terms#"}}, "https://town.example/other"],
    "@graph": [
        {"@id": "https://town.example/catalog", "@type": ["dcat:Catalog", "t:Register"], "dct:title": [{"@language": "en", "@value": "Town data"}], "http://purl.org/dc/terms/publisher": {"foaf:name": "Town hall"}, "dcat:dataset": [{"@id": "t:trees"}, {"@id": "t:benches"}], "dcterms:conformsTo": [{"@id": "https://semiceu.github.io/DCAT-AP/releases/3.0.0/"}, "https://www.w3.org/TR/dx-prof/"]},
        {"@id": "t:trees", "@type": "http://www.w3.org/ns/dcat#Dataset", "dcterms:title": "Trees", "dcterms:modified": "2024-05-01", "dcat:distribution": {"@id": "urn:trees.csv", "@type": "dcat:Distribution", "dcat:downloadURL": {"@id": "https://town.example/trees.csv"}}},
        {"@id": "t:benches", "@type": "dcat:Dataset", "dcterms:title": {"@value": "Benches"}, "odrl:hasPolicy": {"@id": "urn:policy", "odrl:permission": {"odrl:action": "odrl:read", "odrl:target": {"@id": "t:benches"}}}},
        {"@id": "urn:desk", "@type": "cpsv:PublicService", "dcterms:title": "Permit desk", "cv:hasChannel": {"dcterms:title": "Counter"}, "cv:holdsRequirement": "urn:need", "cpsv:produces": "plain words"},
    ],
}
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "$id": "https://town.example/tree.schema.json", "title": "Tree",
    "properties": {"height/m": {"type": "number"}, "owner": {"properties": {"name": {"type": "string"}}, "allOf": [{"$ref": "owner.json"}]}, "tags": {"items": {"properties": {"k": {}}}}},
}
API = {"openapi": "3.1.0", "info": {"title": "Tree API", "version": "2"}, "servers": [{"url": "https://town.example/api"}], "externalDocs": {"url": "https://town.example/docs"}, "paths": {"/trees/{id}": {"get": {"operationId": "getTree", "summary": "One tree"}, "delete": {}}, "/trees": {"post": {"operationId": "addTree"}, "parameters": []}}}
LANDING = {"title": "Town features", "conformsTo": ["http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/core"], "links": [{"href": "/collections", "rel": "data", "type": "application/json"}, {"href": "api.json", "rel": "service-desc"}]}
COLLECTIONS = {"title": "Collections", "links": [{"href": "/collections", "rel": "self"}], "conformsTo": ["http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/core"], "collections": [{"id": "trees", "title": "Trees", "links": [{"href": "/collections/trees/items", "rel": "items"}]}, {"id": "roads"}]}
INDEX = {"id": "urn:index", "title": "Index", "base_url": "https://town.example/", "publisher": {"name": "Town hall"}, "datasets": [{"dataset_id": "lamps", "title": "Lamps"}, {"@id": "urn:signs", "name": "Signs", "publisher": "Roads office"}], "links": [{"href": "more.json", "rel": "describedby"}]}
SHAPES_TTL = """@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix t: <https://town.example/terms#> .
@prefix dct: <http://purl.org/dc/terms/> .
t:TreeShape a sh:NodeShape ; dct:title "Tree shape"@en ; sh:targetClass t:Tree ;
  sh:property [ sh:path t:height ; sh:name "height" ] , [ sh:path t:owner ] .
"""
CONCEPTS_TTL = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
<https://town.example/kinds> a skos:ConceptScheme ; skos:prefLabel "Kinds of tree" ; skos:hasTopConcept <https://town.example/kinds#oak> .
<https://town.example/kinds#oak> a skos:Concept ; skos:prefLabel 'Oak'@en ; skos:exactMatch <https://other.example/oak> .
"""
PACKAGE = """id = "urn:package"
name = "trees"
title = "Tree package"
version = "1.2"

[[artifacts]]
role = "shapes"
path = "shapes.ttl"
media_type = "text/turtle"

[[artifacts]]
role = "model"
path = "model.yaml"
media_type = "application/yaml"

[links]
homepage = "https://town.example/home"
"""
LINKML = """id: https://town.example/model
name: trees
title: Tree model
prefixes:
  t:
    prefix_reference: https://town.example/terms#
imports:
  - linkml:types
classes:
  Tree:
    class_uri: t:Tree
    description: A tree
slots:
  height:
    slot_uri: t:height
enums:
  Kind: {}
"""
CONTEXT = {"@context": {"t": "https://town.example/terms#", "height": {"@id": "t:height", "@type": "xsd:decimal"}}}
PAGE = "<html><head><link rel='alternate describedby' href='catalog.jsonld' type='application/ld+json'><LINK REL=\"stylesheet\" HREF='x.css'></head></html>"
SHAPES = {"@context": {"sh": "http://www.w3.org/ns/shacl#"}, "@id": "https://town.example/terms#BenchShape", "@type": "sh:NodeShape", "sh:and": [{"sh:property": [{"sh:path": {"@id": "https://town.example/terms#length"}, "sh:name": "Length"}, {"sh:name": "no path"}]}]}
PROFILE = {"@context": {"prof": "http://www.w3.org/ns/dx/prof/"}, "@id": "https://town.example/profile", "@type": "prof:Profile", "dcterms:title": "Town profile", "prof:isProfileOf": {"@id": "https://www.w3.org/TR/vocab-dcat-3/"}, "prof:hasResource": [{"@id": "urn:res", "@type": "prof:ResourceDescriptor", "prof:hasRole": {"@id": "http://www.w3.org/ns/dx/prof/role/schema"}, "prof:hasArtifact": {"@id": "https://town.example/tree.schema.json"}}]}

DOCUMENTS = (
    ("catalog.jsonld", "application/ld+json", CATALOG), ("tree.schema.json", "application/schema+json", SCHEMA), ("api.json", "application/json", API), ("landing.json", "application/json", LANDING), ("collections.json", "application/json", COLLECTIONS),
    ("index.json", "application/json", INDEX), ("shapes.ttl", "text/turtle", SHAPES_TTL), ("concepts.ttl", "text/turtle", CONCEPTS_TTL), ("semantic-asset-package.v1.toml", "application/toml", PACKAGE), ("model.yaml", "application/yaml", LINKML), ("context.jsonld", "application/ld+json", CONTEXT),
    ("page.html", "text/html", PAGE), ("bench.jsonld", "application/ld+json", SHAPES), ("profile.jsonld", "application/ld+json", PROFILE), ("broken.schema.json", "application/schema+json", "{"), ("broken.ttl", "text/turtle", "@prefix sh: <http://www.w3.org/ns/shacl#> . <a> a sh:NodeShape ; sh:property [ "),
)


def fetched(spark: SparkSession) -> DataFrame:
    rows = [(k, BASE + name, kind, body if isinstance(body, str) else json.dumps(body)) for k, (name, kind, body) in enumerate(DOCUMENTS)]
    frame = spark.createDataFrame(rows, "page_id long, url string, kind string, html string")
    kinds = F.create_map(*(F.lit(x) for _, url, kind, _ in rows for x in (url, kind)))
    return from_pages(frame, F.lit("shapes")).withColumn("media_type", F.element_at(kinds, F.col("url")))


def said(spark: SparkSession) -> DataFrame:
    """The tables of the documents' report in one: (part, ordinal, a, b, c)."""
    r = analyze(fetched(spark))
    e = lambda name: F.col(f"evidence.{name}")
    tables = (
        (r.artifacts, "artifact", "kind", "status", "title"), (r.assets, "asset", "kind", "uri", "title"), (r.links, "link", "to_url", F.coalesce("rel", "predicate"), "role"), (r.standards, "standard", "iri", "label", "predicate"), (r.profiles, "profile", "iri", "label", "base_standard_iri"),
        (r.findings, "finding", "code", F.coalesce("standard_iri", e("schema_pointer"), e("path"), e("shape")), F.coalesce(e("shape"), e("value"))), (r.relations, "relation", F.coalesce("subject.uri", F.lit("_")), "predicate", F.coalesce("object.uri", F.lit("_"))),
    )
    out = None
    for table, part, *columns in tables:
        row = table.select(F.lit(part).alias("part"), "ordinal", *((F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in zip("abc", columns, strict=True)))
        out = row if out is None else out.unionByName(row)
    return out


#: What the documents say, checked against their text.
EXPECTED = r"""
  ('artifact', 0, 'dcat_catalog', 'fetched', 'Town data'),
  ('artifact', 1, 'json_schema', 'fetched', 'Tree'),
  ('artifact', 2, 'open_api', 'fetched', 'Tree API'),
  ('artifact', 3, 'ogc_features', 'fetched', 'Town features'),
  ('artifact', 4, 'ogc_features', 'fetched', 'Collections'),
  ('artifact', 5, 'metadata_index', 'fetched', 'Index'),
  ('artifact', 6, 'shacl', 'fetched', 'Tree shape'),
  ('artifact', 7, 'skos', 'fetched', 'Kinds of tree'),
  ('artifact', 8, 'semantic_model_package', 'fetched', 'Tree package'),
  ('artifact', 9, 'link_ml_schema', 'fetched', 'trees'),
  ('artifact', 10, 'json_ld_context', 'fetched', NULL),
  ('artifact', 11, 'html_landing_page', 'fetched', NULL),
  ('artifact', 12, 'shacl', 'fetched', NULL),
  ('artifact', 13, 'prof_profile', 'fetched', 'Town profile'),
  ('artifact', 14, 'json_schema', 'parse_error', NULL),
  ('artifact', 15, 'shacl', 'parse_error', NULL),
  ('asset', 0, 'catalog', 'https://town.example/catalog', 'Town data'),
  ('asset', 0, 'dataset', 't:benches', 'Benches'),
  ('asset', 0, 'dataset', 't:trees', 'Trees'),
  ('asset', 0, 'distribution', 'urn:trees.csv', NULL),
  ('asset', 0, 'policy', 'urn:policy', 'Access policy'),
  ('asset', 0, 'public_registry_service', 'urn:desk', 'Permit desk'),
  ('asset', 1, 'class', 'https://town.example/tree.schema.json', 'Tree'),
  ('asset', 2, 'api_description', 'https://town.example/api.json', 'Tree API'),
  ('asset', 3, 'feature_collection', 'https://town.example/landing.json', 'Town features'),
  ('asset', 4, 'feature_collection', 'https://town.example/collections.json', 'Collections'),
  ('asset', 5, 'catalog', 'urn:index', 'Index'),
  ('asset', 5, 'dataset', 'https://town.example/datasets/lamps', 'Lamps'),
  ('asset', 5, 'dataset', 'urn:signs', 'Signs'),
  ('asset', 6, 'shape_graph', 'https://town.example/terms#TreeShape', 'Tree shape'),
  ('asset', 7, 'alignment', 'https://town.example/kinds#oak', 'Oak'),
  ('asset', 7, 'concept_scheme', 'https://town.example/kinds', 'Kinds of tree'),
  ('asset', 8, 'semantic_model_package', 'urn:package', 'Tree package'),
  ('asset', 9, 'class', NULL, 'Tree'),
  ('asset', 9, 'property', NULL, 'height'),
  ('asset', 9, 'semantic_model_package', 'https://town.example/model', 'trees'),
  ('asset', 9, 'vocabulary', NULL, 'Kind'),
  ('asset', 10, 'vocabulary', 'https://town.example/context.jsonld', NULL),
  ('asset', 13, 'profile', 'https://town.example/profile', 'Town profile'),
  ('finding', 0, 'link.rejected_by_core', NULL, 'urn:policy'),
  ('finding', 0, 'link.rejected_by_core', NULL, 'urn:trees.csv'),
  ('finding', 0, 'semantic.standard_signal', 'cpsv:produces', 'plain words'),
  ('finding', 0, 'semantic.standard_signal', 'dcterms:modified', '2024-05-01'),
  ('finding', 0, 'semantic.standard_signal', 'odrl:hasPolicy', 'urn:policy'),
  ('finding', 1, 'semantic.schema_property', '/properties/height~1m', '{"type": "number"}'),
  ('finding', 1, 'semantic.schema_property', '/properties/owner', '{"allOf": [{"$ref": "owner.json"}], "properties": {"name": {"type": "string"}}}'),
  ('finding', 1, 'semantic.schema_property', '/properties/owner/properties/name', '{"type": "string"}'),
  ('finding', 1, 'semantic.schema_property', '/properties/tags', '{"items": {"properties": {"k": {}}}}'),
  ('finding', 1, 'semantic.schema_property', '/properties/tags/items/properties/k', '{}'),
  ('finding', 2, 'semantic.openapi_operation', '/trees', NULL),
  ('finding', 2, 'semantic.openapi_operation', '/trees/{id}', NULL),
  ('finding', 2, 'semantic.openapi_operation', '/trees/{id}', NULL),
  ('finding', 4, 'semantic.ogc_collection', NULL, NULL),
  ('finding', 4, 'semantic.ogc_collection', NULL, NULL),
  ('finding', 6, 'semantic.shacl_property', 'https://town.example/terms#height', 'https://town.example/terms#TreeShape'),
  ('finding', 6, 'semantic.shacl_property', 'https://town.example/terms#owner', 'https://town.example/terms#TreeShape'),
  ('finding', 9, 'link.rejected_by_core', NULL, 'linkml:types'),
  ('finding', 12, 'semantic.shacl_property', 'https://town.example/terms#length', 'https://town.example/terms#BenchShape'),
  ('finding', 13, 'link.rejected_by_core', NULL, 'urn:res'),
  ('finding', 14, 'parse.failed', NULL, NULL),
  ('finding', 15, 'parse.failed', NULL, NULL),
  ('link', 0, 'https://semiceu.github.io/DCAT-AP/releases/3.0.0/', 'dcterms:conformsTo', NULL),
  ('link', 0, 'https://town.example/plain words', 'cpsv:produces', 'produces'),
  ('link', 0, 'https://town.example/terms#benches', 'dcat:dataset', 'dataset'),
  ('link', 0, 'https://town.example/terms#trees', 'dcat:dataset', 'dataset'),
  ('link', 0, 'https://town.example/trees.csv', 'dcat:downloadURL', NULL),
  ('link', 0, 'https://www.w3.org/TR/dx-prof/', 'dcterms:conformsTo', NULL),
  ('link', 1, 'https://json-schema.org/draft/2020-12/schema', '$schema', 'schema-meta'),
  ('link', 1, 'https://town.example/owner.json', '$ref', 'schema-reference'),
  ('link', 1, 'https://town.example/tree.schema.json', '$id', 'schema-id'),
  ('link', 2, 'https://town.example/api', 'servers', 'api-server'),
  ('link', 2, 'https://town.example/docs', 'describedby', 'external-docs'),
  ('link', 3, 'https://town.example/api.json', 'service-desc', NULL),
  ('link', 3, 'https://town.example/collections', 'data', 'application/json'),
  ('link', 4, 'https://town.example/collections', 'self', NULL),
  ('link', 5, 'https://town.example/more.json', 'describedby', NULL),
  ('link', 8, 'https://town.example/home', 'describedby', 'semantic-package-artifact'),
  ('link', 8, 'https://town.example/model.yaml', 'describedby', 'semantic-package-artifact'),
  ('link', 8, 'https://town.example/shapes.ttl', 'describedby', 'semantic-package-artifact'),
  ('link', 9, 'https://town.example/model', 'describedby', 'linkml-reference'),
  ('link', 9, 'https://town.example/terms#', 'describedby', 'linkml-reference'),
  ('link', 11, 'https://town.example/catalog.jsonld', 'alternate', 'application/ld+json'),
  ('link', 11, 'https://town.example/catalog.jsonld', 'describedby', 'application/ld+json'),
  ('link', 13, 'https://town.example/tree.schema.json', 'prof:hasArtifact', 'profile-resource'),
  ('link', 13, 'https://www.w3.org/TR/vocab-dcat-3/', 'prof:isProfileOf', NULL),
  ('profile', 0, 'https://semiceu.github.io/DCAT-AP/releases/3.0.0/', 'DCAT-AP', NULL),
  ('profile', 0, 'https://www.w3.org/TR/dx-prof/', 'Profiles Vocabulary', NULL),
  ('profile', 13, 'https://town.example/profile', 'Town profile', 'https://www.w3.org/TR/vocab-dcat-3/'),
  ('relation', 0, 'https://town.example/catalog', 'dcat:dataset', 'https://town.example/terms#benches'),
  ('relation', 0, 'https://town.example/catalog', 'dcat:dataset', 'https://town.example/terms#trees'),
  ('relation', 0, 'https://town.example/catalog', 'dcterms:conformsTo', 'https://semiceu.github.io/DCAT-AP/releases/3.0.0/'),
  ('relation', 0, 'https://town.example/catalog', 'dcterms:conformsTo', 'https://www.w3.org/TR/dx-prof/'),
  ('relation', 0, 'https://town.example/terms#trees', 'dcat:distribution', 'urn:trees.csv'),
  ('relation', 0, 'urn:desk', 'cv:hasChannel', '_'),
  ('relation', 0, 'urn:desk', 'cv:holdsRequirement', 'urn:need'),
  ('relation', 0, 'urn:trees.csv', 'dcat:downloadURL', 'https://town.example/trees.csv'),
  ('standard', 1, 'https://json-schema.org/draft/2020-12/schema', 'JSON Schema', '$schema'),
  ('standard', 2, 'https://spec.openapis.org/oas/v3.1.0', 'OpenAPI', 'openapi'),
  ('standard', 3, 'http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/core', 'OGC API Features', 'conformsTo'),
  ('standard', 4, 'http://www.opengis.net/spec/ogcapi-features-1/1.0/conf/core', 'OGC API Features', 'conformsTo')
"""


SQL = f"SELECT part, ordinal::INT AS ordinal, a, b, c FROM (VALUES {EXPECTED}) AS t(part, ordinal, a, b, c)"
