"""Scalar functions, classification, links and claims on odd values."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import headers, ids, iris, labels, urls
from lodestrata.operators import claims, classify, links


def one(spark, column, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, normal",
    [("HTTP://A.Example:80/x#f", "http://a.example/x"), ("https://a.example", "https://a.example/"), ("https://u@A.example:8443/?q#", "https://u@a.example:8443/?q"), ("urn:x#y", "urn:x"), ("https://a.example?q", "https://a.example/?q")],
)
def test_normalize(spark, url, normal):
    assert one(spark, urls.normalize(F.col("u")), u=url) == normal


@pytest.mark.parametrize(
    "raw, full",
    [("x", "https://a.example/d/x"), ("../x", "https://a.example/x"), ("/x", "https://a.example/x"), ("//b.example/", "https://b.example/"), ("?q", "https://a.example/d/e?q"), ("#f", "https://a.example/d/e?p#f"), ("mailto:x", "mailto:x"), ("", None), ("/a/../b", "https://a.example/b")],
)
def test_resolve(spark, raw, full):
    assert one(spark, urls.resolve(F.col("b"), F.col("r")), b="https://a.example/d/e?p", r=raw) == full


@pytest.mark.parametrize("base", ["https://a.example/d/e?p", "http://a.example", "https://a.example/d/f/", "https://a.example/d/e/f#x"])
@pytest.mark.parametrize("raw", ["../z", "z.html", "./", "..", "../../../up", "a/./b/../c?x=/../#f", "/r/./s", "g;x=1", "x?y/../z", "."])
def test_resolve_as_the_standard_library_does(spark, base, raw):
    assert one(spark, urls.resolve(F.col("b"), F.col("r")), b=base, r=raw) == urljoin(base.split("#")[0], raw)


def test_profile_packs_from_toml():
    text = 'id = "town"\nlabel = "Town profile"\nversion = "1"\nstandard_iri = "https://town.example/profile/"\nartifact_kinds = ["dcat_catalog"]\n'
    assert claims.parse_packs(text) == (("town", "Town profile", "https://town.example/profile/", True),)
    for bad in ("id = ", 'id = "x"', text.replace('["dcat_catalog"]', "[1]")):
        with pytest.raises(ValueError):
            claims.parse_packs(bad)


def test_canonical_json():
    from lodestrata.sources.bundles import canonical_json

    assert json.loads(canonical_json('{"b": 1, "a": {"fetched_at": "now", "total_elapsed_ms": 9}}')) == {"a": {"fetched_at": "1970-01-01T00:00:00Z", "total_elapsed_ms": 0}, "b": 1}
    assert canonical_json('{"b":1,"a":2}') == canonical_json('{ "a": 2, "b": 1 }')


@pytest.mark.parametrize("url, secret", [("https://u@a.example/", True), ("https://a.example/?API_KEY=1", True), ("https://a.example/?q=token", False), ("https://a.example/?my_token_x=1", True), ("https://a.example/", False)])
def test_secrets(spark, url, secret):
    assert one(spark, urls.has_secret(F.col("u")), u=url) is secret


def test_redact(spark):
    url = "https://u:p@a.example/x?key=1&monkey=2&q=3#f"
    assert one(spark, urls.redact(F.col("u")), u=url) == "https://a.example/x?key=REDACTED&monkey=REDACTED&q=3#f"
    assert one(spark, urls.redact(F.col("u"), "facade"), u=url) == "https://a.example/x?key=REDACTED&monkey=2&q=3#f"


@pytest.mark.parametrize("address, private", [("10.1.2.3", True), ("::1", True), ("::ffff:192.168.0.1", True), ("100.64.0.1", True), ("93.184.216.34", False), ("2606:4700::1", False), ("x", None)])
def test_addresses(spark, address, private):
    assert one(spark, urls.is_private_ip(F.col("a")), a=address) is private


def test_ids(spark):
    assert one(spark, ids.det_id("artifact", F.col("u")), u="https://e.x/") == "artifact:830caf2254870637"
    assert one(spark, ids.fnv1a64(F.col("u")), u="ab") == "089c4407b545986a"
    assert one(spark, ids.det_id("a", F.lit(None), F.lit("b")), u="") == one(spark, ids.det_id("a", F.lit(""), F.lit("b")), u="")
    assert spark.range(1).select(ids.decoded(F.lit(b"a\xffb")).alias("x")).first().x == "a�b"


def test_labels(spark):
    assert one(spark, labels.canonical_label(F.col("a")), a="  A \t b ") == "a b"
    assert one(spark, labels.canonical_access_label(F.col("a")), a="Trees API") == "trees"
    assert one(spark, labels.label_from_iri(F.col("a")), a="https://a.example/x#treeOwner_nameShape") == "tree Owner name"
    assert one(spark, labels.first_text(F.lit(None), F.lit("  "), F.lit(" x ")), a="") == "x"
    assert one(spark, labels.kind_label(F.col("a")), a="open_api") == "Open API"
    assert one(spark, labels.schemes(F.array(F.lit(" HTTP"), F.lit("http"), F.lit(""))), a="") == ["http"]


def test_iris(spark):
    assert one(spark, iris.expanded(F.col("a")), a="dcat:Dataset") == "http://www.w3.org/ns/dcat#Dataset"
    assert one(spark, iris.expanded(F.col("a")), a="https://a.example/") == "https://a.example/"
    assert one(spark, iris.compact(F.col("a")), a="http://data.europa.eu/m8g/hasChannel") == "cv:hasChannel"
    assert one(spark, iris.compact(F.col("a")), a="http://data.europa.eu/m8g/Requirement") == "cccev:Requirement"
    assert one(spark, iris.compact(F.col("a")), a="http://purl.org/dc/terms/title") == "dcterms:title"
    assert one(spark, iris.canonical(F.col("a"), {"t": "https://t.example/"}), a=" t:x ") == "https://t.example/x"


def test_headers(spark):
    hs = F.array(F.struct(F.lit("Cookie").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("ETag").alias("name"), F.lit("y").alias("value")))
    assert [h.value for h in one(spark, headers.redact(hs), a="")] == ["[redacted]", "y"]
    assert [h.name for h in one(spark, headers.sanitize(hs), a="")] == ["etag"]
    assert [h.name for h in one(spark, headers.strip_sensitive(hs), a="")] == ["ETag"]
    assert one(spark, headers.value(hs, "etag"), a="") == "y" and one(spark, headers.value(hs, "link"), a="") is None


KINDS = [
    ("https://a.example/x.linkml.yaml", None, "", "link_ml_schema"), ("https://a.example/", None, "id: x\nclasses:\n", "link_ml_schema"), ("https://a.example/", None, "[package]\nname='x'\n[[artifacts]]", "semantic_model_package"),
    ("https://a.example/", "text/html", "", "html_landing_page"), ("https://a.example/x.ttl", None, "x a skos:ConceptScheme", "skos"), ("https://a.example/", "text/turtle", "sh:NodeShape", "shacl"), ("https://a.example/", "application/schema+json", "", "json_schema"),
    ("https://a.example/", None, '{"openapi": "3"}', "open_api"), ("https://a.example/", None, '{"$id": "x"}', "json_schema"), ("https://a.example/", None, '{"conformsTo": ["ogcapi-records"], "links": []}', "ogc_records"),
    ("https://a.example/", None, '{"conformsTo": ["http://x/ogcapi-features-1"], "links": 1}', "ogc_features"), ("https://a.example/", None, '{"links": []}', "metadata_index"), ("https://a.example/", None, '{"links": {}}', "unknown"), ("https://a.example/", None, '{"datasets": []}', "metadata_index"),
    ("https://a.example/", None, '{"@context": {}}', "json_ld_context"), ("https://a.example/", None, '{"x": "sh:path"}', "shacl"), ("https://a.example/", None, '{"x": "odrl:Set"}', "metadata_index"), ("https://a.example/", None, '{"@type": "dcat:Dataset"}', "dcat_catalog"),
    ("https://a.example/", None, '{"@type": "prof:Profile"}', "prof_profile"), ("https://a.example/", None, '{"id": "did:x", "verificationMethod": []}', "did_document"), ("https://a.example/", "application/json", "{", "unknown"), ("https://a.example/", "text/plain", "words", "unknown"), ("https://a.example/", None, None, "unknown"),
]


def test_kinds(spark):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(KINDS)], "k int, url string, media string, body string, want string")
    got = rows.withColumn("got", classify.artifact_kind(F.col("url"), F.col("media"), F.col("body"))).collect()
    assert [(r.k, r.got) for r in got if r.got != r.want] == []


def test_statuses(spark):
    status = lambda code, kind, error: one(spark, classify.artifact_status(F.lit(code), F.lit(kind), F.lit(error)), a="")
    assert [status(200, "shacl", None), status(204, "unknown", None), status(200, "shacl", "x"), status(401, "unknown", None), status(500, "shacl", None)] == ["fetched", "unsupported", "parse_error", "auth_required", "failed"]


def test_html_and_header_links(spark):
    pages = spark.createDataFrame([(1, "<LINK rel='alternate  profile x' href='a'><link href=\"b\"><link rel=canonical href='c'><link type='t' href='d' rel='describedby'/>"), (2, None)], "id int, html string")
    assert [(r.rel, r.href, r.pointer, r.type) for r in links.html_links(pages).orderBy("position", "rel").collect()] == [("alternate", "a", "/html/link/0", None), ("profile", "a", "/html/link/0", None), ("describedby", "d", "/html/link/3", "t")]
    hs = spark.createDataFrame([(1, [("Link", '<a?x=1,2>; rel="describedby"; type="text/turtle", <b>'), ("other", "<c>")])], "id int, headers array<struct<name: string, value: string>>")
    assert [(r.href, r.rel, r.type) for r in links.header_links(hs).orderBy("position").collect()] == [("a?x=1,2", "describedby", "text/turtle"), ("b", None, None)]


def test_claims_and_packs(spark):
    rows = [("https://semiceu.github.io/BRegDCAT-AP/x", None, None), ("https://semiceu.github.io", None, None), ("https://www.w3.org/TR/shacl", None, None), ("https://a.example/my-profile", None, None), ("https://a.example/", None, None), ("https://a.example/p", "https://a.example/base", "P")]
    raw = spark.createDataFrame([("r", "a", i, None, "p", b, t, 0, k) for k, (i, b, t) in enumerate(rows)], "run_id string, artifact_id string, iri string, version string, predicate string, base string, title string, ordinal int, seq int")
    standards, profiles = claims.claims(raw)
    assert {(r.iri, r.label) for r in standards.collect()} == {("https://www.w3.org/TR/shacl", "SHACL"), ("https://a.example/", None)}
    assert {(r.iri, r.label) for r in profiles.collect()} == {("https://semiceu.github.io/BRegDCAT-AP/x", "BRegDCAT-AP"), ("https://semiceu.github.io", "DCAT-AP"), ("https://a.example/my-profile", None), ("https://a.example/p", "P")}


def test_capability_metamorphosis(spark):
    """Evidence that goes takes its match with it; question and country change nothing; order of rows does not matter."""
    from lodestrata.operators import capability as cap

    schema = "run_id string, source_id string, id string, kind string, uri string, title string, description string, publisher string, endpoint_url string, conforms_to array<string>, source_hints array<struct<label: string, predicate: string, path: string>>, ordinal int, seq long"
    rows = [("r", "s", "a", "api_description", "urn:a", "Farmer Status API", None, None, "https://a.example/api", [], [("status", "x:status", "/farmer/status")], 0, 0), ("r", "s", "b", "dataset", "urn:b", "Farmers", None, "Office", None, [], [], 0, 1)]
    assets = spark.createDataFrame(rows, schema)
    index = lambda a: cap.inverted(cap.asset_records(a).unionByName(cap.hint_records(a)))
    query = lambda term, **more: cap.CapabilityQuery("q", **more).need(cap.InformationNeed("n", question="any?").requires_any(term)).terms(spark)
    found = cap.search(index(assets), assets, query(cap.Term.named_field("/farmer/status"))).collect()
    assert [(r.asset_id, r.structured, r.access, r.confidence, r["rank"]) for r in found] == [("a", 1, 1, "high", 1)]
    assert cap.search(index(assets), assets, query(cap.Term.label(" FARMER  status api "), country="NL")).count() == 1
    assert cap.search(index(assets), assets, query(cap.Term.label("Farmer"))).count() == 0
    less = assets.where("id <> 'a'")
    assert cap.search(index(less), less, query(cap.Term.named_field("/farmer/status"))).count() == 0
    signals = spark.createDataFrame([("r", "a", "semantic.standard_signal", p) for p in ("dcterms:publisher", "dcatap:applicableLegislation", "cpsv:produces", "dcterms:modified")], "run_id string, asset_id string, code string, standard_iri string")
    best = cap.search(index(assets), assets, query(cap.Term.named_field("/farmer/status")), cap.standard_signals(signals)).first()
    assert best.role == "candidate_source" and best.gaps == ["RequiredIdentifierUnknown"]
    with pytest.raises(LookupError):
        cap.expanded_terms(query(cap.Term.reviewed_mapping("s", "m")))
    with pytest.raises(ValueError):
        cap.CapabilityQuery("q").terms(spark)


def test_graph_mutations(spark):
    """Each missing edge gives its own gap."""
    from lodestrata.operators.graph import ServiceGraph

    assets = spark.createDataFrame([("r", i, k, f"urn:{i}", i) for i, k in (("s", "public_service"), ("c", "channel"), ("q", "requirement"), ("l", "evidence_type_list"), ("t", "evidence_type"), ("o", "evidence_offering"), ("p", "evidence_provider"), ("d", "data_service"), ("f", "form_definition"))], "run_id string, id string, kind string, uri string, title string")
    edges = [("s", "cv:hasChannel", "c"), ("s", "cv:holdsRequirement", "q"), ("q", "cccev:hasEvidenceTypeList", "l"), ("l", "cccev:specifiesEvidenceType", "t"), ("o", "registry_manifest:evidenceType", "t"), ("o", "registry_manifest:providedBy", "p"), ("o", "registry_manifest:evidenceService", "d"), ("f", "registry_manifest:forChannel", "c")]
    frame = lambda es: spark.createDataFrame([("r", f"e{k}", a, p, b, k) for k, (a, p, b) in enumerate(es)], "run_id string, relation_id string, subject_id string, predicate string, object_id string, seq int")
    graph = ServiceGraph(assets, frame(edges))
    assert graph.gaps().count() == 0
    assert {(r.kind, r.target): r.path for r in graph.routes().collect()} == {("evidence_type", "t"): ["e1", "e2", "e3"], ("evidence_provider", "p"): ["e1", "e2", "e3", "e4", "e5"], ("evidence_access_service", "d"): ["e1", "e2", "e3", "e4", "e6"], ("form", "f"): ["e0", "e7"]}
    assert graph.requirement_access().first().satisfiable
    for drop, gap in ((0, "cv:hasChannel"), (1, "cv:holdsRequirement"), (3, "cccev:hasEvidenceTypeList"), (4, "registry_manifest:evidenceType"), (5, "registry_manifest:providedBy"), (6, "registry_manifest:evidenceService")):
        assert [r.predicate for r in ServiceGraph(assets, frame([e for k, e in enumerate(edges) if k != drop])).gaps().collect()] == [gap]
    with pytest.raises(LookupError):
        graph.public_service("urn:none")
    import json

    assert json.loads(graph.view("urn:s").first().view)["accepted_evidence_types"][0]["target"] == "t"


def test_ranks_over_ranges_are_those_of_one_window(spark):
    from pyspark.sql import Window

    from lodestrata.operators import capability

    k = F.col("id")
    frame = spark.range(3000).select(
        F.lit("q").alias("query_id"), F.when(k % 10 == 0, "b").otherwise("a").alias("need_id"), (k % 3).alias("structured"), (k % 5).alias("metadata"), F.lit(0).alias("mapping"), (k % 2).alias("access"),
        F.array_repeat(F.lit("g"), (k % 4).cast("int")).alias("gaps"), F.lit("low").alias("confidence"), F.concat(F.lit("r"), k.cast("string")).alias("route_id"), F.array(k.cast("string")).alias("evidence_ids"),
    )
    plain = Window.partitionBy("query_id", "need_id").orderBy(F.desc("structured"), F.desc("metadata"), F.desc("mapping"), F.desc("access"), F.size("gaps"), "route_id")
    want = {r.route_id: r.n for r in frame.withColumn("n", F.row_number().over(plain)).collect()}
    assert {r.route_id: r["rank"] for r in capability.ranked(frame).collect()} == want
    assert capability.ranked(frame.limit(0)).count() == 0
