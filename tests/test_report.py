"""Bundles to reports, crawls, streams and views."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import views
from lodestrata.plans import crawl
from lodestrata.plans.report import Options, Report, analyze
from lodestrata.sources import bundles

CATALOG = {
    "@context": {"dcat": "http://www.w3.org/ns/dcat#"},
    "@id": "https://town.example/catalog",
    "@type": "dcat:Catalog",
    "dcterms:title": "Town data",
    "dcterms:conformsTo": {"@id": "https://semiceu.github.io/DCAT-AP/releases/3.0.0/"},
    "dcat:dataset": [{"@id": "https://town.example/datasets/trees", "@type": "dcat:Dataset", "dcterms:title": "Trees", "dcat:distribution": {"@id": "urn:f", "@type": "dcat:Distribution", "dcat:accessURL": {"@id": "https://town.example/t.csv?token=1"}}}],
    "dcat:service": {"@id": "https://town.example/api", "@type": "dcat:DataService"},
}


@pytest.fixture(scope="module")
def bundle(tmp_path_factory):
    path = tmp_path_factory.mktemp("b") / "bundle.json"
    artifacts = [
        {"url": "https://town.example/late.jsonld", "media_type": "application/ld+json", "body": json.dumps({"@id": "urn:s", "@type": "cpsv:PublicService", "cv:hasChannel": {"@id": "urn:c"}})},
        {"url": "https://town.example/catalog.jsonld#x", "media_type": "application/ld+json", "body": json.dumps(CATALOG)},
        {"url": "https://town.example/channel.jsonld", "media_type": "application/ld+json", "body": json.dumps({"@id": "urn:c", "@type": "cv:Channel"})},
        {"url": "https://town.example/broken.schema.json", "body": "{"},
        {"url": "https://town.example/", "media_type": "text/html", "headers": [{"name": "Cookie", "value": "x"}, {"name": "link", "value": "</m.ttl>; rel=describedby"}], "body": list(b"<html><LINK REL='alternate canonical' HREF='c.jsonld'>\xff")},
        {"url": "https://town.example/gone", "status": 404, "body": ""},
    ]
    path.write_text(json.dumps({"entry_url": "https://town.example/", "artifacts": artifacts}))
    return str(path)


@pytest.fixture(scope="module")
def report(spark, bundle):
    return analyze(bundles.read_bundle(spark, bundle))


def test_artifacts_and_summary(report):
    rows = {r.ordinal: r for r in report.artifacts.collect()}
    assert [rows[k].status for k in range(6)] == ["fetched", "fetched", "fetched", "parse_error", "fetched", "failed"]
    assert rows[1].kind == "dcat_catalog" and rows[1].title == "Town data"
    run = report.run.first()
    assert (run.artifact_count, run.failed_artifact_count, run.parse_error_count, run.profile_count) == (6, 1, 1, 1)
    assert run.next_fetch_count == 2 and not run.truncated


def test_endpoints_of_later_artifacts_are_found(report):
    channel = report.assets.where("kind = 'channel'").first().id
    assert [r.object_id for r in report.relations.where("predicate = 'cv:hasChannel'").collect()] == [channel]
    report.validate()


def test_secrets_are_rejected_and_redacted(report):
    assert not report.links.where("to_url like '%token%'").count()
    (finding,) = report.findings.where("message like '%secret'").collect()
    assert finding.evidence.value == "https://town.example/t.csv?token=REDACTED"


def test_partitions_do_not_matter(spark, bundle, report):
    other = analyze(bundles.read_bundle(spark, bundle).repartition(5, F.rand(3)))
    for name, table in report.tables().items():
        assert sorted(map(str, table.collect())) == sorted(map(str, other.tables()[name].collect())), name


def test_packs(spark, bundle):
    none = analyze(bundles.read_bundle(spark, bundle), Options(profile_packs=["none"]))
    assert none.profiles.first().label == "DCAT-AP"  # by its words
    with pytest.raises(ValueError):
        analyze(bundles.read_bundle(spark, bundle), Options(profile_packs=["unheard-of"]))


def test_round_trip_and_json(spark, report, tmp_path):
    report.write(str(tmp_path / "r"))
    again = Report.read(spark, str(tmp_path / "r"))
    again.validate()
    assert again.assets.count() == report.assets.count()
    whole = json.loads(report.to_json().first().report)
    assert len(whole["artifacts"]) == 6 and whole["artifact_count"] == 6
    report.views("r_")
    assert spark.sql("select count(*) from r_assets where kind = 'dataset'").first()[0] == 1


def test_conditions(report):
    rejected = report.run.select("run_id", F.lit("x").alias("discovered_from")).limit(0)
    status = {r.condition: r.status for r in views.conditions(report.artifacts, report.assets, report.profiles, rejected, report.run).collect()}
    assert status["HasRegisterableAsset"] == "True" and status["HasTrustSignal"] == "False" and status["HasNoBlockingFetchFailures"] == "True"


def test_empty_bundle(spark, bundle):
    empty = analyze(bundles.read_bundle(spark, bundle).limit(0))
    assert all(t.count() == 0 for t in empty.tables().values())


def test_json_in_json_out(spark, bundle):
    assert json.loads(bundles.analyze_json(spark, open(bundle, encoding="utf-8").read()))["ok"]
    assert json.loads(bundles.analyze_json(spark, "{"))["ok"] is False


def test_files(spark, tmp_path):
    (tmp_path / "b.ttl").write_text("<urn:a> a <urn:NodeShape> .")
    (tmp_path / "a.json").write_text("{}")
    rows = bundles.read_files(spark, str(tmp_path), "https://town.example/").orderBy("ordinal").collect()
    assert [(r.url, r.media_type) for r in rows] == [("https://town.example/a.json", "application/json"), ("https://town.example/b.ttl", "text/turtle")]
    with pytest.raises(ValueError):
        bundles.read_files(spark, str(tmp_path), "ftp://x/")


def test_crawl_stops_at_its_budgets(spark):
    pages = spark.createDataFrame([(f"https://town.example/{k}", 200 if k != 3 else 401, "text/plain", b"x" * (k + 1)) for k in range(20)], "url string, status int, media_type string, body binary")
    follow = lambda good: good.select("run_id", F.explode(F.array(*(F.concat(F.lit("https://town.example/"), (F.regexp_extract("url", "([0-9]+)$", 1).cast("int") * 2 + k).cast("string")) for k in (1, 2)))).alias("url"), F.lit(10).alias("priority"), F.col("url").alias("discovered_from"))
    seeds = spark.createDataFrame([("r", "https://town.example/0"), ("r", "ftp://town.example/")], "run_id string, url string")
    good, bad = crawl.crawl(seeds, bundles.in_memory(pages), follow, crawl.CrawlConfig(max_depth=3, max_fetches=6))
    assert sorted(int(r.url.rsplit("/", 1)[1]) for r in good.collect()) == [0, 1, 2, 4, 5]
    left = {f"https://town.example/{k}": "limit.max_fetches" for k in (6, 9, 10, 11, 12)}
    assert {r.url: r.reason_code for r in bad.collect()} == left | {"https://town.example/3": "auth.required", "ftp://town.example/": "policy.unsupported_scheme"} and bad.count() == 7
    for wrong in ({"max_fetches": 0}, {"width": 0}):
        with pytest.raises(ValueError):
            crawl.CrawlConfig(**wrong)


@pytest.mark.parametrize("width", [1, 2])
def test_best_first_crawl_equals_a_plain_queue(spark, width):
    """Priorities do not follow depth; a refused URL comes up in every round; a late round reaches a candidate of an early one."""
    edges = [(k, (5 * k + j) % 17, (3 * k + 7 * j) % 5) for k in range(17) for j in (1, 2, 3)]
    url = lambda k: f"https://e.example/{k:02}"
    table = spark.createDataFrame([(url(a), url(b), p) for a, b, p in edges] + [(url(a), "ftp://e.example/", 0) for a in range(17)], "url string, target string, priority int")
    follow = lambda good: good.select("run_id", "url").join(table, "url").select("run_id", F.col("target").alias("url"), "priority", F.col("url").alias("discovered_from"))
    fetch = lambda due: due.withColumns({"status": F.lit(200), "media_type": F.lit("text/plain"), "body": F.lit(b"x")})
    seeds = spark.createDataFrame([("a", url(0)), ("b", url(3))], "run_id string, url string")
    good, bad = crawl.crawl(seeds, fetch, follow, crawl.CrawlConfig(max_depth=3, max_fetches=6, width=width))
    for run, start in (("a", 0), ("b", 3)):
        open_, depth, asked = {url(start): 0}, {url(start): 0}, []
        while len(asked) < 6:
            fit = sorted((p, u) for u, p in open_.items() if depth[u] <= 3)[: min(width, 6 - len(asked))]
            if not fit:
                break
            for _, u in fit:
                asked.append(u)
                del open_[u]
            for _, u in fit:
                for a, b, p in edges:
                    if url(a) == u and url(b) not in asked:
                        open_[url(b)] = min(p, open_.get(url(b), p))
                        depth[url(b)] = min(depth[u] + 1, depth.get(url(b), 99))
        assert {r.url: r.depth for r in good.where(F.col("run_id") == run).collect()} == {u: depth[u] for u in asked}
        want = {u: "limit.max_depth" if depth[u] > 3 else "limit.max_fetches" for u in open_} | {"ftp://e.example/": "policy.unsupported_scheme"}
        rows = bad.where(F.col("run_id") == run).collect()
        assert {r.url: r.reason_code for r in rows} == want and len(rows) == len(want)


def test_fetcher_function(spark):
    def fetch(url):
        if url.endswith("bad"):
            raise OSError("no")
        return {"status": 200, "media_type": "text/plain", "body": b"x"}

    due = spark.createDataFrame([("r", "https://a.example/", 0, None), ("r", "https://a.example/bad", 0, None)], "run_id string, url string, depth int, discovered_from string")
    assert sorted((r.url[-3:], r.status) for r in bundles.fetch_with(fetch)(due).collect()) == [("bad", None), ("le/", 200)]


def test_workbench_model(spark, report):
    from lodestrata.plans.board import board

    model = board(report)
    kinds = {r.record_type: r for r in model.records.collect()}
    assert kinds["catalog"].service_count == 2 and kinds["dataset"].parent_id == kinds["catalog"].record_id
    assert kinds["service"].parent_id == kinds["catalog"].record_id
    assert {r.check_id for r in model.checks.where("presence = 'found'").collect()} == {"dcat-ap-jsonld"}
    assert {r.item_id for r in model.items.where("presence = 'found'").collect()} == {"identity-catalog", "identity-dataset", "identity-title"}
    status = {r.category: (r.known, r.total, r.status) for r in model.readiness.collect()}
    assert status["discoverable"] == (3, 6, "missing") and status["validatable"][2] == "not-checked"
    assert model.profiles.first().profile == "dcat-ap-3" and model.edges.count() == 3
    assert model.artifacts.where("presence = 'invalid'").count() == 2
    from lodestrata.plans.board import lens

    seen = lens(model, "access", publisher=False)
    assert {r.record_type for r in seen.records.collect()} <= {"service", "distribution"} and seen.edges.count() == 0 and seen.checks.where("check_id = 'publisher-specific'").count() == 0
    with pytest.raises(ValueError):
        lens(model, "other")


def test_later_values_of_a_node_win(spark):
    from lodestrata.plans.board import merged, record_fields

    rows = [("r", 0, "a", 1, "urn:x", 0, "dcterms:title", "old"), ("r", 1, "b", 1, "urn:x", 3, "dcterms:title", "new"), ("r", 0, "a", 2, "urn:x", 0, "own:colour", "red"), ("r", 0, "a", 3, "_:1", 1, "dcterms:title", "anonymous")]
    fields = spark.createDataFrame(rows, "run_id string, ordinal int, artifact_id string, seq long, node string, occurrence int, key string, value string")
    found = {(r.record_id, r.field_id): (r.value, r.publisher_specific) for r in record_fields(merged(fields)).collect()}
    assert found == {("urn:x", "title"): ("new", False), ("urn:x", "own:colour"): ("red", True), ("a#_:1", "title"): ("anonymous", False)}


def test_envelope(spark, report):
    run = report.run.first().run_id
    rejected = spark.createDataFrame([(run, "ftp://x/", "policy.unsupported_scheme", None)], "run_id string, url string, reason_code string, discovered_from string")
    summary = spark.createDataFrame([(run, 5, 1)], "run_id string, fetched_count int, rejected_count int")
    whole = json.loads(report.to_envelope(rejected, summary).first().envelope)
    assert whole["fetched"]["fetched_count"] == 5 and whole["rejected_fetches"][0]["url"] == "ftp://x/" and len(whole["report"]["artifacts"]) == 6


def test_secrets_do_not_reach_evidence(report):
    for table in (report.findings, report.relation_claims, report.links):
        assert not table.where("evidence.value like '%token=1%' or evidence.href like '%token=1%'").count()


class Site:
    """A transport over a few pages."""

    pages = {
        "https://a.example/": (301, [("Location", "/x")], b""),
        "https://a.example/x": (200, [("Content-Type", "text/html; charset=utf-8"), ("Set-Cookie", "s")], b"hello"),
        "https://a.example/down": (302, [("Location", "http://a.example/x")], b""),
        "https://a.example/loop": (302, [("Location", "/loop")], b""),
        "https://a.example/nowhere": (302, [], b""),
        "https://a.example/big": (200, [], b"x" * 50),
        "https://a.example/private": (403, [], b""),
        "https://a.example/inner": (302, [("Location", "https://inner.example/")], b""),
        "https://a.example/gone": (410, [], b""),
        "https://a.example/odd": (200, [("Content-Length", "many")], b""),
        "https://a.example/said": (200, [("Content-Length", "99")], b""),
        "https://a.example/pieces": (200, [], (b"x" * 10 for _ in range(1000))),
        "https://a.example/slow": (200, [], b"x"),
    }
    asked = []

    def get(self, request):
        self.asked.append(request)
        if request.url.endswith("slow"):
            raise TimeoutError
        status, headers, body = self.pages[request.url]
        return {"status": status, "headers": headers, "body": body}

    def resolve(self, host):
        if host == "lost.example":
            raise OSError("no such host")
        return {"inner.example": ["10.0.0.1"]}.get(host, ["93.184.216.34"])


@pytest.mark.parametrize(
    "path, reason",
    [("", None), ("x", None), ("down", "policy.https_downgrade"), ("loop", "policy.too_many_redirects"), ("nowhere", "policy.redirect_missing_location"), ("big", "limit.body_too_large"), ("private", "auth.required"), ("inner", "policy.private_network_blocked"), ("gone", "fetch.failed"), ("missing", "fetch.failed"), ("odd", "fetch.invalid_header"), ("said", "limit.body_too_large"), ("pieces", "limit.body_too_large"), ("slow", "limit.timeout")],
)
def test_fetch_policy(path, reason):
    from lodestrata.sources import fetch

    site = Site()
    got = fetch.fetch_artifact(f"https://a.example/{path}", site.get, site.resolve, fetch.Policy(max_body_bytes=20))
    assert got["reason_code"] == reason
    assert site.asked[-1].address == "93.184.216.34" and site.asked[-1].most_bytes == 20 and 0 < site.asked[-1].seconds <= 10
    if not reason:
        assert got["media_type"] == "text/html" and got["headers"] == [{"name": "content-type", "value": "text/html; charset=utf-8"}] and got["final_url"].endswith("/x")


@pytest.mark.parametrize("url, reason", [("x", "policy.invalid_url"), ("ftp://a.example/", "policy.unsupported_scheme"), ("https://u:p@a.example/", "policy.embedded_credentials"), ("https:///x", "policy.missing_host"), ("https://lost.example/", "policy.dns_failed")])
def test_refused_urls(url, reason):
    from lodestrata.sources import fetch

    assert fetch.refused(url, fetch.Policy(), Site().resolve) == reason


def test_credentials_stay_at_their_origin():
    from lodestrata.sources import fetch

    site = Site()
    got = fetch.fetch_artifact("https://a.example/private", site.get, site.resolve, fetch.Policy(credential_origin="https://a.example:443/"))
    assert got["reason_code"] == "auth.rejected" and got["credential_sent"]


def test_shared_addresses_are_private_and_time_runs_over_redirects():
    from lodestrata.sources import fetch

    assert fetch.refused("https://a.example/", fetch.Policy(), lambda host: ["100.64.1.1"]) == "policy.private_network_blocked"
    site = Site()
    assert fetch.fetch_artifact("https://a.example/x", site.get, site.resolve, fetch.Policy(timeout_ms=-1))["reason_code"] == "limit.timeout"
    assert crawl.CrawlConfig(max_redirects=1, fetch_timeout_ms=5).policy(allow_private=True) == fetch.Policy(schemes=("http", "https"), max_redirects=1, timeout_ms=5, allow_private=True)


def test_crawl_counts_bytes_by_round(spark):
    pages = spark.createDataFrame([(f"https://e.example/{k}", 200, "text/plain", b"x" * 100) for k in range(8)], "url string, status int, media_type string, body binary")
    seeds = spark.createDataFrame([("r", "https://e.example/0")], "run_id string, url string")
    asked = []

    def follow(good):
        asked.append(sorted(r.url[-1] for r in good.select("url").collect()))
        at = F.substring(F.col("url"), -1, 1).cast("int")
        return good.select("run_id", F.explode(F.array(at * 2 + 1, at * 2 + 2)).alias("k"), F.col("url").alias("discovered_from")).select("run_id", F.concat(F.lit("https://e.example/"), F.col("k").cast("string")).alias("url"), F.lit(10).alias("priority"), "discovered_from")

    good, bad = crawl.crawl(seeds, bundles.in_memory(pages), follow, crawl.CrawlConfig(max_depth=3, max_total_bytes=250))
    assert sorted(r.url[-1] for r in good.collect()) == ["0", "1"]
    assert sorted((r.url[-1], r.reason_code) for r in bad.collect()) == [(k, "limit.total_bytes") for k in "234"]
    assert asked == [["0"], ["1"]]


def test_fetching_in_workers(spark):
    from lodestrata.sources import fetch

    pages = dict(Site.pages)  # workers cannot import this module
    pages.pop("https://a.example/pieces")
    get = lambda request: dict(zip(("status", "headers", "body"), pages[request.url], strict=True))
    due = spark.createDataFrame([("r", "https://a.example/", 0, None), ("r", "ftp://a.example/", 0, None)], "run_id string, url string, depth int, discovered_from string")
    rows = {r.url: r for r in fetch.fetching(get, lambda host: ["93.184.216.34"])(due).collect()}
    assert bytes(rows["https://a.example/"].body) == b"hello" and rows["https://a.example/"].redirect_chain == ["https://a.example/"]
    assert rows["ftp://a.example/"].reason_code == "policy.unsupported_scheme" and rows["ftp://a.example/"].status is None


def test_search_over_a_report(spark, report):
    from lodestrata.operators.capability import CapabilityQuery, InformationNeed, Term
    from lodestrata.plans.search import search

    run = report.run.first().run_id
    find = lambda *terms, rejected=None: search(report, CapabilityQuery("q").need(InformationNeed("n").requires_any(*terms)).terms(spark), rejected).collect()
    (trees,) = find(Term.label("trees"))
    assert trees.source_id == run and trees.access_kind == "metadata_only" and trees.boundary == "gateway_or_intermediary"
    (claim,) = find(Term.iri("https://semiceu.github.io/DCAT-AP/releases/3.0.0/"))[:1]
    assert claim.confidence in ("low", "medium")
    rejected = spark.createDataFrame([(run, "rejected-1", "https://town.example/api", "auth.required")], "run_id string, id string, url string, reason_code string")
    (gated,) = [r for r in find(Term.iri("https://town.example/api"), rejected=rejected) if r.asset_id != "metadata"]
    assert gated.access_kind == "rejected_or_gated" and gated.endpoint_url == "https://town.example/api"


def test_envelopes_are_read_back(spark, report, tmp_path):
    body = report.to_json().first().report
    (tmp_path / "town.envelope.json").write_text(json.dumps({"report": json.loads(body)}))
    (tmp_path / "bare.json").write_text(json.dumps(json.loads(body) | {"run_id": "run:x"}))
    rows = {r.source_id: r for r in bundles.read_envelopes(spark, str(tmp_path)).select("source_id", F.try_variant_get("report", "$.artifact_count", "int").alias("n")).collect()}
    assert rows["town"].n == 6 and rows["run:x"].n == 6
