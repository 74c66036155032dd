"""One query for each operator family over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as header_fns
from ..functions import ids, labels, urls
from ..operators import capability, classify, graph, jsonwalk, links, views, workbench
from ..operators.capability import CapabilityQuery, InformationNeed, Term
from ..sources.store import discard, stored, tidied
from . import crawl, demo
from .demo import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **kinds: str):
    """Register a query and its SQL. kinds: types of columns whose own type in the other engine is wider."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            casts = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in kinds.items())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS q" if casts else sql
        return f

    return register


# ---- identity, classification, links

@query("SELECT page_id, 'artifact:' || substr(sha256('artifact' || chr(0) || regexp_replace(url, '#.*$', '')), 1, 16) AS artifact_id, regexp_replace(url, '#.*$', '') AS normal_url FROM pages")
def artifact_identity(spark, d):
    normal = urls.normalize(F.col("url"))
    return load(spark, d, "pages").select("page_id", ids.det_id("artifact", normal).alias("artifact_id"), normal.alias("normal_url"))


def _artifacts(spark, d):
    pages = load(spark, d, "pages").select(F.lit("pages").alias("origin"), F.col("url"), F.lit("text/html").alias("media_type"), F.col("html").alias("body"))
    docs = load(spark, d, "documents").select(F.lit("documents").alias("origin"), F.concat(F.lit("https://data.example/documents/"), "doc_id").alias("url"), F.lit("text/plain").alias("media_type"), F.col("text").alias("body"))
    events = load(spark, d, "events").select(F.lit("events").alias("origin"), F.concat(F.lit("https://data.example/events/"), "event_id").alias("url"), F.lit("application/json").alias("media_type"), F.col("props").alias("body"))
    return pages.unionByName(docs).unionByName(events)


@query("""
SELECT origin, kind, CASE WHEN kind = 'unknown' THEN 'unsupported' ELSE 'fetched' END AS status, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (
  SELECT 'pages' AS origin, 'html_landing_page' AS kind, strlen(html) AS bytes FROM pages
  UNION ALL SELECT 'documents', CASE WHEN ltrim(text) LIKE '<html%' OR ltrim(text) LIKE '<!doctype html%' THEN 'html_landing_page' ELSE 'unknown' END, strlen(text) FROM documents
  UNION ALL SELECT 'events', CASE WHEN json_extract(props, '$.openapi') IS NOT NULL THEN 'open_api' WHEN json_extract(props, '$.links') IS NOT NULL THEN 'metadata_index' ELSE 'unknown' END, strlen(props) FROM events)
GROUP BY 1, 2""")
def artifact_classify(spark, d):
    kind = classify.artifact_kind(F.col("url"), F.col("media_type"), F.col("body"))
    sorted_ = _artifacts(spark, d).select("origin", kind.alias("kind"), F.octet_length("body").alias("bytes"))
    status = classify.artifact_status(F.lit(200), F.col("kind"), F.lit(None))
    return sorted_.select("origin", "kind", status.alias("status"), "bytes").groupBy("origin", "kind", "status").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


_ANCHORS = "a AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s+[^>]*>') AS tags FROM pages), t AS (SELECT page_id, url, unnest(tags) AS tag, unnest(range(len(tags))) AS position FROM a), h AS (SELECT page_id, url, position, regexp_extract(tag, 'href=[\"'']([^\"'']+)[\"'']', 1) AS href FROM t)"


def _anchors(spark, d):
    return links.html_tags(load(spark, d, "pages").select("page_id", "url", "html"), "a")


@query(f"WITH {_ANCHORS} SELECT page_id, position::BIGINT AS position, href FROM h WHERE href <> ''")
def html_links(spark, d):
    return _anchors(spark, d).select("page_id", F.col("position").cast("long").alias("position"), "href")


@query(f"WITH {_ANCHORS} SELECT page_id, position::BIGINT AS position, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || href ELSE href END AS to_url FROM h WHERE href <> ''")
def link_resolve(spark, d):
    return _anchors(spark, d).select("page_id", F.col("position").cast("long").alias("position"), urls.resolve(F.col("url"), F.col("href")).alias("to_url"))


def _raw_links(spark, d):
    k = F.col("page_id") % 4
    href = F.when(k == 0, F.concat("href", F.lit("?access_token=x"))).when(k == 1, F.concat("href", F.lit("?page=2"))).when(k == 2, F.concat(F.lit("ftp:"), "href")).otherwise(F.col("href"))
    rel = F.when(F.col("position") % 3 == 0, "alternate").when(F.col("position") % 3 == 1, "describedby")
    return _anchors(spark, d).select(
        urls.host(F.col("url")).alias("run_id"), F.col("page_id").cast("int").alias("ordinal"), F.col("position").cast("long").alias("seq"), F.concat(F.lit("artifact:"), "page_id").alias("from_artifact_id"), F.col("url").alias("from_url"),
        href.alias("href"), rel.alias("rel"), F.when(rel.isNull(), "dcat:catalog").alias("predicate"), F.lit(None).cast("string").alias("role"),
    )


_RAW = _ANCHORS + """, r AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS run_id, page_id, position, url AS from_url,
    CASE page_id % 4 WHEN 0 THEN href || '?access_token=x' WHEN 1 THEN href || '?page=2' WHEN 2 THEN 'ftp:' || href ELSE href END AS href,
    CASE position % 3 WHEN 0 THEN 'alternate' WHEN 1 THEN 'describedby' END AS rel FROM h WHERE href <> ''),
v AS (SELECT *, CASE WHEN starts_with(href, '/') THEN regexp_extract(from_url, '^[a-z]+://[^/?#]*', 0) || href ELSE href END AS to_url,
  CASE page_id % 4 WHEN 0 THEN 'secret' WHEN 2 THEN 'scheme' ELSE 'accepted' END AS verdict FROM r)"""


@query(f"WITH {_RAW} SELECT verdict, verdict = 'accepted' AS fetchable, count(*) AS n FROM v GROUP BY 1, 2")
def link_verdict(spark, d):
    return links.judged(_raw_links(spark, d)).groupBy("verdict", "fetchable").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?token=REDACTED&page=2' AS core, regexp_replace(url, '[?#].*$', '') || '?token=REDACTED&page=2' AS facade, regexp_replace(url, '[?#].*$', '') || '?session_sig=REDACTED' AS wide, regexp_replace(url, '[?#].*$', '') || '?session_sig=1' AS narrow FROM pages")
def url_redact(spark, d):
    bare = F.regexp_replace("url", "[?#].*$", "")
    named = F.concat(F.regexp_replace(bare, "://", "://user:pw@"), F.lit("?token=t"), F.col("page_id").cast("string"), F.lit("&page=2"))
    signed = F.concat(bare, F.lit("?session_sig=1"))
    return load(spark, d, "pages").select("page_id", urls.redact(named).alias("core"), urls.redact(named, "facade").alias("facade"), urls.redact(signed).alias("wide"), urls.redact(signed, "facade").alias("narrow"))


@query(f"""WITH {_RAW}, c AS (
  SELECT run_id, to_url AS url, 'fetch:' || substr(sha256('fetch' || chr(0) || 'artifact:' || page_id || chr(0) || to_url), 1, 16) AS id,
    CASE WHEN rel IS NULL THEN 10 WHEN rel = 'describedby' THEN 20 ELSE 30 END AS priority, page_id, position FROM v WHERE verdict = 'accepted'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, id ORDER BY page_id, position) AS k FROM c) WHERE k = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority, url, id) AS rank, count(*) OVER (PARTITION BY run_id) > 20 AS truncated FROM f)
SELECT run_id, id, url, priority, rank, truncated FROM n WHERE rank <= 20""", rank="INTEGER")
def next_fetch_topk(spark, d):
    found = links.candidates(links.judged(_raw_links(spark, d)))
    total = found.groupBy("run_id").agg((F.count("*") > links.CANDIDATES).alias("truncated"))
    return links.top_candidates(found).join(total, "run_id").select("run_id", "id", "url", "priority", "rank", "truncated")


@query(f"""WITH {_RAW} SELECT run_id, 'link:' || substr(sha256('link' || chr(0) || from_url || chr(0) || to_url || chr(0) || coalesce(rel, 'dcat:catalog')), 1, 16) AS id, min(page_id) AS first_page, count(*) AS n FROM v WHERE verdict = 'accepted' GROUP BY 1, 2""")
def link_ids(spark, d):
    named = links.judged(_raw_links(spark, d))
    once = links.links(named)
    n = named.where("verdict = 'accepted'").groupBy("run_id", ids.det_id("link", "from_url", "to_url", F.coalesce("rel", "predicate")).alias("id")).agg(F.count("*").alias("n"))
    return once.select("run_id", "id", F.col("ordinal").cast("long").alias("first_page")).join(n, ["run_id", "id"])


@query("""SELECT 'all' AS run_id, (SELECT count(*) FROM pages) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM events) AS artifact_count,
 (SELECT count(*) FROM documents) + (SELECT count(*) FROM events WHERE json_extract(props, '$.k') IS NOT NULL) AS unsupported_artifact_count, 0::BIGINT AS failed_artifact_count""")
def report_summary(spark, d):
    kind = classify.artifact_kind(F.col("url"), F.col("media_type"), F.col("body"))
    a = _artifacts(spark, d).select(classify.artifact_status(F.lit(200), kind, F.lit(None)).alias("status"))
    return a.agg(F.lit("all").alias("run_id"), F.count("*").alias("artifact_count"), F.count_if(F.col("status") == "unsupported").alias("unsupported_artifact_count"), F.count_if(F.col("status") == "failed").alias("failed_artifact_count"))


@query("SELECT event_id, '/k' AS pointer, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_pointer_walk(spark, d):
    walked = jsonwalk.leaves(jsonwalk.walk(load(spark, d, "events"), "event_id", "props"))
    return walked.select(F.col("key").alias("event_id"), "pointer", "text")


@query("""SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text_key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY 1""")
def first_wins_dedupe(spark, d):
    docs = load(spark, d, "documents").select(F.sha2(labels.canonical_label(F.col("text")).cast("binary"), 256).alias("text_key"), "doc_id", "source")
    n = docs.groupBy("text_key").agg(F.count("*").alias("n"))
    return links.first_by(docs, ["text_key"], ["doc_id"]).join(n, "text_key")


# ---- scalar functions

@query("""SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '  API ', '\\s+', ' ', 'g'))) AS label, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS access_label, lower(regexp_extract(p_brand, '#(.*)$', 1)) AS field FROM part""")
def canonical_labels(spark, d):
    raw = F.concat(F.lit("  "), "p_name", F.lit("  API "))
    return load(spark, d, "part").select("p_partkey", labels.canonical_label(raw).alias("label"), labels.canonical_access_label(raw).alias("access_label"), labels.loose_field(F.concat(F.lit("https://data.example/x#"), "p_brand")).alias("field"))


def _headers():
    entry = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    link = F.concat(F.lit("<https://data.example/n/"), F.col("n_nationkey").cast("string"), F.lit('>; rel="describedby"; type="text/turtle", </r/'), F.col("n_regionkey").cast("string"), F.lit(">; rel=alternate"))
    return F.array(entry("Authorization", F.col("n_name")), entry("Link", link), entry("ETag", F.col("n_name")), entry("X-Other", F.col("n_name")))


@query("""SELECT n_nationkey, 'Authorization=[redacted];ETag=' || n_name AS redacted, 'etag=' || n_name AS kept, n_name AS etag FROM nation""")
def header_redaction(spark, d):
    text = lambda hs: F.array_join(F.transform(hs, lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";")
    some = F.filter(_headers(), lambda h: ~h["name"].isin("Link", "X-Other"))
    return load(spark, d, "nation").select("n_nationkey", text(header_fns.redact(some)).alias("redacted"), text(header_fns.sanitize(some)).alias("kept"), header_fns.value(_headers(), "etag").alias("etag"))


@query("""SELECT n_nationkey, 0 AS position, 'https://data.example/n/' || n_nationkey AS href, 'describedby' AS rel, 'text/turtle' AS type FROM nation UNION ALL SELECT n_nationkey, 1, '/r/' || n_regionkey, 'alternate', NULL FROM nation""")
def header_links(spark, d):
    return links.header_links(load(spark, d, "nation").select("n_nationkey", _headers().alias("headers")))


@query("SELECT count_if(regexp_matches(text, 'secret|token|api_key|password')) AS flagged, count(*) AS n FROM (SELECT lower(text) AS text FROM documents)", flagged="BIGINT")
def sensitive_flags(spark, d):
    return load(spark, d, "documents").agg(F.count_if(labels.is_sensitive(F.col("text"), ("secret", "token", "api_key", "password"))).alias("flagged"), F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN starts_with(url, 'https') THEN '443' ELSE '80' END AS port,
  nullif(regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]+/[^/?#]+)', 1), '') AS route_key, CASE WHEN contains(url, '?') THEN regexp_extract(url, '\\?([^#]*)', 1) END AS query, CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'policy.unsupported_scheme' END AS refused FROM pages""")
def url_parts(spark, d):
    c = F.col("url")
    other = F.when(F.col("page_id") % 2 == 0, c).otherwise(F.concat(F.lit("ftp://"), urls.host(c), F.lit("/")))
    return load(spark, d, "pages").select("page_id", urls.scheme(c).alias("scheme"), urls.host(c).alias("host"), urls.port(c).alias("port"), urls.route_key(c).alias("route_key"), urls.query(c).alias("query"), urls.fetch_policy(other).alias("refused"))


# ---- graph

_B = "'https://data.example/"
_GRAPH = f"""own AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem),
channel AS (SELECT {_B}customer/' || c_custkey AS s, {_B}segment/' || c_mktsegment AS o FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
holds AS (SELECT {_B}customer/' || o_custkey AS s, {_B}orders/' || o_orderkey AS o FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
haslist AS (SELECT DISTINCT {_B}orders/' || l_orderkey AS s, {_B}list/' || l_orderkey || '-' || l_returnflag AS o FROM own),
spec AS (SELECT DISTINCT {_B}list/' || l_orderkey || '-' || l_returnflag AS s, {_B}part/' || l_partkey AS o FROM own WHERE l_partkey IN (SELECT p_partkey FROM part)),
offer AS (SELECT DISTINCT {_B}supplier/' || l_suppkey AS s, {_B}part/' || l_partkey AS o FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)),
provided AS (SELECT {_B}supplier/' || s_suppkey AS s, {_B}nation/' || s_nationkey AS o FROM supplier WHERE s_acctbal >= 1000),
access AS (SELECT {_B}supplier/' || s_suppkey AS s, {_B}access/' || s_suppkey AS o FROM supplier WHERE s_suppkey % 3 <> 0),
partof AS (SELECT {_B}nation/' || n_nationkey AS s, {_B}region/' || n_regionkey AS o FROM nation),
endpoint AS (SELECT {_B}access/' || s_suppkey AS s, {_B}api/' || s_suppkey AS o FROM supplier),
edges AS (SELECT 'cv:hasChannel' AS p, * FROM channel UNION ALL SELECT 'cv:holdsRequirement', * FROM holds UNION ALL SELECT 'cccev:hasEvidenceTypeList', * FROM haslist UNION ALL SELECT 'cccev:specifiesEvidenceType', * FROM spec
  UNION ALL SELECT 'registry_manifest:evidenceType', * FROM offer UNION ALL SELECT 'registry_manifest:providedBy', * FROM provided UNION ALL SELECT 'registry_manifest:evidenceService', * FROM access UNION ALL SELECT 'dcterms:isPartOf', * FROM partof UNION ALL SELECT 'dcat:endpointURL', * FROM endpoint),
rtype AS (SELECT DISTINCT h.s AS r, spec.o AS t FROM haslist h JOIN spec ON h.o = spec.s),
stype AS (SELECT DISTINCT h.s AS c, rt.t FROM holds h JOIN rtype rt ON h.o = rt.r),
tprov AS (SELECT DISTINCT offer.o AS t, provided.o AS prov FROM offer JOIN provided ON offer.s = provided.s),
tacc AS (SELECT DISTINCT offer.o AS t, access.o AS svc FROM offer JOIN access ON offer.s = access.s),
opt AS (SELECT h.s AS requirement, h.o AS option, spec.o AS t FROM haslist h LEFT JOIN spec ON h.o = spec.s),
optacc AS (SELECT requirement, option, count(t) AS n_types, count_if(t IS NOT NULL AND t NOT IN (SELECT t FROM tacc)) AS n_missing FROM opt GROUP BY 1, 2)"""


def _graph(spark, d, keep=False, paths=False):
    """The graph over numbered nodes; queries name them at the end. keep: what several methods share is stored when it is first asked for. paths: by which relations a target is reached, too."""
    rel = demo.numbered_relations(spark, d, once=False)  # the graph makes edges distinct
    return graph.ServiceGraph(demo.numbered_assets(spark, d), rel, demo.claims(demo.numbered_relations(spark, d)), keep, paths, demo.parts(spark, d))


def _named(frame, *columns):
    return frame.withColumns({c: demo.named(c) for c in columns})


@query(f"WITH {_GRAPH} SELECT p AS predicate, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM edges GROUP BY 1")
def edge_table(spark, d):
    return demo.numbered_edges(spark, d).groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"), F.count_distinct("object_id").alias("objects"))


@query(f"WITH {_GRAPH} SELECT 'relation:' || substr(sha256('relation' || chr(0) || s || '|' || p || '|' || o), 1, 16) AS relation_id, p AS predicate FROM edges")
def relation_ids(spark, d):
    return demo.relations(spark, d).select("relation_id", "predicate")


@query(f"WITH {_GRAPH} SELECT s AS subject_id, o AS object_id FROM edges WHERE p = 'dcterms:isPartOf'")
def claims_integrity(spark, d):
    rel = demo.numbered_relations(spark, d)
    kept = demo.claims(rel.where("predicate <> 'dcterms:isPartOf'"))
    return _named(graph.unclaimed(rel, kept).select("subject_id", "object_id"), "subject_id", "object_id")


@query(f"WITH {_GRAPH} SELECT s AS source, count(*) AS n, min(o) AS first FROM holds GROUP BY 1")
def outgoing_assets(spark, d):
    return _named(_graph(spark, d).requirements().groupBy("source").agg(F.count("*").alias("n"), F.min(demo.named("target")).alias("first")), "source")


@query(f"WITH {_GRAPH} SELECT o AS source, count(*) AS n, min(s) AS first FROM offer GROUP BY 1")
def incoming_assets(spark, d):
    return _named(_graph(spark, d).offerings().groupBy("source").agg(F.count("*").alias("n"), F.min(demo.named("target")).alias("first")), "source")


@query(f"WITH {_GRAPH} SELECT c AS source, t AS target FROM stype")
def accepted_evidence_types(spark, d):
    return _named(_graph(spark, d).service_types().select("source", "target"), "source", "target")


@query(f"WITH {_GRAPH} SELECT t AS source, prov AS target FROM tprov")
def evidence_providers(spark, d):
    return _named(_graph(spark, d).type_providers().select("source", "target"), "source", "target")


@query(f"WITH {_GRAPH} SELECT DISTINCT c AS source, prov AS target FROM stype JOIN tprov ON stype.t = tprov.t")
def service_providers(spark, d):
    return _named(_graph(spark, d).service_providers().select("source", "target"), "source", "target")


@query(f"WITH {_GRAPH} SELECT requirement, option, n_types, n_missing, n_types > 0 AND n_missing = 0 AS satisfiable FROM optacc", n_missing="BIGINT")
def evidence_option_satisfiable(spark, d):
    return _named(_graph(spark, d).option_access().drop("run_id"), "requirement", "option")


@query(f"WITH {_GRAPH} SELECT requirement, bool_or(n_types > 0 AND n_missing = 0) AS satisfiable FROM optacc GROUP BY 1")
def satisfiable_requirements(spark, d):
    return _named(_graph(spark, d).requirement_access().drop("run_id"), "requirement")


@query(f"WITH {_GRAPH} SELECT option, t AS target FROM opt WHERE t IS NOT NULL AND t NOT IN (SELECT t FROM tacc)")
def missing_evidence_types(spark, d):
    return _named(_graph(spark, d).missing_types().select("option", "target"), "option", "target")


@query(f"""WITH {_GRAPH}, svc AS (SELECT {_B}customer/' || c_custkey AS a FROM customer), typ AS (SELECT DISTINCT t AS a FROM stype), off AS (SELECT DISTINCT offer.s AS a FROM offer WHERE o IN (SELECT a FROM typ))
SELECT a AS asset_id, 'cv:hasChannel' AS predicate FROM svc WHERE a NOT IN (SELECT s FROM channel)
UNION ALL SELECT a, 'cv:holdsRequirement' FROM svc WHERE a NOT IN (SELECT s FROM holds)
UNION ALL SELECT DISTINCT o, 'cccev:hasEvidenceTypeList' FROM holds WHERE o NOT IN (SELECT r FROM rtype)
UNION ALL SELECT a, 'registry_manifest:evidenceType' FROM typ WHERE a NOT IN (SELECT o FROM offer)
UNION ALL SELECT a, 'registry_manifest:providedBy' FROM off WHERE a NOT IN (SELECT s FROM provided)
UNION ALL SELECT a, 'registry_manifest:evidenceService' FROM off WHERE a NOT IN (SELECT s FROM access)""")
def service_gaps(spark, d):
    return _named(_graph(spark, d, True).gaps().drop("run_id"), "asset_id")


@query(f"""WITH {_GRAPH} SELECT kind, count(*) AS n, count(DISTINCT source) AS services FROM (
 SELECT 'evidence_type' AS kind, c AS source, t FROM stype UNION ALL SELECT DISTINCT 'evidence_provider', c, prov FROM stype JOIN tprov ON stype.t = tprov.t
 UNION ALL SELECT DISTINCT 'evidence_access_service', c, svc FROM stype JOIN tacc ON stype.t = tacc.t) GROUP BY 1""")
def service_routes(spark, d):
    return _graph(spark, d, True).routes().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("source").alias("services"))


_ID = "'relation:' || substr(sha256('relation' || chr(0) || {s} || '|{p}|' || {o}), 1, 16)"


@query(f"""WITH {_GRAPH},
rpath AS (SELECT h.s AS r, spec.o AS t, min([{_ID.format(s='h.s', p='cccev:hasEvidenceTypeList', o='h.o')}, {_ID.format(s='spec.s', p='cccev:specifiesEvidenceType', o='spec.o')}]) AS path FROM haslist h JOIN spec ON h.o = spec.s GROUP BY 1, 2),
spath AS (SELECT h.s AS c, rpath.t, min(list_concat([{_ID.format(s='h.s', p='cv:holdsRequirement', o='h.o')}], rpath.path)) AS path FROM holds h JOIN rpath ON h.o = rpath.r GROUP BY 1, 2),
step AS (SELECT c, t, unnest(path) AS relation_id, unnest(range(3)) AS step FROM spath),
claim AS (SELECT {_ID.format(s='s', p='cv:holdsRequirement', o='o')} AS relation_id, 2 AS n FROM holds)
SELECT c AS source, sum(coalesce(claim.n, 1)) AS claims, count(DISTINCT t) AS routes, min(step.relation_id) AS first_relation FROM step LEFT JOIN claim ON step.relation_id = claim.relation_id GROUP BY 1""", claims="BIGINT")
def route_provenance(spark, d):
    with tidied(spark):
        rel = stored(demo.numbered_relations(spark, d).where(F.col("predicate").isin(*graph.TYPED)), "relations")  # no other is on a path, so none needs its claims
    n = demo.slices(spark, d)
    g = graph.ServiceGraph(demo.numbered_assets(spark, d), rel, demo.claims(rel), parts=demo.parts(spark, d)).counted(n)
    discard(rel)
    found = g.claimed_types(n)
    return found.select(demo.named("source").alias("source"), "claims", "routes", demo.relation_text("first").alias("first_relation"))


@query(f"""WITH {_GRAPH}, used AS (SELECT DISTINCT svc FROM tacc) SELECT svc AS asset_id, 'dcat:endpointURL' AS predicate FROM used WHERE svc NOT IN (SELECT s FROM endpoint WHERE NOT ends_with(s, '5'))""")
def endpoint_gaps(spark, d):
    rel = demo.numbered_relations(spark, d).where(~((F.col("predicate") == "dcat:endpointURL") & demo.named("subject_id").endswith("5")))
    return _named(graph.ServiceGraph(demo.numbered_assets(spark, d), rel).endpoint_gaps().select("asset_id", "predicate"), "asset_id")


@query(f"""WITH {_GRAPH}, b AS (SELECT requirement, option, count(DISTINCT t) AS n_types, count(DISTINCT CASE WHEN t NOT IN (SELECT t FROM tacc) THEN t END) AS n_missing, min(t) AS first_type FROM opt GROUP BY 1, 2)
SELECT holds.s AS source, b.requirement, b.option, n_types, n_missing, first_type, n_types > 0 AND n_missing = 0 AS complete FROM holds JOIN b ON holds.o = b.requirement""", n_types="INTEGER", n_missing="INTEGER")
def evidence_bundles(spark, d):
    found = _graph(spark, d).stored().bundles().select("source", "requirement", "option", F.size("types").alias("n_types"), F.size("missing").alias("n_missing"), F.array_min(F.transform("types", demo.named)).alias("first_type"), "complete")
    return _named(found, "source", "requirement", "option")


@query(f"WITH {_GRAPH} SELECT t AS source, count(*) AS n, min(c) AS first FROM stype GROUP BY 1")
def reverse_services(spark, d):
    return _named(_graph(spark, d).services_of_type().groupBy("source").agg(F.count("*").alias("n"), F.min(demo.named("target")).alias("first")), "source")


@query(f"WITH {_GRAPH} SELECT s AS source, o AS url FROM endpoint")
def endpoint_projection(spark, d):
    return graph.ServiceGraph(demo.assets(spark, d), demo.relations(spark, d)).endpoint_urls().select("source", "url")


# ---- capability search

_ASSETS = f"""assets AS (
 SELECT {_B}part/' || p_partkey AS id, 'evidence_type' AS kind, p_name AS title, p_brand AS publisher, NULL::VARCHAR AS endpoint FROM part
 UNION ALL SELECT {_B}supplier/' || s_suppkey, 'evidence_offering', s_name, NULL, NULL FROM supplier
 UNION ALL SELECT {_B}nation/' || n_nationkey, 'evidence_provider', n_name, NULL, NULL FROM nation
 UNION ALL SELECT {_B}access/' || s_suppkey, 'data_service', s_name || ' API', NULL, {_B}api/' || s_suppkey FROM supplier
 UNION ALL SELECT {_B}region/' || r_regionkey, 'catalog', r_name, NULL, NULL FROM region
 UNION ALL SELECT {_B}customer/' || c_custkey, 'public_service', c_name, c_mktsegment, NULL FROM customer
 UNION ALL SELECT DISTINCT {_B}segment/' || c_mktsegment, 'channel', c_mktsegment, NULL, NULL FROM customer
 UNION ALL SELECT {_B}orders/' || o_orderkey, 'requirement', 'Order ' || o_orderkey, NULL, NULL FROM orders
 UNION ALL SELECT DISTINCT {_B}list/' || l_orderkey || '-' || l_returnflag, 'evidence_type_list', l_returnflag, NULL, NULL FROM lineitem)"""
_INDEX = _ASSETS + """, idx AS (
 SELECT DISTINCT id, kind, 'label' AS term_kind, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS value FROM assets
 UNION SELECT DISTINCT id, kind, 'label', lower(trim(regexp_replace(publisher, '\\s+', ' ', 'g'))) FROM assets WHERE publisher IS NOT NULL
 UNION SELECT DISTINCT id, kind, 'iri', id FROM assets UNION SELECT DISTINCT id, kind, 'iri', endpoint FROM assets WHERE endpoint IS NOT NULL)"""


def _searched(spark, d):
    return demo.assets(spark, d)


def _index(spark, d):
    return capability.inverted(capability.asset_records(_searched(spark, d)))


def _postings(spark, d):
    return capability.postings(capability.asset_records(_searched(spark, d)))


#: The same request for both engines.
BRAND, OTHER, PLACE = "Brand#11", "Brand#23", "https://data.example/access/7"


def _terms(spark):
    need = lambda n: InformationNeed(n)
    q = CapabilityQuery("q", purpose=Term.label("FRANCE"))
    q.need(need("brand").requires_any(Term.label(f" {BRAND.upper()} "), Term.label(OTHER)).about_any(Term.label("germany")))
    q.need(need("place").requires_any(Term.iri(PLACE), Term.label("Supplier#000000008 api")))
    q.need(need("both").requires_all(Term.label(BRAND), Term.iri("https://data.example/part/3")))
    q.need(need("none").requires_any(Term.label("large")))
    return q.terms(spark)


_TERMS = f"""terms AS (SELECT * FROM (VALUES ('brand','any',0,'label','{BRAND.lower()}'), ('brand','any',0,'label','{OTHER.lower()}'), ('place','any',0,'iri','{PLACE}'), ('place','any',0,'label','supplier#000000008 api'),
 ('both','all',0,'label','{BRAND.lower()}'), ('both','all',1,'iri','https://data.example/part/3'), ('none','any',0,'label','large')) AS t(need_id, role, g, term_kind, value)),
hit AS (SELECT t.need_id, t.role, t.g, t.term_kind, t.value, i.id, i.kind FROM idx i JOIN terms t ON i.term_kind = t.term_kind AND i.value = t.value),
want AS (SELECT need_id, max(CASE WHEN role = 'any' THEN 1 ELSE 0 END) AS wa, count(DISTINCT CASE WHEN role = 'all' THEN g END) AS wl FROM terms GROUP BY 1),
per AS (SELECT need_id, id, kind, max(CASE WHEN role = 'any' THEN 1 ELSE 0 END) AS ha, count(DISTINCT CASE WHEN role = 'all' THEN g END) AS hl, count_if(kind = 'data_service') AS structured, count_if(kind <> 'data_service') AS metadata FROM hit GROUP BY 1, 2, 3),
m AS (SELECT per.*, CASE WHEN a.endpoint IS NOT NULL THEN 1 ELSE 0 END AS access, a.endpoint FROM per JOIN want USING (need_id) JOIN assets a ON a.id = per.id WHERE ha = wa AND hl = wl),
s AS (SELECT *, CASE WHEN structured > 0 AND access > 0 THEN 'high' WHEN structured > 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN access = 1 THEN 5 ELSE 7 END AS gap_count FROM m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY need_id ORDER BY structured DESC, metadata DESC, access DESC, gap_count, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, 'demo:' || need_id || ':' || id) AS rank FROM s)"""


@query(f"WITH {_INDEX} SELECT id AS asset_id, term_kind, value FROM idx WHERE value <> ''")
def inverted_index(spark, d):
    return _index(spark, d).select("asset_id", "term_kind", "value")


def _need(name):
    def run(spark, d):
        asked = capability.expanded_terms(_terms(spark))
        found = stored(capability.hits(_postings(spark, d), asked), "hits")
        return capability.matched(found, asked).where(F.col("need_id").isin(*name)).select("need_id", "asset_id", "structured", "metadata")

    return run


@query(f"WITH {_INDEX}, {_TERMS} SELECT need_id, id AS asset_id, structured::INT AS structured, metadata::INT AS metadata FROM m WHERE need_id IN ('brand', 'place', 'none')")
def match_any(spark, d):
    return _need(("brand", "place", "none"))(spark, d)


@query(f"WITH {_INDEX}, {_TERMS} SELECT need_id, id AS asset_id, structured::INT AS structured, metadata::INT AS metadata FROM m WHERE need_id = 'both'")
def match_all(spark, d):
    return _need(("both",))(spark, d)


@query(f"WITH {_INDEX} SELECT DISTINCT id AS asset_id FROM idx WHERE term_kind = 'label' AND value IN ('{BRAND.lower()}', 'france') OR term_kind = 'iri' AND value = '{PLACE}'")
def match_mapping(spark, d):
    mappings = spark.createDataFrame([("set", "m1", BRAND, ["France"], [PLACE], ["none"])], "set_id string, mapping_id string, label string, labels array<string>, iris array<string>, fields array<string>")
    terms = CapabilityQuery("q").need(InformationNeed("n").requires_any(Term.reviewed_mapping("set", "m1"))).terms(spark)
    asked = capability.expanded_terms(terms, mappings)
    return capability.matched(stored(capability.hits(_postings(spark, d), asked), "hits"), asked).select("asset_id")


def _search(spark, d):
    return capability.search(_postings(spark, d), _searched(spark, d), _terms(spark))


@query(f"WITH {_INDEX}, {_TERMS} SELECT need_id, id AS asset_id, rank, structured::INT AS structured, metadata::INT AS metadata, access, confidence, gap_count FROM ranked", rank="INTEGER")
def capability_rank(spark, d):
    """The flagship: index, match, score and rank for all needs."""
    return _search(spark, d).select("need_id", "asset_id", "rank", "structured", "metadata", "access", "confidence", F.size("gaps").alias("gap_count"))


@query(f"""WITH {_INDEX}, {_TERMS} SELECT need_id, id AS asset_id, CASE WHEN access = 1 THEN '' ELSE 'NoCallableAccessMethod,OperationDetailsUnavailable,' END || 'RequiredIdentifierUnknown,LegalBasisUnknown,AuthorityUnknown,SourceOfTruthUnknown,FreshnessUnknown' AS gaps FROM s""")
def capability_gaps(spark, d):
    return _search(spark, d).select("need_id", "asset_id", F.array_join("gaps", ",").alias("gaps"))


@query(f"""WITH {_ASSETS} SELECT id AS asset_id, CASE WHEN endpoint IS NOT NULL THEN 'api_description_available' ELSE 'metadata_only' END AS access_kind, endpoint AS endpoint_url, CASE WHEN endpoint IS NOT NULL THEN 'https' END AS scheme FROM assets""")
def access_summary(spark, d):
    none = F.lit(None).cast("string")
    a = _searched(spark, d).withColumn("s", capability.access_of(F.col("kind"), F.col("uri"), F.col("endpoint_url"), none, none))
    return a.select(F.col("id").alias("asset_id"), F.col("s.kind").alias("access_kind"), "s.endpoint_url", F.when(F.col("s.protocol_hint") == "http", urls.scheme(F.col("s.endpoint_url"))).alias("scheme"))


@query(f"""WITH {_INDEX}, {_TERMS} SELECT need_id, min(rank) AS rank, coalesce(endpoint, 'demo:' || need_id || ':' || id) AS route_key FROM ranked GROUP BY need_id, coalesce(endpoint, 'demo:' || need_id || ':' || id)""", rank="INTEGER")
def route_identity_dedupe(spark, d):
    return _search(spark, d).select("need_id", "rank", F.coalesce("endpoint_url", "distribution_url", "source_url", "route_id").alias("route_key"))


def _signals(spark, d):
    """Signals of suppliers, by their key."""
    k = F.col("s_suppkey")
    names = F.array_compact(F.array(F.when(k % 2 == 0, "dcterms:publisher"), F.when(k % 3 == 0, "dcatap:applicableLegislation"), F.when(k % 5 == 0, "dcterms:modified"), F.when(k % 2 == 0, "cpsv:produces")))
    return load(spark, d, "supplier").select(F.lit("demo").alias("run_id"), demo.uri("supplier", "s_suppkey").alias("asset_id"), F.lit("semantic.standard_signal").alias("code"), F.explode(names).alias("standard_iri"))


@query(f"""SELECT {_B}supplier/' || s_suppkey AS asset_id, s_suppkey % 2 = 0 AS has_authority, s_suppkey % 3 = 0 AS has_legal_basis, s_suppkey % 5 = 0 AS has_freshness, CASE WHEN s_suppkey % 6 = 0 THEN 'candidate_source' ELSE 'candidate_route' END AS role FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0""")
def candidate_role(spark, d):
    s = capability.standard_signals(_signals(spark, d))
    return s.select("asset_id", "has_authority", "has_legal_basis", "has_freshness", capability.role(F.col("has_source"), F.col("has_authority"), F.col("has_legal_basis")).alias("role"))


@query("SELECT p_brand AS run_id, count(DISTINCT p_type) >= 2 AS ambiguous, CASE WHEN count(DISTINCT p_type) >= 2 THEN 'ambiguous' ELSE 'gateway_or_intermediary' END AS boundary FROM part GROUP BY 1")
def boundary_ambiguity(spark, d):
    sets = load(spark, d, "part").select(F.col("p_brand").alias("run_id"), F.lit("dataset").alias("kind"), F.lit(None).cast("string").alias("uri"), F.col("p_type").alias("title"), F.lit("x").alias("id"))
    return capability.ambiguous_runs(sets).select("run_id", "ambiguous", capability.boundary(F.col("ambiguous"), F.lit("asset")).alias("boundary"))


@query("""WITH d AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 4 = 0), o AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT o.s_suppkey, min(d.s_suppkey) AS distribution FROM o JOIN d ON o.s_nationkey = d.s_nationkey GROUP BY 1""")
def related_distributions(spark, d):
    dist = F.col("s_suppkey") % 4 == 0
    a = load(spark, d, "supplier").select(F.lit("demo").alias("run_id"), F.col("s_suppkey").alias("id"), F.when(dist, "distribution").otherwise("data_service").alias("kind"), F.concat(F.col("s_name"), F.when(dist, " distribution").otherwise("")).alias("title"), F.lit(None).cast("string").alias("uri"), F.concat(F.lit("https://data.example/nation/"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_suppkey").alias("endpoint_url"), F.col("s_suppkey").alias("ordinal"), F.lit(0).alias("seq"))
    return capability.related_distribution(a).select(F.col("id").alias("s_suppkey"), "distribution")


@query("SELECT s_suppkey, s_nationkey::BIGINT AS dataset FROM supplier")
def related_datasets(spark, d):
    none = F.lit(None).cast("string")
    sets = load(spark, d, "nation").select(F.lit("demo").alias("run_id"), F.col("n_nationkey").cast("long").alias("id"), F.lit("dataset").alias("kind"), none.alias("endpoint_url"), F.concat(F.lit("https://data.example/datasets/"), F.col("n_nationkey").cast("string")).alias("uri"))
    other = load(spark, d, "supplier").select(F.lit("demo").alias("run_id"), (F.col("s_suppkey") + 1000).alias("id"), F.lit("data_service").alias("kind"), F.concat(F.lit("https://data.example/datasets/"), F.col("s_nationkey").cast("string"), F.lit("/entities/"), F.col("s_suppkey").cast("string")).alias("endpoint_url"), none.alias("uri"))
    a = sets.unionByName(other).withColumns({"ordinal": F.lit(0), "seq": F.lit(0)})
    return capability.related_dataset(a).where("id >= 1000").select((F.col("id") - 1000).alias("s_suppkey"), "dataset")


# ---- views

_ALL = f"""lists AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem),
kinds AS (SELECT 'catalog' AS kind, count(*) AS n FROM region UNION ALL SELECT 'evidence_provider', count(*) FROM nation UNION ALL SELECT 'public_service', count(*) FROM customer UNION ALL SELECT 'channel', count(DISTINCT c_mktsegment) FROM customer
 UNION ALL SELECT 'requirement', count(*) FROM orders UNION ALL SELECT 'evidence_type_list', count(*) FROM lists UNION ALL SELECT 'evidence_type', count(*) FROM part UNION ALL SELECT 'evidence_offering', count(*) FROM supplier UNION ALL SELECT 'data_service', count(*) FROM supplier)"""


@query(f"WITH {_ALL} SELECT kind, n FROM kinds")
def registry_by_kind(spark, d):
    return demo.assets(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT {_B}region/' || r_regionkey AS id, r_name AS title, 'https://data.example/' AS source_url FROM region UNION ALL SELECT {_B}access/' || s_suppkey, s_name || ' API', 'https://data.example/' FROM supplier")
def registerable_assets(spark, d):
    artifacts = spark.createDataFrame([("demo", "artifact:demo", "https://data.example/", None, 0)], "run_id string, id string, url string, final_url string, ordinal int")
    return views.registry(views.registerable_assets(demo.assets(spark, d)), artifacts).select("id", "title", "source_url")


@query(f"SELECT {_B}access/' || s_suppkey AS id, {_B}api/' || s_suppkey AS endpoint_url FROM supplier")
def access_methods(spark, d):
    return views.access_methods(demo.assets(spark, d)).select("id", "endpoint_url")


def _hinted(spark, d):
    """Customers as assets, whose segments and keys give the hints."""
    k = F.col("c_custkey")
    hint = lambda label, p: F.struct(F.lit(label).alias("label"), F.lit(p).alias("predicate"), F.lit(None).cast("string").alias("path"))
    hints = F.array_compact(F.array(F.when(k % 2 == 0, hint("Rights", "dcterms:accessRights")), F.when(k % 3 == 0, hint("Issuer", "vc:issuer")), F.when(k % 5 == 0, hint("plain", "x:plain"))))
    conforms = F.when(k % 7 == 0, F.array(F.lit("https://www.w3.org/TR/dx-prof/"))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "customer").select(
        F.col("c_mktsegment").alias("run_id"), F.col("c_custkey").cast("string").alias("id"), F.when(k % 4 == 0, "dataset").when(k % 4 == 1, "distribution").otherwise("public_service").alias("kind"), F.when(k % 2 == 0, F.concat(F.lit("https://data.example/"), k)).alias("uri"),
        F.when(k % 6 != 0, F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("endpoint_url"), F.lit("a").alias("artifact_id"), hints.alias("source_hints"), conforms.alias("conforms_to"),
    )


@query("SELECT c_custkey::VARCHAR AS asset_id, 'dcterms:accessrights' AS term FROM customer WHERE c_custkey % 2 = 0")
def policy_signals(spark, d):
    return views.policy_signals(_hinted(spark, d)).select("asset_id", "term")


@query("SELECT c_custkey::VARCHAR AS asset_id, 'vc:issuer' AS term FROM customer WHERE c_custkey % 3 = 0")
def trust_signals(spark, d):
    return views.trust_signals(_hinted(spark, d)).select("asset_id", "term")


@query("""WITH c AS (SELECT c_mktsegment AS run_id, bool_or(c_custkey % 4 = 0) AS reg, bool_or(c_custkey % 4 IN (0, 1)) AS named, bool_and(CASE WHEN c_custkey % 4 IN (0, 1) THEN c_custkey % 6 <> 0 OR c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 END) AS lab,
  bool_or(c_custkey % 4 = 1) AS acc, bool_or(c_custkey % 7 = 0) AS prof, bool_or(c_custkey % 2 = 0) AS pol, bool_or(c_custkey % 3 = 0) AS tru FROM customer GROUP BY 1)
SELECT run_id, unnest(['HasMachineReadableEntry','HasRegisterableAsset','HasStableIdentity','HasHumanLabel','HasAccessMethod','HasSemanticConstraints','HasDeclaredProfile','HasPolicySignal','HasTrustSignal','HasNoBlockingFetchFailures']) AS condition,
 unnest([CASE WHEN run_id = 'BUILDING' THEN 'False' ELSE 'True' END, CASE WHEN reg THEN 'True' ELSE 'False' END, CASE WHEN named THEN 'True' ELSE 'False' END, CASE WHEN NOT named THEN 'False' WHEN lab THEN 'True' ELSE 'Warning' END, CASE WHEN acc THEN 'True' ELSE 'False' END,
 CASE WHEN run_id = 'BUILDING' THEN 'False' ELSE 'True' END, CASE WHEN prof THEN 'True' ELSE 'False' END, CASE WHEN pol THEN 'True' ELSE 'False' END, CASE WHEN tru THEN 'True' ELSE 'False' END, CASE run_id WHEN 'BUILDING' THEN 'False' WHEN 'MACHINERY' THEN 'Warning' ELSE 'True' END]) AS status FROM c""")
def conditions(spark, d):
    seg = load(spark, d, "customer").select(F.col("c_mktsegment").alias("run_id")).distinct()
    artifacts = seg.select("run_id", F.when(F.col("run_id") == "BUILDING", "html_landing_page").otherwise("json_schema").alias("kind"), F.lit("fetched").alias("status"))
    rejected = seg.where("run_id in ('BUILDING', 'MACHINERY')").select("run_id", F.when(F.col("run_id") == "MACHINERY", "a").alias("discovered_from"))
    return views.conditions(artifacts, _hinted(spark, d), seg.limit(0), rejected, seg).drop("ord")


@query("SELECT c_custkey::VARCHAR AS asset_id, 'dcterms:accessRights' AS term, 'Rights' AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'vc:issuer', 'Issuer' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'x:plain', 'plain' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'GET /' || c_custkey, c_name FROM customer WHERE c_custkey % 9 = 0")
def evidence_for_asset(spark, d):
    fields = ("value", "predicate", "pointer", "href", "rel", "header_name", "property_name", "path", "method", "collection_id", "summary", "title", "marker")
    value = {"path": F.concat(F.lit("/"), F.col("c_custkey").cast("string")), "method": F.lit("get"), "summary": F.col("c_name")}
    e = F.struct(F.lit("open_api_operation").alias("source"), *(value.get(n, F.lit(None).cast("string")).alias(n) for n in fields))
    findings = load(spark, d, "customer").where("c_custkey % 9 = 0").select(F.col("c_mktsegment").alias("run_id"), F.col("c_custkey").cast("string").alias("asset_id"), e.alias("evidence"))
    return views.evidence_for_assets(_hinted(spark, d), findings).drop("run_id")


# ---- workbench

@query(f"SELECT record_type, n FROM (SELECT 'catalog' AS record_type, count(*) AS n FROM region UNION ALL SELECT 'service', count(*) FROM supplier)")
def catalogue_records(spark, d):
    return workbench.records(demo.assets(spark, d)).groupBy("record_type").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS prefix FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*/[^/?#]+', 0) FROM pages WHERE page_id % 2 = 0)
SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM pages JOIN o ON url = prefix OR starts_with(url, prefix || '/') OR starts_with(url, prefix || '#') GROUP BY 1""")
def nearest_dataset(spark, d):
    pages = load(spark, d, "pages").select(F.col("page_id").alias("key"), "url")
    one = pages.select(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("prefix"))
    two = pages.where("key % 2 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/?#]*/[^/?#]+", 0).alias("prefix"))
    prefixes = one.union(two).distinct().withColumn("owner", F.col("prefix"))
    return workbench.nearest(pages, prefixes).select(F.col("key").alias("page_id"), "prefix")


_CHECKS = {"catalog": "catalog", "dataset": "dataset", "policy": "policy|rights", "license": "licen[sc]e", "contact": "contact|@", "api": "openapi|swagger", "profile": "profile|conformsto", "shape": "shacl|nodeshape", "vocabulary": "skos|concept", "status": "status", "issued": "issued|modified", "provenance": "provenance|wasderived", "trust": "did:|credential"}


@query("SELECT " + ", ".join(f"count_if(regexp_matches(t, '{p}')) AS {n}_n" for n, p in _CHECKS.items()) + " FROM (SELECT lower(text) AS t FROM documents UNION ALL SELECT lower(html) FROM pages)", **{f"{n}_n": "BIGINT" for n in _CHECKS})
def artifact_status(spark, d):
    texts = load(spark, d, "documents").select(F.col("text").alias("t")).union(load(spark, d, "pages").select("html"))
    return texts.agg(*(F.count_if(c).alias(f"{n}_n") for n, c in workbench.presence(F.col("t"), _CHECKS).items()))


def _readiness(spark, d):
    """Each supplier as a run, whose key decides what is found."""
    from ..functions.vocabulary import READINESS

    k = F.col("s_suppkey")
    state = lambda i: F.when(k % (i + 2) == 0, "missing").when(k % 11 == i, "invalid").otherwise("found")
    return load(spark, d, "supplier").select(F.col("s_name").alias("run_id"), *(state(i).alias(name) for i, (name, _, _) in enumerate(READINESS)))


_ITEMS = """items AS (SELECT s_name AS run_id, i.ord, i.item_id, i.item_group, i.item_rank, CASE WHEN s_suppkey % (i.ord + 2) = 0 THEN 'missing' WHEN s_suppkey % 11 = i.ord THEN 'invalid' ELSE 'found' END AS presence FROM supplier,
 (VALUES (0,'identity-catalog','Identity','blocking'),(1,'identity-dataset','Identity','blocking'),(2,'identity-title','Identity','blocking'),(3,'identity-publisher','Identity','blocking'),(4,'access-endpoint','Access','blocking'),(5,'access-openapi','Access','recommended'),
 (6,'policy-usage','Policy','recommended'),(7,'policy-access-rights','Policy','recommended'),(8,'policy-legal-basis','Policy','recommended'),(9,'trust-evidence','Trust','blocking'),(10,'lifecycle-status','Lifecycle','recommended'),(11,'lifecycle-contact','Lifecycle','recommended'),
 (12,'validation-profile','Validation','blocking'),(13,'validation-timestamp','Validation','recommended')) AS i(ord, item_id, item_group, item_rank))"""


@query(f"WITH {_ITEMS} SELECT run_id, item_id, presence FROM items")
def readiness_items(spark, d):
    return workbench.readiness_items(_readiness(spark, d)).select("run_id", "item_id", "presence")


@query(f"""WITH {_ITEMS}, g AS (SELECT run_id, CASE item_group WHEN 'Identity' THEN 'discoverable' WHEN 'Access' THEN 'discoverable' WHEN 'Validation' THEN 'validatable' ELSE lower(item_group) END AS category, count_if(presence = 'found') AS known, count(*) AS total,
  bool_or(presence <> 'found' AND item_rank = 'blocking') AS blocked, bool_or(presence = 'invalid') AS part FROM items GROUP BY 1, 2)
SELECT run_id, category, known, total, floor(100 * known / total + 0.5)::INT AS percent, CASE WHEN blocked THEN 'missing' WHEN known = total THEN 'ready' WHEN known > 0 OR part THEN 'partial' ELSE 'missing' END AS status FROM g""", known="BIGINT")
def readiness_categories(spark, d):
    return workbench.readiness_categories(workbench.readiness_items(_readiness(spark, d)))


@query(f"WITH {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE item_rank WHEN 'blocking' THEN 0 ELSE 1 END, ord) AS position FROM items WHERE presence <> 'found') SELECT run_id, item_id, position FROM n WHERE position <= 3", position="INTEGER")
def top_missing(spark, d):
    return workbench.top_missing(workbench.readiness_items(_readiness(spark, d))).select("run_id", "item_id", "position")


def _fields(spark, d):
    c = load(spark, d, "customer")
    return workbench.eav(c, F.col("c_custkey"), {"title": F.col("c_name"), "segment": F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), "nation": F.col("c_nationkey"), "x:own": F.when(F.col("c_custkey") % 2 == 0, "own")})


_EAV = """eav AS (SELECT c_custkey AS record_id, 'title' AS field_id, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'x:own', 'own' FROM customer WHERE c_custkey % 2 = 0)"""


@query(f"WITH {_EAV} SELECT * FROM eav")
def eav_fields(spark, d):
    return _fields(spark, d)


@query(f"WITH {_EAV} SELECT count_if(NOT contains(field_id, ':')) AS core_fields, count_if(contains(field_id, ':')) AS publisher_fields, count_if(contains(field_id, ':')) > 0 AS impact FROM eav", core_fields="BIGINT", publisher_fields="BIGINT")
def comparison_summary(spark, d):
    return workbench.comparison(_fields(spark, d), F.contains("field_id", F.lit(":")))


@query("""WITH n AS (SELECT c_custkey AS node_id, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), kept AS (SELECT node_id FROM n WHERE k <= 50) SELECT (SELECT count(*) FROM kept) AS nodes, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT node_id FROM kept) AND o_orderkey % 200 + 1 IN (SELECT node_id FROM kept)) AS edges""")
def graph_budget(spark, d):
    nodes = load(spark, d, "customer").select(F.lit("demo").alias("run_id"), F.col("c_custkey").alias("node_id"), F.lit("dataset").alias("node_type"), F.col("c_custkey").alias("seq"))
    edges = load(spark, d, "orders").select(F.lit("demo").alias("run_id"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 200 + 1).alias("target"))
    kept, inside = workbench.budgeted(nodes, edges, 50)
    return kept.agg(F.count("*").alias("nodes")).join(inside.agg(F.count("*").alias("edges")))


@query("SELECT DISTINCT n_regionkey::BIGINT AS scope_id, n_nationkey::BIGINT AS record_id FROM nation UNION SELECT s_nationkey::BIGINT + 100, s_suppkey + 1000 FROM supplier")
def scope_access_methods(spark, d):
    records = load(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("record_id"))
    linked = load(spark, d, "supplier").select((F.col("s_nationkey").cast("long") + 100).alias("scope_id"), (F.col("s_suppkey") + 1000).alias("record_id"))
    return workbench.scope(records, linked)


# ---- crawl

@query("""WITH RECURSIVE p AS (SELECT page_id, (SELECT count(*) FROM pages) AS n FROM pages), e AS (SELECT page_id AS s, (7 * page_id + 1) % n AS t FROM p UNION SELECT page_id, (3 * page_id + 2) % n FROM p),
w AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT e.t, w.level + 1 FROM w JOIN e ON e.s = w.node WHERE w.level < 4) SELECT node, min(level) AS level FROM w GROUP BY 1""")
def crawl_levels(spark, d):
    pages = load(spark, d, "pages").select("page_id")
    n = pages.count()
    edges = pages.select(F.col("page_id").alias("source"), F.explode(F.array((7 * F.col("page_id") + 1) % n, (3 * F.col("page_id") + 2) % n)).alias("target")).distinct()
    return crawl.levels(edges, spark.range(1).select(F.col("id").alias("node")), 4)


@query("""SELECT 'all' AS run_id, count(*) AS fetched_count, (SELECT count(*) FROM documents) AS rejected_count, sum(page_id % 3)::BIGINT AS redirect_count, sum(strlen(html))::BIGINT AS total_bytes FROM pages""")
def fetch_summary(spark, d):
    hops = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("page_id") % 3).cast("int"))
    fetched = load(spark, d, "pages").select(F.lit("all").alias("run_id"), F.col("html").cast("binary").alias("body"), hops.alias("redirect_chain"))
    return crawl.fetch_summary(fetched, load(spark, d, "documents").select(F.lit("all").alias("run_id")))


# ---- extractors: documents written from the tables, read back by the report plan

def _fetched(frame, run, ordinal, url, media_type, body):
    none = F.lit(None).cast("string")
    return demo.spread(frame).select(
        run.alias("run_id"), ordinal.cast("int").alias("ordinal"), url.alias("url"), none.alias("final_url"), F.lit(200).alias("status"), F.lit(media_type).alias("media_type"), F.array().cast("array<struct<name:string,value:string>>").alias("headers"),
        body.cast("binary").alias("body"), none.alias("discovered_from"),
    )


def _suppliers(spark, d):
    """One JSON-LD dataset with a distribution for each supplier; a run for each nation."""
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dist = F.struct(F.concat(demo.uri("supplier", "s_suppkey"), F.lit("/file")).alias("@id"), F.lit("dcat:Distribution").alias("@type"), F.concat(demo.uri("supplier", "s_suppkey"), F.lit(".csv")).alias("dcat:accessURL"))
    node = F.struct(demo.uri("supplier", "s_suppkey").alias("@id"), F.lit("dcat:Dataset").alias("@type"), F.col("s_name").alias("dcterms:title"), F.struct(demo.uri("nation", "s_nationkey").alias("@id")).alias("dcterms:publisher"), F.when(k % 2 == 1, "https://www.w3.org/TR/shacl/").alias("dcterms:conformsTo"), dist.alias("dcat:distribution"))
    return _fetched(s, F.col("n_name"), k, F.concat(F.lit("https://data.example/docs/"), k.cast("string"), F.lit(".jsonld")), "application/ld+json", F.to_json(node))


@query("""SELECT n_name AS run_id, count(*) AS artifact_count, 2 * count(*) AS asset_count, count_if(s_suppkey % 2 = 1) AS standard_count, 0::BIGINT AS profile_count, 0::BIGINT AS parse_error_count, 0::BIGINT AS next_fetch_count,
  2 * count(*) + count_if(s_suppkey % 2 = 1) AS relations, 2 * count(*) + count_if(s_suppkey % 2 = 1) AS links, count(*) AS signals FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""", standard_count="BIGINT", relations="BIGINT", links="BIGINT")
def catalogue_report(spark, d):
    from .report import analyze

    r = analyze(_suppliers(spark, d))
    count = lambda t, name: t.groupBy("run_id").agg(F.count("*").alias(name))
    out = r.run.select("run_id", "artifact_count", "asset_count", "standard_count", "profile_count", "parse_error_count", "next_fetch_count")
    return out.join(count(r.relations, "relations"), "run_id").join(count(r.links, "links"), "run_id").join(count(r.findings.where("code = 'semantic.standard_signal'"), "signals"), "run_id")


@query(f"""SELECT s_suppkey::INT AS ordinal, {_B}supplier/' || s_suppkey AS subject, 'dcat:distribution' AS predicate, {_B}supplier/' || s_suppkey || '/file' AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT s_suppkey::INT, {_B}supplier/' || s_suppkey || '/file', 'dcat:accessURL', {_B}supplier/' || s_suppkey || '.csv' FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT s_suppkey::INT, {_B}supplier/' || s_suppkey, 'dcterms:conformsTo', 'https://www.w3.org/TR/shacl/' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1""")
def json_ld_relations(spark, d):
    from .report import analyze

    return analyze(_suppliers(spark, d)).relations.select("ordinal", F.col("subject.uri").alias("subject"), "predicate", F.col("object.uri").alias("object"))


def _facts(fetched, fact):
    from . import report

    found = report.classified(fetched).select("run_id", "ordinal", "artifact_id", "url", "at", "kind", "status", "text")
    return report._of(report.facts(stored(found, "found")), fact)  # several passes read it


@query("""SELECT p_partkey::INT AS ordinal, unnest(['/properties/brand', '/properties/brand/properties/na~1me', '/allOf/0/properties/size']) AS pointer, unnest(['brand', 'brand.na/me', 'size']) AS path, unnest(['{"properties": {"na/me": {"type": "string"}}}', '{"type": "string"}', '{"type": "integer"}']) AS value FROM part""")
def schema_property_paths(spark, d):
    body = F.concat(F.lit('{"title": "'), F.col("p_name"), F.lit('", "properties": {"brand": {"properties": {"na/me": {"type": "string"}}}}, "allOf": [{"properties": {"size": {"type": "integer"}}}]}'))
    found = _facts(_fetched(load(spark, d, "part"), F.lit("r"), F.col("p_partkey"), demo.uri("schemas", "p_partkey"), "application/schema+json", body), "finding")
    return found.select("ordinal", F.col("evidence.schema_pointer").alias("pointer"), F.col("evidence.property_path").alias("path"), F.col("evidence.value").alias("value"))


@query("""SELECT s_suppkey::INT AS ordinal, 'get' AS method, '/' || s_suppkey AS path, s_name AS summary FROM supplier UNION ALL SELECT s_suppkey::INT, 'post', '/all', NULL FROM supplier WHERE s_suppkey % 2 = 0""")
def openapi_operations(spark, d):
    k = F.col("s_suppkey").cast("string")
    more = F.when(F.col("s_suppkey") % 2 == 0, ', "/all": {"post": {}, "x-note": {}}').otherwise("")
    body = F.concat(F.lit('{"openapi": "3.1.0", "paths": {"/'), k, F.lit('": {"get": {"summary": "'), "s_name", F.lit('"}}'), more, F.lit("}}"))
    found = _facts(_fetched(load(spark, d, "supplier"), F.lit("r"), F.col("s_suppkey"), demo.uri("apis", "s_suppkey"), "application/json", body), "finding")
    return found.select("ordinal", "evidence.method", "evidence.path", "evidence.summary")


@query("""SELECT n_nationkey AS ordinal, 'ogc_features' AS kind, n_name AS collection FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'ogc_records', n_name FROM nation WHERE n_nationkey % 2 = 1""")
def ogc_collections(spark, d):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "features").otherwise("records")
    body = F.concat(F.lit('{"conformsTo": ["http://www.opengis.net/spec/ogcapi-'), kind, F.lit('-1/1.0/conf/core"], "links": [], "collections": [{"id": "'), "n_name", F.lit('"}, {}]}'))
    fetched = _fetched(load(spark, d, "nation"), F.lit("r"), F.col("n_nationkey"), demo.uri("ogc", "n_nationkey"), "application/json", body)
    kinds = _facts(fetched, "kind").select("ordinal", "kind")
    return kinds.join(_facts(fetched, "finding").select("ordinal", F.col("evidence.collection_id").alias("collection")), "ordinal")


@query("""SELECT r_regionkey AS ordinal, 'catalog' AS kind, r_name AS title, 'https://data.example/r' || r_regionkey AS uri FROM region UNION ALL SELECT n_regionkey, 'dataset', n_name, 'https://data.example/r' || n_regionkey || '/datasets/' || n_nationkey FROM nation""")
def metadata_indexes(spark, d):
    sets = load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"))).alias("datasets"))
    r = load(spark, d, "region").join(sets, F.col("r_regionkey") == F.col("n_regionkey"))
    base = F.concat(F.lit("https://data.example/r"), F.col("r_regionkey").cast("string"))
    body = F.to_json(F.struct(base.alias("id"), F.col("r_name").alias("title"), F.concat(base, F.lit("/")).alias("base_url"), "datasets"))
    return _facts(_fetched(r, F.lit("r"), F.col("r_regionkey"), base, "application/json", body), "asset").select("ordinal", "kind", "title", "uri")


@query("""SELECT p_partkey::INT AS ordinal, 'catalog' AS kind, p_name AS title, 'https://data.example/p' || p_partkey AS uri, p_brand AS publisher, CASE WHEN p_partkey % 3 = 0 THEN 'urn:rules, https://data.example/rules' END AS conforms FROM part
 UNION ALL SELECT p_partkey::INT, 'dataset', NULL, 'https://data.example/p' || p_partkey || '/datasets/' || p_size, p_brand, NULL FROM part
 UNION ALL SELECT p_partkey::INT, 'dataset', p_type, 'urn:part:' || p_partkey, p_name, 'urn:rules' FROM part""")
def index_datasets(spark, d):
    """An index for each part, whose datasets are named below its base or by themselves, and whose texts are strings, objects or lists."""
    p, k = load(spark, d, "part"), F.col("p_partkey")
    base = F.concat(F.lit("https://data.example/p"), k.cast("string"))
    conforms = F.when(k % 3 == 0, ', "conforms_to": ["urn:rules", [{"@id": "https://data.example/rules"}]]').otherwise("")
    text = lambda c: F.to_json(F.array(F.struct(F.struct(F.col(c).alias("@value")).alias("name"))))
    body = F.concat(F.lit('{"title": '), text("p_name"), F.lit(', "publisher": '), text("p_brand"), conforms, F.lit(', "base_url": "'), base, F.lit('///", "datasets": [{"dataset_id": "'), F.col("p_size").cast("string"), F.lit('"}, 7, {"conformsTo": "urn:rules", "publisher": '), text("p_name"), F.lit(', "url": "urn:part:'), k.cast("string"), F.lit('", "name": '), text("p_type"), F.lit("}]}"))
    found = _facts(_fetched(p, F.lit("r"), k, base, "application/json", body), "asset")
    return found.select("ordinal", "kind", "title", "uri", "publisher", F.when(F.size("conforms") > 0, F.array_join("conforms", ", ")).alias("conforms"))


@query("""SELECT c_custkey::INT AS ordinal, '/links/' || i || '/href' AS pointer, 'https://data.example/c' || c_custkey || '/' || i AS href, CASE WHEN i = 0 THEN c_mktsegment END AS rel, CASE WHEN i = 2 THEN 'text/html' END AS role FROM customer, (SELECT unnest([0, 2]) AS i)""")
def ogc_links(spark, d):
    """The links of a landing page for each customer; entries without a target are none."""
    c, k = load(spark, d, "customer"), F.col("c_custkey").cast("string")
    at = F.concat(F.lit("https://data.example/c"), k)
    body = F.concat(F.lit('{"conformsTo": ["http://www.opengis.net/spec/ogcapi-common-1/1.0/conf/core"], "links": [{"rel": "'), "c_mktsegment", F.lit('", "href": "'), at, F.lit('/0"}, {"rel": "none"}, {"type": "text/html", "href": {"@id": "'), at, F.lit('/2"}}]}'))
    found = _facts(_fetched(c, F.lit("r"), F.col("c_custkey"), at, "application/json", body), "link")
    return found.select("ordinal", "evidence.pointer", "href", "rel", "role")


@query("""SELECT n_nationkey AS ordinal, 'shape_graph' AS kind, 'https://data.example/t#S' || n_nationkey AS uri, n_name AS title FROM nation UNION ALL SELECT n_nationkey, 'concept_scheme', 'https://data.example/t#C' || n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, 'alignment', 'https://data.example/t#C' || n_nationkey, n_name FROM nation""")
def turtle_assets(spark, d):
    k = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit('@prefix t: <https://data.example/t#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\nt:S'), k, F.lit(' a sh:NodeShape ; rdfs:label "'), "n_name", F.lit('"@en ; sh:property [ sh:path t:x ] .\nt:C'), k, F.lit(' a skos:ConceptScheme ; skos:prefLabel "'), "n_name", F.lit('" ; skos:exactMatch t:other , t:more .'))
    return _facts(_fetched(load(spark, d, "nation"), F.lit("r"), F.col("n_nationkey"), demo.uri("t", "n_nationkey"), "text/turtle", body), "asset").select("ordinal", "kind", "uri", "title")


@query("""SELECT r_regionkey AS ordinal, unnest(['semantic_model_package', 'class', 'property', 'vocabulary']) AS kind, unnest([r_name, 'Place', 'name', 'Kind']) AS title FROM region UNION ALL SELECT r_regionkey + 100, unnest(['semantic_model_package', 'crosswalk']), unnest([r_name, r_name || ' crosswalk']) FROM region""")
def package_assets(spark, d):
    r = load(spark, d, "region")
    yaml = F.concat(F.lit("id: https://data.example/m\nname: "), "r_name", F.lit("\nclasses:\n  Place:\n    description: x\nslots:\n  name: {}\nenums:\n  Kind: {}\n"))
    toml = F.concat(F.lit('[package]\nname = "'), "r_name", F.lit('"\nversion = "1"\n[[artifacts]]\nrole = "crosswalk"\npath = "c.ttl"\n'))
    two = _fetched(r, F.lit("r"), F.col("r_regionkey"), F.concat(demo.uri("m", "r_regionkey"), F.lit(".linkml.yaml")), "application/yaml", yaml).unionByName(_fetched(r, F.lit("r"), F.col("r_regionkey") + 100, demo.uri("p", "r_regionkey"), "application/toml", toml))
    return _facts(two, "asset").select("ordinal", "kind", "title")


@query("""SELECT n_name AS run_id, count(*) AS known, CASE WHEN count(*) > 0 THEN 'missing' END AS status FROM (SELECT DISTINCT n_name, unnest(['identity-dataset', 'identity-title', 'identity-publisher']) AS item FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""")
def board_readiness(spark, d):
    """The workbench model end to end: no catalogue and no endpoint, so three of six items are known."""
    from .board import board
    from .report import analyze

    return board(analyze(_suppliers(spark, d))).readiness.where("category = 'discoverable'").select("run_id", "known", "status")


@query("""SELECT s_suppkey::INT AS ordinal, 'dataset' AS record_type, NULL AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey::INT, 'distribution', 'https://data.example/supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def board_parents(spark, d):
    """A distribution belongs to the dataset whose URI is the longest prefix of its own."""
    from .report import analyze

    r = analyze(_suppliers(spark, d))
    uris = r.assets.select("run_id", F.col("id").alias("parent_id"), F.col("uri").alias("parent"))
    own = workbench.with_parents(r.assets).join(r.assets.select("run_id", F.col("id").alias("record_id"), "ordinal"), ["run_id", "record_id"])
    return own.join(uris, ["run_id", "parent_id"], "left").select("ordinal", "record_type", "parent")


@query(f"""SELECT n_name AS source_id, {_B}supplier/' || s_suppkey AS uri, 1 AS metadata, 'metadata_only' AS access_kind, 'low' AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_name IN ('Supplier#000000003', 'Supplier#000000008')
 UNION ALL SELECT n_name, {_B}supplier/' || s_suppkey || '/file', 1, 'dataset_distribution', 'low' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 5""")
def report_search(spark, d):
    """Two datasets by their titles and one distribution by its endpoint, searched over analyzed documents."""
    from .report import analyze
    from .search import search

    report = analyze(_suppliers(spark, d))
    need = InformationNeed("n").requires_any(Term.label("supplier#000000003"), Term.label(" SUPPLIER#000000008"), Term.iri("https://data.example/supplier/5.csv"))
    found = search(report, CapabilityQuery("q").need(need).terms(spark))
    uris = report.assets.select(F.col("run_id").alias("source_id"), F.col("id").alias("asset_id"), "uri")
    return found.join(uris, ["source_id", "asset_id"]).select("source_id", "uri", "metadata", "access_kind", "confidence")
