"""More of the query catalogue: scalar functions over the driver's tables, and the workbench's search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers as header_fns
from ..functions import ids, iris, labels, urls
from ..operators import capability, classify, seeds, workbench
from . import board
from .catalogue import query
from .demo import load
from .report import redacted

_U = "'https://data.example/'"


# ---- scalar functions

@query("""SELECT p_partkey, trim('  ' || p_name || ' ') AS field, replace(lower(p_brand), '#', ' ') AS from_iri, p_name AS first, 'Feature Collection API' AS kind, p_partkey % 3 = 0 AS review, 'parts/' || p_partkey AS short, 'https,http' AS schemes,
  CASE WHEN p_size > 25 THEN 'large' ELSE 'unknown' END AS known FROM part""")
def label_functions(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("School "), "p_name")).otherwise(F.lit("plain"))
    return load(spark, d, "part").select(
        "p_partkey", labels.canonical_field(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("field"), labels.label_from_iri(F.concat(F.lit("https://data.example/x#"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("Shape"))).alias("from_iri"),
        labels.first_text(F.lit(" "), F.concat(F.lit(" "), "p_name")).alias("first"), labels.kind_label(F.lit("feature_collection_api")).alias("kind"), labels.needs_review(text).alias("review"),
        labels.short_id(F.concat(F.lit("https://data.example/parts/"), k.cast("string"))).alias("short"), F.array_join(labels.schemes(F.array(F.lit(" HTTPS"), F.lit(""), F.lit("http"), F.lit("https"))), ",").alias("schemes"),
        labels.known_or_unknown(F.when(F.col("p_size") > 25, "large").otherwise("small"), ("large", "huge")).alias("known"),
    )


_DCT, _CV = "http://purl.org/dc/terms/", "http://data.europa.eu/m8g/"


@query(f"""SELECT n_nationkey, '{_DCT}' || n_name AS expanded, CAST(NULL AS VARCHAR) AS none, 'x:' || n_name AS unknown, 'dcterms:' || n_name AS compacted, 'dcterms:' || n_name AS renamed, CASE WHEN n_nationkey % 2 = 0 THEN 'cv:holdsRequirement' ELSE 'cccev:hasEvidenceTypeList' END AS shared,
  '{_DCT}' || n_name AS canonical, 'https://data.example/own/' || n_name AS own, n_nationkey % 4 <> 3 AS same FROM nation""")
def iri_functions(spark, d):
    k, n = F.col("n_nationkey"), F.col("n_name")
    of = lambda p: F.concat(F.lit(p), n)
    shared = F.when(k % 2 == 0, "holdsRequirement").otherwise("hasEvidenceTypeList")
    predicate = F.when(k % 4 == 0, "dcterms:title").when(k % 4 == 1, f"{_DCT}title").when(k % 4 == 2, "https://data.example/terms#title").otherwise("https://data.example/subtitle")
    return load(spark, d, "nation").select(
        "n_nationkey", iris.expand(of("dct:")).alias("expanded"), iris.expand(of("https://data.example/")).alias("none"), iris.expanded(of("x:")).alias("unknown"), iris.compact(of(_DCT)).alias("compacted"), iris.compact(of("dct:")).alias("renamed"),
        iris.compact(F.concat(F.lit(_CV), shared)).alias("shared"), iris.canonical(of(" dcterms:")).alias("canonical"), iris.canonical(of("own:"), {"own": "https://data.example/own/"}).alias("own"), iris.matches(predicate, "dcterms:title").alias("same"),
    )


@query(f"""SELECT s_suppkey, {_U} || s_suppkey || '?mykey=REDACTED&page=1' AS core, {_U} || s_suppkey || '?mykey=k&page=1' AS facade, {_U} || s_suppkey || '?mykey=REDACTED&page=1' AS workbench, 'https://redacted:redacted@data.example/' || s_suppkey || '?mykey=k&page=1' AS proxy,
  s_suppkey % 2 = 0 AS same, s_suppkey % 3 <> 0 AS private, CASE s_suppkey % 2 WHEN 0 THEN 'http' ELSE 'urn' END AS hint, s_suppkey % 2 = 0 AS has_role, s_suppkey % 2 = 0 AS document FROM supplier""")
def url_functions(spark, d):
    k = F.col("s_suppkey")
    key = k.cast("string")
    url = F.concat(F.lit("https://u:p@data.example/"), key, F.lit("?mykey=k&page=1"))
    other = F.concat(F.when(k % 2 == 0, "HTTPS://DATA.example:443/").otherwise("https://data.example:8443/"), key)
    address = F.when(k % 3 == 0, F.concat(F.lit("93.184.216."), (k % 200).cast("string"))).when(k % 3 == 1, F.concat(F.lit("10.0.0."), (k % 200).cast("string"))).otherwise("::ffff:192.168.0.1")
    either = F.when(k % 2 == 0, F.concat(F.lit("https://data.example/"), key)).otherwise(F.concat(F.lit("urn:x:"), key))
    return load(spark, d, "supplier").select(
        "s_suppkey", *(urls.redact(url, p).alias(p) for p in ("core", "facade", "workbench", "proxy")), urls.same_origin(F.lit("https://data.example/x"), other).alias("same"), urls.is_private_ip(address).alias("private"),
        urls.protocol_hint(either).alias("hint"), urls.predicate_role(F.when(k % 2 == 0, "dcat:dataset").otherwise("x:none")).isNotNull().alias("has_role"), urls.is_document_like(either).alias("document"),
    )


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i:i])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(f"SELECT n_nationkey, 'sha256:' || sha256(n_name) AS body_hash, lower(lpad(hex({_FNV}::UBIGINT), 16, '0')) AS fnv FROM nation")
def body_hashes(spark, d):
    return load(spark, d, "nation").select("n_nationkey", ids.body_hash(F.col("n_name").cast("binary")).alias("body_hash"), ids.fnv1a64(F.col("n_name")).alias("fnv"))


@query("SELECT n_nationkey, 'Link=x;ETag=' || n_name AS kept FROM nation")
def sensitive_headers(spark, d):
    entry = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    hs = F.array(entry("Authorization", F.col("n_name")), entry("Link", F.lit("x")), entry("set-cookie", F.col("n_name")), entry("ETag", F.col("n_name")))
    return load(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(header_fns.strip_sensitive(hs), lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("kept"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'ogc-record-collection' WHEN 1 THEN 'ogc-feature-collection' ELSE 'service' END AS service, CASE n_nationkey % 2 WHEN 0 THEN 'ogc-feature-collection' ELSE 'distribution' END AS distribution,
 n_nationkey % 2 = 1 AS registry, CASE n_nationkey % 2 WHEN 1 THEN 'breg-dcat-ap' ELSE 'dcat-ap-3' END AS profile, CASE n_nationkey % 3 WHEN 0 THEN 'application/ld+json' WHEN 1 THEN 'text/turtle' ELSE 'text/html' END AS media_type FROM nation""")
def classify_labels(spark, d):
    k = F.col("n_nationkey")
    conforms = F.when(k % 3 == 0, "https://www.opengis.net/spec/OGCAPI-Records-1/1.0").when(k % 3 == 1, "https://www.opengis.net/spec/ogcapi-features-1/1.0").otherwise("x")
    registry = F.when(k % 2 == 1, "https://data.example/Base-Registry/").otherwise("https://data.example/dcat-ap/3.0.0")
    name = F.concat("n_name", F.when(k % 3 == 0, ".jsonld").when(k % 3 == 1, ".ttl").otherwise(".html"))
    return load(spark, d, "nation").select(
        "n_nationkey", classify.service_type(conforms).alias("service"), classify.distribution_type(F.when(k % 2 == 0, "application/geo+json").otherwise("text/csv")).alias("distribution"), classify.is_base_registry(registry).alias("registry"),
        classify.inferred_profile(F.array(registry)).alias("profile"), classify.media_type_for_path(name).alias("media_type"),
    )


# ---- the workbench's search

def _seed_assets(spark, d):
    """Suppliers by fours: a catalogue and a dataset of one artifact, a service and a distribution of the next; the distribution has the service's name."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "catalog").when(k % 4 == 1, "dataset").when(k % 4 == 2, "data_service").otherwise("distribution")
    url = lambda kind_: F.concat(F.lit(f"https://data.example/{kind_}/"), k.cast("string"))
    base = F.lpad(F.when(k % 4 == 3, k - 1).otherwise(k).cast("string"), 9, "0")
    title = F.concat(F.lit("Supplier#"), base, F.when(k % 4 == 3, " distribution").when(k % 4 == 2, " API").otherwise(""))
    return load(spark, d, "supplier").select(
        F.lit("demo").alias("run_id"), F.concat(F.lit("asset:"), k.cast("string")).alias("id"), kind.alias("kind"), url("uri").alias("uri"), title.alias("title"), F.when(k % 8 == 2, "N").alias("publisher"), F.when(k % 8 == 2, url("api")).alias("endpoint_url"),
        F.concat(F.lit("artifact:"), F.floor(k / 2).cast("string")).alias("artifact_id"), k.alias("ordinal"), F.lit(0).alias("seq"),
    )


def _seed_properties(spark, d):
    """Parts as properties: of an artifact of two suppliers, with a brand's shape."""
    p, n = F.col("p_partkey"), load(spark, d, "supplier").count()
    shape = F.concat(F.lit("https://data.example/shapes#"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("Shape"))
    return load(spark, d, "part").select(
        F.lit("demo").alias("run_id"), F.concat(F.lit("finding:"), p.cast("string")).alias("id"), F.concat(F.lit("artifact:"), F.floor((p % n) / 2).cast("string")).alias("artifact_id"),
        F.array(F.concat(F.lit("/properties/p_"), p.cast("string")), F.concat(F.lit("x:size_"), F.col("p_size").cast("string"))).alias("fields"), labels.label_from_iri(shape).alias("label"), F.concat(F.lit("/properties/p_"), p.cast("string")).alias("location"),
        F.when(p % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((p % n).cast("string"), 9, "0"))).alias("asset_label"), p.alias("ordinal"), F.lit(0).alias("seq"),
    )


_SEED = """n AS (SELECT count(*) AS n FROM supplier),
a AS (SELECT s_suppkey AS k, 'asset:' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'catalog' WHEN 1 THEN 'dataset' WHEN 2 THEN 'data_service' ELSE 'distribution' END AS kind, 'https://data.example/uri/' || s_suppkey AS uri,
  'Supplier#' || lpad((CASE WHEN s_suppkey % 4 = 3 THEN s_suppkey - 1 ELSE s_suppkey END)::VARCHAR, 9, '0') || CASE s_suppkey % 4 WHEN 3 THEN ' distribution' WHEN 2 THEN ' API' ELSE '' END AS title,
  CASE WHEN s_suppkey % 8 = 2 THEN 'https://data.example/api/' || s_suppkey END AS endpoint, s_suppkey // 2 AS art FROM supplier),
p AS (SELECT p_partkey AS p, 'finding:' || p_partkey AS id, (p_partkey % n) // 2 AS art, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'Supplier#' || lpad((p_partkey % n)::VARCHAR, 9, '0') END AS asset_label, '/properties/p_' || p_partkey AS location FROM part, n),
f AS (SELECT art, min(k) AS k FROM a GROUP BY 1),
pa AS (SELECT p.*, CASE WHEN d.kind IS NOT NULL AND d.kind <> 'catalog' THEN d.id ELSE coalesce(l.id, d.id) END AS asset_id FROM p LEFT JOIN f ON p.art = f.art LEFT JOIN a d ON d.k = f.k LEFT JOIN a l ON l.title = p.asset_label),
acc AS (SELECT a.id, CASE WHEN a.kind = 'distribution' AND a.k % 5 = 0 THEN 'rejected_or_gated' WHEN a.endpoint IS NOT NULL THEN 'api_description_available' WHEN a.kind = 'distribution' THEN 'dataset_distribution'
   WHEN a.kind = 'data_service' AND d.id IS NOT NULL THEN CASE WHEN d.k % 5 = 0 THEN 'rejected_or_gated' ELSE 'dataset_distribution' END ELSE 'metadata_only' END AS access_kind,
   CASE WHEN a.endpoint IS NOT NULL THEN a.endpoint WHEN a.kind = 'distribution' THEN a.uri WHEN a.kind = 'data_service' THEN d.uri END AS source_url FROM a LEFT JOIN a d ON a.kind = 'data_service' AND d.k = a.k + 1)"""


def _rejected(spark, d):
    return _seed_assets(spark, d).where("kind = 'distribution' and ordinal % 5 = 0").select("run_id", F.col("uri").alias("url"))


@query(f"WITH {_SEED} SELECT id, asset_id FROM pa")
def property_assets(spark, d):
    return seeds.property_assets(_seed_assets(spark, d), _seed_properties(spark, d)).select("id", "asset_id")


@query(f"WITH {_SEED} SELECT id, uri AS rejected_url FROM a WHERE kind = 'distribution' AND k % 5 = 0")
def rejected_access(spark, d):
    return capability.rejected_access(_seed_assets(spark, d), _rejected(spark, d)).select("id", "rejected_url")


@query(f"WITH {_SEED} SELECT id, access_kind, source_url FROM acc")
def seed_access(spark, d):
    return seeds.access(_seed_assets(spark, d), _rejected(spark, d)).select("id", "access_kind", "source_url")


@query(f"""WITH {_SEED},
r AS (SELECT 'service' AS need_id, 'service:' || a.id AS route_id, a.title AS label, acc.source_url, acc.access_kind, CASE acc.access_kind WHEN 'metadata_only' THEN 'medium' ELSE 'high' END AS confidence, a.k AS ordinal FROM a JOIN acc ON a.id = acc.id WHERE lower(a.title) IN ('supplier#000000002 api', 'supplier#000000004')
  UNION ALL SELECT 'school size', 'school size:' || pa.id, coalesce(a.title, pa.location), coalesce(acc.source_url, a.uri, a.endpoint), coalesce(acc.access_kind, 'metadata_only'), CASE WHEN a.id IS NULL THEN 'low' ELSE 'medium' END, pa.p FROM pa LEFT JOIN a ON a.id = pa.asset_id LEFT JOIN acc ON acc.id = a.id WHERE pa.location = '/properties/p_7' OR pa.location = '/properties/p_12'),
c AS (SELECT *, max(CASE WHEN access_kind = 'metadata_only' THEN 0 ELSE 1 END) OVER (PARTITION BY need_id) AS reach FROM r)
SELECT need_id, route_id, label, source_url, access_kind, confidence, CASE WHEN need_id LIKE 'school%' THEN 2 ELSE 0 END AS flags FROM c WHERE reach = 0 OR access_kind <> 'metadata_only'""", flags="INTEGER")
def seed_routes(spark, d):
    needs = spark.createDataFrame([("service", "A service"), ("school size", "Size"), ("nothing", "None")], "need_id string, label string")
    rows = [("service", "any", 0, "label", "supplier#000000002  API"), ("service", "any", 1, "label", "Supplier#000000004"), ("school size", "any", 0, "field", "P_7"), ("school size", "any", 1, "field", "p-12"), ("nothing", "any", 0, "label", "Supplier#000000004"), ("nothing", "all", 1, "iri", "urn:none")]
    terms = spark.createDataFrame(rows, "need_id string, role string, ord int, kind string, value string")
    found = seeds.search(_seed_assets(spark, d), _seed_properties(spark, d), needs, terms, _rejected(spark, d))
    return found.select("need_id", "route_id", "label", "source_url", "access_kind", "confidence", F.size("review_flags").alias("flags"))


@query("""SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS report_ids, string_agg('src' || n_nationkey, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 2 = 0) AS envelope_ids, string_agg('set@' || n_regionkey, ',' ORDER BY n_nationkey) AS reviewed_mapping_sets,
  string_agg('r' || n_nationkey, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 0) AS review_assertions FROM nation""")
def inputs_summary(spark, d):
    n = load(spark, d, "nation")
    source = F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source_id")
    sources = n.select(source, F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("run_id"), (F.col("n_nationkey") % 2 == 0).alias("is_envelope"))
    sets = n.select(source, F.lit("set").alias("set_id"), F.col("n_regionkey").cast("string").alias("version"), F.lit(0).alias("set_ord"))
    reviews = n.where("n_nationkey % 3 = 0").select(source, F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(0).alias("seq"))
    found = capability.inputs_summary(sources, sets, reviews)
    return found.select(*(F.array_join(c, ",").alias(c) for c in found.columns))


@query("""SELECT c_custkey AS run_id, 'Policy' AS "group", 'access,' || CASE WHEN c_acctbal < 0 THEN 'legal' ELSE 'usage' END AS items, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS open FROM customer UNION ALL SELECT c_custkey, 'Trust', 'evidence', 0 FROM customer""", open="INTEGER")
def missing_by_group(spark, d):
    item = lambda group, name, status: F.struct(F.lit(group).alias("group"), name.alias("item"), status.alias("status"))
    poor, unknown = F.col("c_acctbal") < 0, F.lit("unknown")
    items = F.array(item("Policy", F.when(poor, "legal").otherwise("usage"), unknown), item("Policy", F.lit("access"), F.when(poor, unknown).otherwise("known")), item("Trust", F.lit("evidence"), F.lit("known")))
    found = workbench.grouped_items(load(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.inline(items)))
    return found.select("run_id", "group", F.array_join(F.transform("items", lambda x: x["item"]), ",").alias("items"), F.size(F.filter("items", lambda x: x["status"] != "known")).alias("open"))


@query("SELECT n_nationkey, n_nationkey % 4 IN (1, 2) AS specific FROM nation")
def publisher_keys(spark, d):
    k, n = F.col("n_nationkey"), F.col("n_name")
    key = F.when(k % 4 == 0, F.concat(F.lit("dcterms:"), n)).when(k % 4 == 1, F.concat(F.lit("own:"), n)).when(k % 4 == 2, F.concat(F.lit("x-"), n)).otherwise(F.concat(F.lit("@"), n))
    return load(spark, d, "nation").select("n_nationkey", workbench.is_publisher_specific(key).alias("specific"))


@query("""SELECT s_nationkey AS run_id, count_if(s_suppkey % 4 IN (0, 1)) AS assets, count_if(s_suppkey % 4 IN (2, 3)) AS access_methods, sum(s_suppkey % 3)::BIGINT AS publisher_fields, count_if(s_suppkey % 2 = 0 AND s_acctbal < 0) AS blocking FROM supplier GROUP BY 1""", assets="BIGINT", access_methods="BIGINT", blocking="BIGINT")
def overview_counts(spark, d):
    k, run = F.col("s_suppkey"), F.col("s_nationkey").alias("run_id")
    s = load(spark, d, "supplier")
    kind = F.when(k % 4 == 0, "catalog").when(k % 4 == 1, "dataset").when(k % 4 == 2, "service").otherwise("distribution")
    items = s.select(run, F.when(k % 2 == 0, "blocking").otherwise("recommended").alias("rank"), F.when(F.col("s_acctbal") < 0, "unknown").otherwise("known").alias("status"))
    return workbench.overview(s.select(run, kind.alias("type"), (k % 3).alias("publisher_fields")), items)


# ---- the workbench's checks

_CHECKED = {"dcat": "n_nationkey % 4 = 0", "records": "n_nationkey % 5 = 0", "shacl": "n_nationkey % 2 = 0", "odrl": "n_nationkey % 2 = 1", "rights": "n_nationkey % 3 = 0"}


def _checks_sql() -> str:
    order = ("dcat", "breg", "records", "openapi", "features", "shacl", "odrl", "rights", "dqv", "adms", "dpv", "trust", "own")
    cases = " UNION ALL ".join(f"SELECT n_name AS run_id, {k} AS ord, '{i}' AS check_id, CASE WHEN {_CHECKED.get(name, 'false')} THEN 'found' ELSE 'missing' END AS presence FROM nation" for k, (name, (i, _)) in enumerate(zip(order, board.CHECKS, strict=True)))
    return f"SELECT run_id, ord::INT AS ord, check_id, presence FROM ({cases})"


@query(_checks_sql())
def artifact_checks(spark, d):
    k, run = F.col("n_nationkey"), F.col("n_name").alias("run_id")
    n = load(spark, d, "nation")
    said = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    kinds = said("@type", F.when(k % 2 == 0, "sh:NodeShape").otherwise("odrl:Offer"))
    more = F.array(kinds, F.when(k % 3 == 0, said("dcterms:license", F.lit("urn:l"))), F.when(k % 5 == 0, said("dcterms:conformsTo", F.lit("https://data.example/OGCAPI-Records/"))), said("x:other", F.lit("ogcapi-features")))
    artifacts = n.select(run, F.when(k % 4 == 0, "dcat_catalog").otherwise("open_api").alias("kind"), F.when(k % 4 == 0, "fetched").otherwise("failed").alias("status"))
    return board.checks(n.select(run, F.inline(F.array_compact(more))), artifacts, n.select(run)).select("run_id", "ord", "check_id", "presence")


@query("""SELECT 'a' || n_nationkey AS artifact_id, CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE 'Open API' END AS name, CASE n_nationkey % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'auth-required' WHEN 2 THEN 'invalid' ELSE 'invalid' END AS presence FROM nation""")
def artifact_states(spark, d):
    k = F.col("n_nationkey")
    status = F.when(k % 4 == 0, "fetched").when(k % 4 == 1, "auth_required").when(k % 4 == 2, "parse_error").otherwise("failed")
    rows = load(spark, d, "nation").select(F.lit("r").alias("run_id"), F.concat(F.lit("a"), k.cast("string")).alias("id"), F.when(k % 3 == 0, F.col("n_name")).alias("title"), F.lit("open_api").alias("kind"), status.alias("status"), F.concat(F.lit("https://data.example/"), k.cast("string")).alias("url"), F.lit(None).cast("string").alias("error"), F.lit("application/json").alias("media_type"))
    return board.artifact_statuses(rows).select("artifact_id", "name", "presence")


@query("SELECT n_nationkey, 'https://data.example/?token=REDACTED' AS value, 'https://data.example/' || n_nationkey AS href, 'plain' AS other FROM nation")
def redacted_evidence(spark, d):
    url = lambda text: F.lit(text)
    e = F.struct(url("https://u:p@data.example/?token=1").alias("value"), F.concat(F.lit("https://data.example/"), F.col("n_nationkey").cast("string")).alias("href"))
    plain = F.struct(F.lit("plain").alias("value"), F.lit(None).cast("string").alias("href"))
    return load(spark, d, "nation").select("n_nationkey", redacted(e)["value"].alias("value"), redacted(e)["href"].alias("href"), redacted(plain)["value"].alias("other"))
