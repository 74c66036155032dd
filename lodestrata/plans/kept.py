"""Queries over kept reports, sources and crawls: documents written from whole tables, dealt into batches, files and rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.store import scratch
from . import demo
from .catalogue import _fetched, _suppliers, query
from .demo import load
from .incremental import KeptReport


def _services(spark, d):
    """A data service for each supplier, in the run of its nation, that serves the dataset of another document."""
    s = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    node = F.struct(demo.uri("access", "s_suppkey").alias("@id"), F.lit("dcat:DataService").alias("@type"), F.concat(F.col("s_name"), F.lit(" API")).alias("dcterms:title"), F.struct(demo.uri("supplier", "s_suppkey").alias("@id")).alias("dcat:servesDataset"))
    return _fetched(s, F.col("n_name"), F.col("s_suppkey") + 10_000_000, F.concat(demo.uri("services", "s_suppkey"), F.lit(".jsonld")), "application/ld+json", F.to_json(node))


@query("""SELECT n_name AS run_id, 2 * count(*) AS artifact_count, 3 * count(*) AS asset_count, 3 * count(*) + count_if(s_suppkey % 2 = 1) AS relations, count(*) AS served, min(s_name) AS first_title
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""", relations="BIGINT")
def incremental_report(spark, d):
    """Services come first, then the datasets that they serve, in two batches of which the later half is the first."""
    datasets, half = _suppliers(spark, d), F.col("ordinal") % 2 == 0
    kept = KeptReport(spark, scratch(spark, "kept"), buckets=8)
    for number, batch in enumerate((_services(spark, d), datasets.where(half), datasets.where(~half))):
        kept.add(batch, number)
    found = kept.report()
    served = F.count_if((F.col("predicate") == "dcat:servesDataset") & F.col("object_id").startswith("asset:"))
    relations = found.relations.groupBy("run_id").agg(F.count("*").alias("relations"), served.alias("served"))
    first = found.artifacts.groupBy("run_id").agg(F.min(F.when(~F.col("title").endswith(" API"), F.col("title"))).alias("first_title"))
    return found.run.select("run_id", "artifact_count", "asset_count").join(relations, "run_id").join(first, "run_id")


# ---- reports as parts

@query("""SELECT n_name AS run_id, count(*) AS artifacts, 2 * count(*) AS assets, 2 * count(*) + count_if(s_suppkey % 2 = 1) AS relations, 2 * count(*) + count_if(s_suppkey % 2 = 1) AS links, count_if(s_suppkey % 2 = 1) AS standards, max(s_name) AS last_title
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""", relations="BIGINT", links="BIGINT", standards="BIGINT")
def report_parts(spark, d):
    """A report written as JSON lines and a manifest, and read back."""
    from .report import Report, analyze

    folder = scratch(spark, "parts")
    analyze(_suppliers(spark, d)).write_json(folder)
    found = Report.read_json(spark, folder).tables()
    out = found["run"].select("run_id")
    for name in ("artifacts", "assets", "relations", "links", "standards"):
        out = out.join(found[name].groupBy("run_id").agg(F.count("*").alias(name)), "run_id", "left")
    titles = found["artifacts"].groupBy("run_id").agg(F.max("title").alias("last_title"))
    return out.fillna(0).join(titles, "run_id")


# ---- bundles as a data source

_BUNDLE = 40


@query(f"""SELECT 'run:' || substr(sha256('run' || chr(0) || 'https://data.example/bundles/' || page_id // {_BUNDLE}), 1, 16) AS run_id, (page_id % {_BUNDLE})::INTEGER AS ordinal, url, 200 AS status, 'text/html' AS media_type,
sha256(html) AS body_hash, CASE WHEN page_id % 2 = 0 THEN 'gzip' END AS encoding FROM pages""", status="INTEGER")
def bundle_source(spark, d):
    """Pages written as bundles, some forty a bundle and one bundle a line, and read back by the data source; every second one has a header."""
    from ..sources.bundle_source import register

    register(spark)
    folder, k = scratch(spark, "bundles"), F.col("page_id")
    header = F.when(k % 2 == 0, F.array(F.struct(F.lit("content-encoding").alias("name"), F.lit("gzip").alias("value"))))
    artifact = F.struct(k.alias("k"), "url", F.lit("text/html").alias("media_type"), header.alias("headers"), F.col("html").alias("body"))
    entry = F.concat(F.lit("https://data.example/bundles/"), F.floor(k / _BUNDLE).cast("string"))
    bundles = load(spark, d, "pages").groupBy(entry.alias("entry_url")).agg(F.array_sort(F.collect_list(artifact)).alias("artifacts"))
    bundles.select(F.to_json(F.struct("entry_url", "artifacts")).alias("value")).write.text(folder)
    read = spark.read.format("bundle").load(folder)
    return read.select("run_id", "ordinal", "url", "status", "media_type", F.sha2("body", 256).alias("body_hash"), F.get(F.col("headers"), 0)["value"].alias("encoding"))


# ---- contexts, shapes and references over nested documents

#: Objects nest as deep as this, by the supplier's number.
_DEPTH = 7


def _nested(spark, d):
    """A chain of objects for each supplier, as deep as its number says: every second one has a context, every third an id, each a property shape."""
    k, level = F.col("s_suppkey"), F.sequence(F.lit(0), F.col("s_suppkey") % _DEPTH)

    def around(inner, i):
        context = F.when(i % 2 == 0, F.concat(F.lit('"@context": [{"title": "own:old"}, {"title": {"@id": "own:t'), i.cast("string"), F.lit('", "@type": "xsd:string"}, "odd": "no colon"}], '))).otherwise(F.lit(""))
        name = F.when(i % 3 == 0, F.concat(F.lit('"@id": "urn:'), k.cast("string"), F.lit("-"), i.cast("string"), F.lit('", '))).otherwise(F.lit(""))
        shape = F.concat(F.lit('"sh:property": [{"sh:path": {"@id": "urn:p'), i.cast("string"), F.lit('"}, "sh:name": "P"}], "odd": 1, "title": "T'), i.cast("string"), F.lit('"'))
        return F.concat(F.lit("{"), context, name, shape, F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(', "sh:and": ['), inner, F.lit("]"))), F.lit("}"))

    return demo.spread(load(spark, d, "supplier")).select(k.alias("key"), F.aggregate(F.reverse(level), F.lit("").cast("string"), around).alias("body"))


_LEVELS = f"SELECT s_suppkey AS key, unnest(range(s_suppkey % {_DEPTH} + 1)) AS i FROM supplier"


@query(f"""SELECT key, i AS depth, 'own:t' || (i - i % 2) AS term, 'xsd:string' AS coercion, 'T' || i AS value FROM ({_LEVELS})
UNION ALL SELECT key, i, 'odd', NULL, '1' FROM ({_LEVELS})""", depth="INTEGER")
def context_terms(spark, d):
    """Names under the nearest context: own ones override, and objects without one have that above."""
    from ..operators.contexts import contextualized
    from ..operators.jsonwalk import walk

    found = contextualized(walk(_nested(spark, d))).where(F.col("name").isin("title", "odd"))
    return found.select("key", ((F.col("depth") - 1) / 2).cast("int").alias("depth"), "term", "coercion", F.try_variant_get("value", "$", "string").alias("value"))


@query(f"SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i))::INTEGER AS place, 'urn:' || key || '-' || (i - i % 3) AS shape, 'urn:p' || i AS property_path, 'P' AS label FROM ({_LEVELS})")
def nested_shapes(spark, d):
    """Property shapes under the nearest object above with an id, numbered in the order of a walk: an object's own shapes come after those of what it nests."""
    from pyspark.sql import Window

    from ..operators.contexts import shape_properties

    found = shape_properties(_nested(spark, d), contexts=False)
    # `sh:and` comes before `sh:property`, so a walk meets the innermost shape first
    place = F.count("*").over(Window.partitionBy("key")) - F.row_number().over(Window.partitionBy("key").orderBy("path")) + 1
    return found.select("key", place.cast("int").alias("place"), "shape", "property_path", "label")


def _schemas(spark, d):
    """A schema for each part: one property refers to the schema of half its number, a definition to that of a third."""
    k = F.col("p_partkey")
    ref = lambda n: F.concat(F.lit('{"$ref": "schemas-'), n.cast("string"), F.lit('"}'))
    body = F.concat(F.lit('{"properties": {"half": '), ref(F.floor(k / 2)), F.lit(', "own'), (k % 10).cast("string"), F.lit('": {"$ref": "#/$defs/third"}}, "$defs": {"third": {"properties": {"third": '), ref(F.floor(k / 3)), F.lit("}}}}"))
    return demo.spread(load(spark, d, "part")).select(F.concat(F.lit(f"{demo.BASE}schemas-"), k.cast("string")).alias("key"), body.alias("body"))


_REFS = f"""WITH RECURSIVE n AS (SELECT p_partkey AS k, '{demo.BASE}schemas-' || p_partkey AS u FROM part),
e AS (SELECT u AS s, '{demo.BASE}schemas-' || (k // 2) AS t FROM n UNION SELECT u, u || '#/$defs/third' FROM n UNION SELECT u || '#/$defs/third', '{demo.BASE}schemas-' || (k // 3) FROM n),
c AS (SELECT s, t FROM e UNION SELECT c.s, e.t FROM c JOIN e ON e.s = c.t)"""


@query(f"{_REFS} SELECT s AS source, count(*) AS reached, min(t) AS first_place, max(t) AS last_place FROM c GROUP BY 1")
def schema_closure(spark, d):
    """What each schema reaches through its references; the schema of number 0 is not there, and nothing goes on from it."""
    from ..operators import schema_graph
    from ..operators.jsonwalk import walk

    return schema_graph.reach(schema_graph.references(walk(_schemas(spark, d))))


# ---- crawl

_FETCHES, _HOPS = 4, 2


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
e AS (SELECT page_id AS s, unnest([(7 * page_id + 1) % n, (3 * page_id + 2) % n, (5 * page_id + 3) % n]) AS t FROM pages, n),
l AS (SELECT s, list({{'p': t % 4, 'u': 'https://data.example/pages/' || t, 'd': 0}}) AS ts FROM (SELECT DISTINCT s, t FROM e) GROUP BY 1),
w AS (SELECT page_id AS run, 1 AS step, 'https://data.example/pages/' || page_id AS u, 0 AS d, ['https://data.example/pages/' || page_id] AS seen, list_transform(ts, lambda x: {{'p': x.p, 'u': x.u, 'd': 1}}) AS front FROM pages JOIN l ON l.s = page_id
  UNION ALL SELECT run, step, u, d, seen, list_concat(front, list_transform(l.ts, lambda x: {{'p': x.p, 'u': x.u, 'd': d + 1}})) FROM (
    SELECT run, step + 1 AS step, pick.u AS u, pick.d AS d, list_append(seen, pick.u) AS seen, front FROM (
      SELECT *, list_sort(list_filter(front, lambda x: x.d <= {_HOPS} AND NOT list_contains(seen, x.u)))[1] AS pick FROM w WHERE step < {_FETCHES}) WHERE pick IS NOT NULL) c JOIN l ON 'https://data.example/pages/' || l.s = c.u),
z AS (SELECT run, max_by(seen, step) AS seen, max_by(front, step) AS front FROM w GROUP BY 1),
r AS (SELECT run, x.u AS u, min(x.d) AS d FROM (SELECT run, seen, unnest(front) AS x FROM z) WHERE NOT list_contains(seen, x.u) GROUP BY 1, 2)
SELECT 'run-' || run AS run_id, u AS url, d AS depth, 'fetched' AS outcome FROM w
UNION ALL SELECT 'run-' || run, u, NULL, CASE WHEN d > {_HOPS} THEN 'limit.max_depth' ELSE 'limit.max_fetches' END FROM r""", depth="INTEGER")
def best_first_crawl(spark, d):
    """A crawl from each page, one candidate a round: the best open one, whatever its depth; what is left has its reason."""
    from .crawl import CrawlConfig, crawl

    pages = load(spark, d, "pages").select("page_id")
    n, base = pages.count(), "https://data.example/pages/"
    k = F.col("page_id")
    edges = pages.select(F.concat(F.lit(base), k.cast("string")).alias("url"), F.explode(F.array_distinct(F.array((7 * k + 1) % n, (3 * k + 2) % n, (5 * k + 3) % n))).alias("t"))
    seeds = pages.select(F.concat(F.lit("run-"), k.cast("string")).alias("run_id"), F.concat(F.lit(base), k.cast("string")).alias("url"))

    def fetch(due):
        return due.withColumns({"status": F.lit(200), "media_type": F.lit("text/plain"), "body": F.lit(b"x")})

    def follow(good):
        return good.select("run_id", "url").join(edges, "url").select("run_id", F.concat(F.lit(base), F.col("t").cast("string")).alias("url"), (F.col("t") % 4).cast("int").alias("priority"), F.col("url").alias("discovered_from"))

    fetched, rejected = crawl(seeds, fetch, follow, CrawlConfig(max_depth=_HOPS, max_fetches=_FETCHES, width=1, total_timeout_ms=3_600_000))
    return fetched.select("run_id", "url", "depth", F.lit("fetched").alias("outcome")).unionByName(rejected.select("run_id", "url", F.lit(None).cast("int").alias("depth"), F.col("reason_code").alias("outcome")))


# ---- what the workbench shows

_SHOWN = "count(*) AS n, count_if(s_suppkey % 2 = 1) AS odd FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


@query(f"""WITH r AS (SELECT n_name AS run_id, {_SHOWN})
SELECT run_id, 'all' AS lens, 2 * n AS records, n AS edges, 2 * n + odd AS fields FROM r UNION ALL SELECT run_id, 'dataset', n, 0, 2 * n + odd FROM r UNION ALL SELECT run_id, 'access', n, 0, 0 FROM r""", fields="BIGINT")
def board_lens(spark, d):
    """The model of the suppliers' report as a whole, by its datasets, and by its access methods, without a publisher's own."""
    from .board import board, lens
    from .report import analyze

    whole, out = board(analyze(_suppliers(spark, d)), budget=None), None
    for name, shown in (("all", lens(whole, None, False)), ("dataset", lens(whole, "dataset", False)), ("access", lens(whole, "access", False))):
        found = shown.records.groupBy("run_id").agg(F.count("*").alias("records"))
        for table in ("edges", "fields"):
            found = found.join(getattr(shown, table).groupBy("run_id").agg(F.count("*").alias(table)), "run_id", "left")
        own = found.fillna(0).select("run_id", F.lit(name).alias("lens"), "records", "edges", "fields")
        out = own if out is None else out.unionByName(own)
    return out
