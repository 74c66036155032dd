"""Steps whose rows must not grow with the square of a group, and results that no display's limit may cut."""

import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import capability, contexts, graph, schema_graph, workbench
from lodestrata.operators.jsonwalk import walk
from lodestrata.plans import catalogue, demo


def test_many_that_share_a_label_and_a_route_meet_one_row(spark):
    n = 40_000  # 10^9 pairs, were each made
    k = F.col("id")
    kind = F.when(k % 2 == 0, "distribution").otherwise("data_service")
    title = F.when(k % 4 < 2, "Trees").otherwise(F.concat(F.lit("Own "), k.cast("string")))
    frame = spark.range(2 * n).select(F.lit("r").alias("run_id"), k, kind.alias("kind"), title.alias("title"), F.lit(None).cast("string").alias("uri"), F.lit("https://data.example/a/b/c").alias("endpoint_url"), (-k).alias("ordinal"), F.lit(0).alias("seq"))
    began = time.monotonic()
    found = capability.related_distribution(frame).groupBy("distribution").count().collect()
    assert [(r["distribution"], r["count"]) for r in found] == [(2 * n - 2, n)]
    assert time.monotonic() - began < 60


def test_a_graph_without_a_budget_is_whole(spark):
    n = workbench.NODE_BUDGET + 500
    nodes = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").cast("string").alias("node_id"), F.lit("dataset").alias("node_type"), F.col("id").alias("seq"))
    edges = spark.range(1, n).select(F.lit("r").alias("run_id"), F.lit("0").alias("source"), F.col("id").cast("string").alias("target"), F.lit("x").alias("label"))
    assert [f.count() for f in workbench.budgeted(nodes, edges, None)] == [n, n - 1]
    assert [f.count() for f in workbench.budgeted(nodes, edges)] == [workbench.NODE_BUDGET, workbench.NODE_BUDGET - 1]


def test_numbered_relations_are_the_relations(spark):
    d = "/root/testdata/sf0.001"
    own = demo.relations(spark, d).where("predicate <> 'cv:hasChannel'").select("relation_id", "subject_id", "predicate", "object_id")
    some = demo.numbered_relations(spark, d).where("predicate <> 'cv:hasChannel'")
    named = some.select(demo.relation_text("relation_id").alias("relation_id"), demo.named("subject_id").alias("subject_id"), "predicate", demo.named("object_id").alias("object_id"))
    assert own.exceptAll(named).count() == named.exceptAll(own).count() == 0


def test_what_is_reached_is_counted_without_pairs(spark):
    edges = spark.createDataFrame([(str(k), str(j)) for k in range(1, 60) for j in {k // 2, k // 3}] + [("59", "7"), ("0", "59")], "source string, target string")
    pairs = schema_graph.closure(edges).groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("a"), F.max("target").alias("b"))
    assert sorted(map(tuple, schema_graph.reach(edges).collect())) == sorted(map(tuple, pairs.collect()))


def test_lists_of_what_is_reached_are_stored_once(spark, monkeypatch):
    rows, stored = [], schema_graph.stored
    monkeypatch.setattr(schema_graph, "stored", lambda df, label: (out := stored(df, label), any("array" in t for _, t in df.dtypes) and rows.append(out.count()))[0])
    edges = spark.createDataFrame([(str(k), str(j)) for k in range(60) for j in {k // 2, k // 3}], "source string, target string")  # all lead to the cycle of 0
    assert schema_graph.reach(edges).count() == 60
    assert sum(rows) <= 2 * 60


@pytest.mark.parametrize("levels, joined", [(100, 3), (2, 5)])
def test_what_is_reached_through_cycles_and_between_them(spark, monkeypatch, levels, joined):
    monkeypatch.setattr(schema_graph, "LEVELS", levels)
    monkeypatch.setattr(schema_graph, "JOINED", joined)
    rng = random.Random(levels + joined)
    pairs = {(a, b) for a in range(25) for b in rng.sample(range(a + 1, 30), rng.randint(0, 2))}  # ends lie above
    pairs |= {(12, 10), (13, 12), (20, 20), (21, 18)} | {(k, k + 1) for k in range(100, 107)}
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source string, target string")
    on = {}
    for a, b in pairs:
        on.setdefault(a, set()).add(b)

    def reached(a):
        seen, open_ = set(), [a]
        while open_:
            fresh = on.get(open_.pop(), set()) - seen
            seen |= fresh
            open_ += fresh
        return {str(x) for x in seen}

    want = sorted((str(a), len(reached(a)), min(reached(a)), max(reached(a))) for a in on)
    assert sorted(map(tuple, schema_graph.reach(edges).collect())) == want
    assert schema_graph.reach(edges.limit(0)).collect() == []


def test_contexts_and_shapes_send_nothing_whole_through_the_driver(spark):
    frame = spark.createDataFrame([(1, '{"@context": {"path": "sh:path"}, "@id": "urn:s", "sh:property": [{"path": "urn:p", "sh:name": "N"}]}')], "key long, body string")
    for contexts_too in (True, False):
        found = contexts.shape_properties(frame, contexts=contexts_too)
        assert found.count() == contexts_too
        plan = found._jdf.queryExecution().toString()
        assert "Broadcast" not in plan
        assert plan.count("FileScan") <= 12  # a few stored tables, not each level of the walk for each join
    assert "Broadcast" not in contexts.contextualized(walk(frame))._jdf.queryExecution().toString()


def test_documents_of_a_small_file_are_dealt_over_all_cores(spark):
    assert catalogue._suppliers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_edges_are_dealt_by_a_number_and_chained_without_a_window(spark):
    g = catalogue._graph(spark, "/root/testdata/sf0.001")
    assert g.parts is None and demo.parts(spark, "/root/testdata/sf0.1") is None
    g.parts = 37  # what larger tables get
    for found in (g.offerings(), g.service_types()):
        assert found.columns == ["run_id", "source", "target"]
        assert found.rdd.getNumPartitions() == 37
        assert "Window" not in found._jdf.queryExecution().toString()


def test_repeated_edges_change_nothing(spark):
    assets = spark.createDataFrame([("r", n, k, n, n) for n, k in (("s", "public_service"), ("q", "requirement"), ("l", "evidence_type_list"), ("t", "evidence_type"), ("o", "evidence_offering"), ("d", "data_service"))], "run_id string, id string, kind string, uri string, title string")
    edges = [("s", "cv:holdsRequirement", "q"), ("q", "cccev:hasEvidenceTypeList", "l"), ("l", "cccev:specifiesEvidenceType", "t"), ("o", "registry_manifest:evidenceType", "t"), ("o", "registry_manifest:evidenceService", "d")]
    relations = spark.createDataFrame([("r", f"{a}{b}", a, p, b, 0) for a, p, b in 3 * edges], "run_id string, relation_id string, subject_id string, predicate string, object_id string, seq int")
    for paths in (True, False):
        g = graph.ServiceGraph(assets, relations, paths=paths)
        for found, row in ((g.service_types(), ("s", "t")), (g.offerings(), ("t", "o"))):
            assert [(r.source, r.target) for r in found.collect()] == [row]
        assert [(r.n_types, r.n_missing, r.satisfiable) for r in g.option_access().collect()] == [(1, 0, True)]
        assert sorted((r.asset_id, r.predicate) for r in g.gaps().collect()) == [("o", "registry_manifest:providedBy"), ("s", "cv:hasChannel")]


def test_claims_are_counted_without_a_row_for_each_step(spark):
    g = catalogue._graph(spark, "/root/testdata/sf0.001", paths=True)
    paths = g.service_types()
    steps = g.provenance(paths).groupBy("source").agg(F.count("*").alias("claims"), F.count_distinct("target").alias("routes"), F.min("relation_id").alias("first"))
    assert sorted(map(tuple, g.provenance_counts(paths).drop("run_id").collect())) == sorted(map(tuple, steps.collect()))


def test_claims_are_counted_slice_by_slice_and_leave_no_shuffle_files(spark):
    d, files = "/root/testdata/sf0.001", lambda: {str(p) for p in pathlib.Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data")}
    g = catalogue._graph(spark, d, paths=True)
    before, rows = files(), []
    found = [g.counted(n).claimed_types(n) for n in (1, 3)]
    assert files() <= before
    for f in (*found, g.provenance_counts(g.service_types())):
        rows.append(sorted(map(tuple, f.drop("run_id").collect())))
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 10


def test_a_search_reads_its_index_and_its_assets_once(spark, monkeypatch):
    read, stored, d = [], capability.stored, "/root/testdata/sf0.001"
    monkeypatch.setattr(capability, "stored", lambda df, label: (read.append((label, any(d in f for f in df.inputFiles()))), stored(df, label))[1])
    assert catalogue.capability_rank(spark, d).count() == 19
    assert sorted(label for label, sources in read if sources) == ["hits", "met"] and "matches" in dict(read)


def test_values_that_repeat_or_are_blank_change_no_hit(spark):
    some = [("r", "s", "e1", "a1", "metadata", ["Trees", " trees ", "", None], ["dct:title", None], ["x", " x"]), ("r", "s", "e2", None, "access", [" "], [], [""])]
    records = spark.createDataFrame(some, "run_id string, source_id string, evidence_id string, asset_id string, strength string, labels array<string>, iris array<string>, fields array<string>")
    need = capability.InformationNeed("n").requires_any(*(capability.Term.label(x) for x in ("TREES", " ", "")), capability.Term.named_field("x"), capability.Term.named_field("")).requires_all(capability.Term.iri("dcterms:title"), capability.Term.iri("http://purl.org/dc/terms/title"))
    asked = capability.expanded_terms(capability.CapabilityQuery("q").need(need).terms(spark))
    rows = [sorted(map(repr, (r.asDict() for r in capability.hits(index, asked).select("role", "group_ord", "evidence_id", "term_kind", "value").collect()))) for index in (capability.inverted(records), capability.postings(records))]
    assert rows[0] == rows[1] and any("trees" in r for r in rows[0]) and not any("e2" in r for r in rows[1])
