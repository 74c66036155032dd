"""A kept report equals one analysis of all batches, whatever their order; the stream analyzes each artifact once."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.plans.incremental import KeptReport
from lodestrata.plans.report import Options, Report, analyze
from lodestrata.plans.schemas import FETCHED
from lodestrata.sources.bundles import _filled
from lodestrata.streaming import arriving

OPTIONS = Options(analyzed_at="2024-01-01T00:00:00Z", max_next_fetches=2)


@pytest.fixture(scope="module")
def fetched(spark):
    """Two runs; relations name assets of other artifacts, equal links and claims come from several, one body is broken."""
    node = lambda k, **more: json.dumps({"@id": f"urn:{k}", "@type": "dcat:Dataset", "dcterms:title": f"T{k}", "dcterms:conformsTo": {"@id": "https://www.w3.org/TR/shacl/"}, **more})
    link = [("link", "</m.ttl>; rel=describedby, </n.ttl>; rel=describedby, </o.ttl>; rel=describedby")]
    rows = []
    for run in ("a", "b"):
        for k in range(5):
            body = node(k, **{"dcterms:isPartOf": {"@id": f"urn:{(k + 2) % 5}"}, "dcterms:isReferencedBy": "x", "registry_manifest:providedBy": {"@id": "urn:same"}}) if k != 3 else "{"
            rows.append((run, k, f"https://{run}.example/{k}.jsonld", None, 200, "application/ld+json", None, [], link if k % 2 else [], body.encode(), "2024-01-01T00:00:00Z", 0, None))
        rows.append((run, 5, f"https://{run}.example/same.jsonld", None, 200, "application/ld+json", None, [], [], json.dumps({"@id": "urn:same", "@type": "dcat:Catalog"}).encode(), "2024-01-02T00:00:00Z", 0, None))
    return _filled(spark.createDataFrame(rows, FETCHED)).cache()


def rows(report):
    return {name: sorted(table.toJSON().collect()) for name, table in report.tables().items()}


@pytest.fixture(scope="module")
def whole(fetched):
    return rows(analyze(fetched, OPTIONS))


@pytest.mark.parametrize("order", [[[4, 5], [1, 3], [0, 2]], [[0], [], [5, 1, 2, 3, 4]]])
def test_batches_in_any_order_equal_one_analysis(spark, fetched, whole, tmp_path, order):
    kept = KeptReport(spark, str(tmp_path / "kept"), OPTIONS, buckets=3)
    for number, part in enumerate(order):
        # one run's artifacts come in another order than the other's
        own = fetched.where(F.when(F.col("run_id") == "a", F.col("ordinal")).otherwise(5 - F.col("ordinal")).isin(part)) if part else fetched.limit(0)
        assert kept.add(own, number)
        assert not kept.add(own, number)
    assert rows(kept.report()) == whole
    assert any(json.loads(r)["object_id"].startswith("asset:") for r in whole["relations"] if "providedBy" in r)
    kept.vacuum()
    assert rows(kept.report()) == whole and KeptReport(spark, str(tmp_path / "kept"), OPTIONS, buckets=3).batches() == {0, 1, 2}


def test_a_report_in_parts_is_read_back(spark, fetched, whole, tmp_path):
    path = str(tmp_path / "parts")
    report = analyze(fetched, OPTIONS)
    report.write_json(path)
    again = Report.read_json(spark, path)
    assert rows(again) == whole and all(again.tables()[n].schema.simpleString() == t.schema.simpleString() for n, t in report.tables().items())
    lines = [json.loads(x.value) for x in spark.read.text(f"{path}/findings").collect()]
    assert len(lines) == len(whole["findings"]) and [(x["run_id"], x["ordinal"], x["seq"]) for x in lines] == sorted((x["run_id"], x["ordinal"], x["seq"]) for x in lines)
    one = next((tmp_path / "parts" / "assets").glob("part-*"))
    one.write_text(one.read_text().split("\n", 1)[1])
    (one.parent / f".{one.name}.crc").unlink()
    with pytest.raises(ValueError):
        Report.read_json(spark, path)
    with pytest.raises(ValueError):
        Report.read_json(spark, str(tmp_path / "none"))


def test_a_batch_reads_the_buckets_of_its_runs_only(spark, fetched, tmp_path):
    kept = KeptReport(spark, str(tmp_path / "kept"), OPTIONS, buckets=64)
    kept.add(fetched, 0)
    kept.add(fetched.where("run_id = 'a'").limit(0), 1)
    before = kept.versions()
    assert set(before.values()) == {0} and len(before) == 2
    more = fetched.where("run_id = 'b'").limit(1).withColumns({"url": F.lit("https://b.example/new.jsonld"), "ordinal": F.lit(9)})
    kept.add(more, 2)
    assert sorted(kept.versions().values()) == [0, 2] and kept.vacuum() == [1]
    with pytest.raises(ValueError):
        KeptReport(spark, str(tmp_path / "none")).report()


def test_the_stream_analyzes_each_artifact_once(spark, fetched, whole, tmp_path):
    """Files of three batches repeat artifacts of earlier ones, with a restart after the first."""
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for k, part in enumerate(("ordinal < 3", "ordinal >= 2", "true")):
        fetched.where(part).withColumn("ordinal", F.col("ordinal")).coalesce(1).write.mode("append").parquet(source)
        query = arriving.analyze_stream(arriving.arriving(spark, source, 1), out, check, OPTIONS)
        assert query.awaitTermination(300)
    got = rows(KeptReport(spark, out, OPTIONS).report())
    assert got == whole
    # beyond the time that is remembered an artifact counts as new, and state of it is gone
    later = fetched.where("ordinal = 0").withColumn("fetched_at", F.lit("2024-03-01T00:00:00Z"))
    later.coalesce(1).write.mode("append").parquet(source)
    arriving.analyze_stream(arriving.arriving(spark, source, 1), out, check, OPTIONS).awaitTermination(300)
    state = spark.read.format("statestore").load(check)
    assert state.count() <= 2
