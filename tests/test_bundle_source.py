"""The bundle data source against read_bundle, its partitions and its filter."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.ids import det_id
from lodestrata.sources import bundle_source, bundles


def bundle(entry, n):
    artifacts = [{"url": f"{entry}{k}", "body": "é{" if k % 2 else [1, 2, 255], "headers": [{"name": "a", "value": "b"}] if k else None, "redirect_chain": ["x"], "depth": k or None, "status": None if k % 2 else 404} for k in range(n)]
    return {"entry_url": entry, "artifacts": artifacts}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    (root / "a.json").write_text(json.dumps(bundle("https://a.example/", 3), indent=2))
    (root / "b.json").write_text("\n".join(json.dumps(bundle(f"https://{c}.example/", 2)) for c in "bc") + "\n\n")
    (root / "empty.json").write_text("")
    (root / "_hidden.json").write_text("{")
    (root / "deep").mkdir()
    (root / "deep" / "d.json").write_text(json.dumps({"entry_url": "https://d.example/"}))
    bundle_source.register(spark)
    return root


def test_rows_equal_the_reader_of_one_bundle(spark, folder):
    ours = spark.read.format("bundle").load(str(folder))
    entry = det_id("run", F.lit("https://a.example/"))
    theirs = bundles.read_bundle(spark, str(folder / "a.json"))
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    key = lambda r: r.ordinal
    assert sorted(ours.where(F.col("run_id") == entry).collect(), key=key) == sorted(theirs.collect(), key=key)
    assert ours.count() == 7 and ours.rdd.getNumPartitions() == 4


def test_runs_are_filtered_in_the_reader(spark, folder):
    wanted = bundle_source.run_id("https://b.example/")
    urls = ["https://b.example/0", "https://b.example/1"]
    assert [r.url for r in spark.read.format("bundle").option("run_id", f"{wanted},run:none").load(str(folder)).orderBy("ordinal").collect()] == urls
    frame = spark.read.format("bundle").load(str(folder))
    assert frame.where(F.col("run_id") == wanted).count() == 2 and frame.count() == 7
    reader = bundle_source.PushedBundleReader(str(folder))
    assert list(reader.pushFilters([bundle_source.EqualTo(("run_id",), wanted), bundle_source.In(("run_id",), (wanted, "x")), bundle_source.EqualTo(("url",), "u")])) == [bundle_source.EqualTo(("url",), "u")]
    assert reader.runs == {wanted} and sum(len(list(reader.read(p))) for p in reader.partitions()) == 2
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        pushed = spark.read.format("bundle").option("pushdown", "true").load(str(folder)).where(F.col("run_id") == wanted)
        assert [r.url for r in pushed.orderBy("ordinal").collect()] == urls
    finally:
        spark.conf.unset(name)


def test_what_is_no_bundle(spark, folder, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "good.json").write_text(json.dumps(bundle("https://a.example/", 1)))
    read = spark.read.format("bundle")
    with pytest.raises(Exception):
        read.load(str(tmp_path)).count()
    assert spark.read.format("bundle").option("mode", "DROPMALFORMED").load(str(tmp_path)).count() == 1
    with pytest.raises(Exception):
        spark.read.format("bundle").load().count()
