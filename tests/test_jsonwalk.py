"""The walk over nested JSON has no limit of rows."""

import json

from lodestrata.operators import jsonwalk


def test_walk_of_many_values(spark):
    nested = "[" * 9 + "7" + "]" * 9
    wide = json.dumps({"a/b": list(range(40)), "c~": {"d": None}})
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")  # stands for a table with more values than the default of a million
    try:
        rows = jsonwalk.walk(spark.createDataFrame([(1, wide), (2, nested), (3, "no JSON"), (4, None)], "key long, body string")).select("key", "pointer", "depth").collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert {(r.pointer, r.depth) for r in rows if r.key == 1} == {("", 0), ("/a~1b", 1), ("/c~0", 1), ("/c~0/d", 2)} | {(f"/a~1b/{k}", 2) for k in range(40)}
    assert sorted(r.depth for r in rows if r.key == 2) == list(range(10)) and len(rows) == 44 + 10
