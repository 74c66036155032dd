"""A walk over nested JSON, one row for each value with its pointer, level by level over VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def walk(documents: DataFrame, key: str = "key", body: str = "body", carry: dict[str, str] | None = None, inside: str = "true") -> DataFrame:
    """(key, pointer, depth, name, position, path, kind, value) of each value below and with the root, and the carried columns. What is no JSON gives no row.

    Names are escaped as pointers ask for (~0, ~1). Object members come in the order of their names. path holds the positions from the
    root down, so ordering by it gives each value before what is in it, and all in the order of a walk of the whole document.

    carry names columns that a value hands down: for each an SQL expression over the value v, a string. Where it is null, the value has what
    the one above it has.

    inside is an SQL condition over the same columns (a carried one is _name): what a value holds is walked only where it is true.

    Each level is a table in the shared folder, so neither the number of values nor the depth has a limit but that of the JSON parser.
    """
    carry = carry or {}
    own = [F.lit(None).cast("string").alias(f"_{c}") for c in carry]
    root = documents.select(
        F.col(key).alias("key"), F.lit("").alias("pointer"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("position"), F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(body).cast("string")).alias("v"), *own
    ).where("v is not null")

    def carried(level: DataFrame) -> DataFrame:
        """The columns hold what came from above; what the value itself says goes before it."""
        return level.withColumns({f"_{c}": F.coalesce(F.expr(e), f"_{c}") for c, e in carry.items()}) if carry else level

    levels = [stored(carried(root), "json")]
    down = "".join(f", n._{c}" for c in carry)
    while True:
        level = documents.sparkSession.sql(f"""
            SELECT n.key, concat(n.pointer, '/', coalesce(replace(replace(e.key, '~', '~0'), '/', '~1'), CAST(e.pos AS STRING))) AS pointer, n.depth + 1 AS depth, e.key AS name, e.pos AS position, concat(n.path, array(e.pos)) AS path, e.value AS v{down}
            FROM (SELECT * FROM {{level}} WHERE {inside}) n, LATERAL variant_explode(n.v) e""", level=levels[-1])  # fmt: skip
        level = stored(carried(level), "json")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select("key", "pointer", "depth", "name", "position", "path", F.expr("schema_of_variant(v)").alias("kind"), F.col("v").alias("value"), *(F.col(f"_{c}").alias(c) for c in carry))


def leaves(walked: DataFrame) -> DataFrame:
    """Scalars, as text."""
    return walked.where("kind not like 'OBJECT%' and kind not like 'ARRAY%'").select("key", "pointer", "depth", F.try_variant_get("value", "$", "string").alias("text"))
