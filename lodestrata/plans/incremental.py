"""A report that is kept: artifacts arrive in batches, in any order, and the stored tables stay those of one analysis of all of them.

What a batch's artifacts say by themselves (report.parts) is merged into the stored
parts: of rows of one id the first by (ordinal, seq) stays, whichever batch brought it, and
a relation's end that named an asset of a later batch is resolved once that asset is
there. Both concern one run only, so tables are dealt into buckets by run, and a
batch reads and rewrites the buckets of its own runs, nothing else.

A batch writes its buckets under a folder of its own and becomes part of the state
by one small file that is written last: the list of its buckets. A batch that fails
before leaves the state as it was; a batch that is given again is not counted
again. Folders that no bucket is read from any more are deleted by vacuum().

Results in edge cases: an empty batch changes nothing. An artifact that comes twice
under one URL is there twice, as in one analysis; streaming.arriving drops it before. A run with
most rows makes its bucket large, not the task: within a bucket, rows are merged by run and id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import first_by
from ..sources.store import delete, exists, swept
from .report import MERGED, Options, Report, parts, whole
from .schemas import FETCHED

#: Buckets of runs. A batch reads and rewrites those of its runs.
BUCKETS = 64


def bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")


def merged(tables: dict[str, DataFrame], more: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two sets of parts as one."""
    out = {}
    for name, table in tables.items():
        both = table.unionByName(more[name].select(*table.columns))
        out[name] = first_by(both, ["run_id", "id"], ["ordinal", "seq"]) if name in MERGED else both
    return out


@dataclass
class KeptReport:
    """A report under path, a folder that driver and executors share."""

    spark: SparkSession
    path: str
    options: Options = field(default_factory=Options)
    buckets: int = BUCKETS

    def _commits(self) -> DataFrame | None:
        root = f"{self.path}/commits"
        return self.spark.read.schema("batch long, place long, bucket int").option("recursiveFileLookup", "true").parquet(root) if exists(self.spark, root) else None

    def versions(self) -> dict[int, int]:
        """For each bucket the batch that wrote what it holds now: one row for each bucket."""
        commits = self._commits()
        return {} if commits is None else {r.bucket: r.batch for r in commits.where("bucket is not null").groupBy("bucket").agg(F.max_by("batch", "place").alias("batch")).collect()}

    def batches(self) -> set[int]:
        """The batches that are in the state: one number for each, as it was given."""
        commits = self._commits()
        return set() if commits is None else {r.batch for r in commits.select("batch").distinct().collect()}

    def _read(self, table: str, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={n}/{table}/bucket={b}" for b, n in sorted(versions.items())]
        return self.spark.read.parquet(*[p for p in paths if exists(self.spark, p)]) if any(exists(self.spark, p) for p in paths) else None

    def parts(self, versions: dict[int, int] | None = None) -> dict[str, DataFrame]:
        """The stored parts of all buckets, or of those in versions; a table of which there is nothing is left out."""
        versions = self.versions() if versions is None else versions
        found = {name: self._read(name, versions) for name in (*MERGED, "artifacts", "fields")}
        return {name: table for name, table in found.items() if table is not None}

    def add(self, fetched: DataFrame, batch: int) -> bool:
        """Merge a batch of fetched artifacts into the state; False if it was there already."""
        if batch in self.batches():
            return False
        spark, place = self.spark, len(self.batches())
        folder = f"{self.path}/data/batch={batch}"
        delete(spark, folder)  # of an attempt that failed
        with swept(spark, all=True):
            new = parts(fetched, self.options)
            touched = sorted(r.b for r in fetched.select(bucket_of(self.buckets).alias("b")).distinct().collect())  # at most as many as there are buckets
            versions = {b: n for b, n in self.versions().items() if b in touched}
            old = self.parts(versions)
            for name, table in merged({n: old.get(n, new[n].limit(0)) for n in new}, new).items():
                at = bucket_of(self.buckets)
                table.withColumn("bucket", at).repartition("bucket", F.pmod(F.xxhash64("run_id", *(["id"] if "id" in table.columns else ["node"])), F.lit(8))).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/{name}")
            rows = [(batch, place, b) for b in touched] or [(batch, place, None)]
            spark.createDataFrame(rows, "batch long, place long, bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def report(self) -> Report:
        """The report of all batches so far. Raises ValueError where there is none."""
        found = self.parts()
        if "artifacts" not in found:
            raise ValueError("no batch has an artifact")
        missing = {n for n in (*MERGED, "fields") if n not in found}
        if missing:
            found |= {n: t.limit(0) for n, t in parts(self.spark.createDataFrame([], FETCHED), self.options).items() if n in missing}
        return whole(found, self.options)

    def vacuum(self) -> list[int]:
        """Delete what no bucket is read from any more: the folders of batches that later ones have rewritten. Readers of an earlier state must have ended."""
        live = set(self.versions().values())
        gone = sorted(self.batches() - live)
        for n in gone:
            delete(self.spark, f"{self.path}/data/batch={n}")
        return gone


