"""Artifacts that arrive as files: Structured Streaming over a folder, each artifact analyzed once and merged into a kept report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..functions.ids import det_id
from ..plans.incremental import KeptReport
from ..plans.report import Options
from ..plans.schemas import FETCHED

#: How long the stream remembers which artifacts it has seen; its state holds no more.
REMEMBERED = "7 days"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of fetched artifacts (Parquet with the fetched schema)."""
    return spark.readStream.schema(FETCHED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(stream: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """The first artifact of each run and URL, fragments apart.

    Time is fetched_at, or that of the batch where it has none. What came within `remembered` before is known, in whichever batch
    and before whichever restart it came; the state of older ones is dropped, and they would count as new.
    """
    timed = stream.withColumn("_at", F.coalesce(F.try_to_timestamp("fetched_at"), F.current_timestamp())).withColumn("_id", det_id("artifact", urls.normalize(F.coalesce("final_url", "url"))))
    known = timed.withWatermark("_at", remembered) if stream.isStreaming else timed
    first = known.dropDuplicatesWithinWatermark(["run_id", "_id"]) if stream.isStreaming else known.dropDuplicates(["run_id", "_id"])
    return first.drop("_at", "_id")


def analyze_stream(stream: DataFrame, out: str, checkpoint: str, options: Options | None = None, remembered: str = REMEMBERED, **trigger) -> StreamingQuery:
    """Merge each batch into the kept report under out. A batch that is run again is not counted again; KeptReport(spark, out).report() gives the whole at any time."""

    def each(batch: DataFrame, number: int) -> None:
        KeptReport(batch.sparkSession, out, options or Options()).add(batch, number)

    return once(stream, remembered).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
