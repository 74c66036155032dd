"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables written inside swept(), in their order.
_inside: ContextVar[list[str] | None] = ContextVar("_inside", default=None)
#: Tables that still exist; they go when the program ends.
_standing: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder. Where neither is set, a local master gets a temporary folder; anything else is an error, as executors would not see it."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _file_system(spark, path)
    return system.exists(folder)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files of a folder."""
    folder, system = _file_system(spark, path)
    return system.getContentSummary(folder).getLength()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all below it, if there is one."""
    folder, system = _file_system(spark, path)
    system.delete(folder, True)


def _delete(spark: SparkSession, path: str) -> None:
    delete(spark, path)
    _standing.pop(path, None)


@atexit.register
def _end() -> None:
    for path, spark in list(_standing.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: this cuts the lineage, and lost executors cost no more than a new read."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    inside = _inside.get()
    if inside is not None:
        inside.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffle files go when the query that wrote them ends, not when the driver's memory is next cleared.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside leave no shuffle files behind, so the disk holds those of one step at a time."""
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; what lies there goes when the program ends."""
    path = f"{shared_dir(spark)}/lodestrata-{label}-{uuid.uuid4().hex}"
    _standing[path] = spark
    return path


@contextlib.contextmanager
def swept(spark: SparkSession, all: bool = False) -> Iterator[None]:
    """Delete at the end all tables written inside but the last: for a step whose result is itself stored last. After an error, or with all, all of them go."""
    outer, own, done = _inside.get(), [], False
    token = _inside.set(own)
    try:
        yield
        done = True
    finally:
        _inside.reset(token)
        kept = own[-1:] if done and not all else []
        for path in own[: len(own) - len(kept)]:
            _delete(spark, path)
        if outer is not None:
            outer.extend(kept)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote and that no later plan reads."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        if "/lodestrata-" in folder:
            _delete(df.sparkSession, folder)
