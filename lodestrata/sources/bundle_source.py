"""Bundles as a Spark data source: spark.read.format("bundle").load(folder) after register(spark).

A bundle is a JSON object with entry_url and artifacts. A file holds one bundle, over
any number of lines, or one on each line. Each file is a partition, read by the task
that needs it; one bundle is held at a time where they come line by line. Columns are those of fetched
artifacts, as sources.bundles.read_bundle gives them.

option("run_id", "run:a,run:b") reads these runs only: a bundle's run follows from its
entry URL, so artifacts of other bundles are not decoded. Filters run_id = value and run_id IN
(values) do the same by themselves with option("pushdown", "true"), which needs the session's
spark.sql.python.filterPushdown.enabled. That is left to the user: Spark 4.1 keeps a pushed filter with the loaded
frame, and the same frame would have it without the filter too, so each filter then needs a load of its own.

The path may be local or any that pyarrow.fs resolves; files whose names begin with
a dot or underscore are left out, as Spark does. Results in edge cases: an empty file has no rows; artifacts without
status count as 200, without depth as 0; a body is text or an array of byte values, null if absent; what is no bundle is an
error, or, with option("mode", "DROPMALFORMED"), left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..plans.schemas import FETCHED


def run_id(entry_url: str) -> str:
    """The id of a run, as functions.ids.det_id("run", entry_url) gives it."""
    return f"run:{hashlib.sha256(f'run{chr(0)}{entry_url}'.encode()).hexdigest()[:16]}"


def _file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    system, root = _file_system(path)
    if system.get_file_info(root).type == FileType.File:
        return [root]
    found = system.get_file_info(FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == FileType.File and not any(part.startswith((".", "_")) for part in f.path[len(root) :].split("/") if part))


def _bundles(lines: Iterable[str]) -> Iterator[dict]:
    """The bundles of a file: one for each line, or one over all lines."""
    lines = iter(lines)
    first = next((x for x in lines if x.strip()), None)
    if first is None:
        return
    try:
        found = json.loads(first)
    except ValueError:
        yield json.loads("".join([first, *lines]))
        return
    yield found
    for line in lines:
        if line.strip():
            yield json.loads(line)


def _body(value) -> bytes | None:
    if value is None:
        return None
    return bytes(value) if isinstance(value, list) else value.encode() if isinstance(value, str) else json.dumps(value).encode()


@dataclass
class BundleFile(InputPartition):
    path: str


class BundleReader(DataSourceReader):
    def __init__(self, path: str, lenient: bool = False, runs: set[str] | None = None) -> None:
        self.path, self.lenient, self.runs = path, lenient, runs

    def partitions(self) -> list[BundleFile]:
        return [BundleFile(p) for p in _files(self.path)]

    def read(self, partition: BundleFile) -> Iterator[tuple]:
        import io

        system, _ = _file_system(self.path)
        with system.open_input_stream(partition.path) as stream, io.TextIOWrapper(io.BufferedReader(stream), "utf-8", "replace", newline="\n") as lines:
            try:
                for bundle in _bundles(lines):
                    if not isinstance(bundle, dict) or not isinstance(bundle.get("entry_url"), str) or not isinstance(bundle.get("artifacts", []), list):
                        raise ValueError(f"no bundle in {partition.path}")
                    run = run_id(bundle["entry_url"])
                    if self.runs is None or run in self.runs:
                        yield from self._rows(run, bundle.get("artifacts", []))
            except ValueError:
                if not self.lenient:
                    raise

    @staticmethod
    def _rows(run: str, artifacts: list[dict]) -> Iterator[tuple]:
        for k, a in enumerate(artifacts):
            headers = [(h.get("name"), h.get("value")) for h in a.get("headers") or []]
            status, depth = a.get("status"), a.get("depth")
            yield (
                run, k, a.get("url"), a.get("final_url"), 200 if status is None else status, a.get("media_type"), a.get("request_accept"), a.get("redirect_chain"),
                headers if a.get("headers") is not None else None, _body(a.get("body")), a.get("fetched_at"), 0 if depth is None else depth, a.get("discovered_from"),
            )


class PushedBundleReader(BundleReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("run_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.runs = wanted if self.runs is None else self.runs & wanted
            else:
                yield f


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema: StructType) -> BundleReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a bundle source needs a path")
        runs = self.options.get("run_id")
        reader = PushedBundleReader if self.options.get("pushdown", "false").lower() == "true" else BundleReader
        return reader(path, self.options.get("mode", "FAILFAST").upper() == "DROPMALFORMED", set(runs.split(",")) if runs else None)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(BundleSource)
