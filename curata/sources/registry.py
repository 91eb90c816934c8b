"""Source types (S5, X2): named ways to read landed files as rows (path, value).

``files`` is Spark's own source of whole files (empty ones too). ``landed_feed`` is a Python
``DataSource`` with partitions of many files and a stream reader, the pattern for a type that
Spark has no reader for. ``register`` adds a type; an unknown one is an error that lists the
known ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TASK_FILES, LEAST_TASKS = 512, 32       # files of a task; tasks, where there are as many files
_TYPES: dict[str, Callable[[SparkSession, str, bool], DataFrame]] = {}


def register(name: str):
    """Register a function (spark, root, stream) -> DataFrame (path, value) as a source type."""
    def deco(fn):
        _TYPES[name] = fn
        return fn
    return deco


def known_types() -> list[str]:
    return sorted(_TYPES)


def landed(spark: SparkSession, type_: str, root: str, stream: bool = False) -> DataFrame:
    """The files below ``root``/<source id>/ by a registered type."""
    if type_ not in _TYPES:
        raise ValueError(f"unknown source type {type_!r}; known types: {', '.join(known_types())}")
    return _TYPES[type_](spark, root, stream)


@register("files")
def _files(spark: SparkSession, root: str, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (reader.format("binaryFile").schema(schema).load(f"{root}/*/*.xml")
            .select("path", F.col("content").cast("string").alias("value")))


def _filesystem(root: str):
    from pyarrow import fs
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def _listing(root: str) -> list[tuple[int, str]]:
    """(modification time, path) of the feed files, oldest first."""
    from pyarrow import fs
    system, base = _filesystem(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.path.endswith(".xml"))


def write_file(path: str, text: str) -> None:
    """Land one file; writing it again gives the same file."""
    system, where = _filesystem(path)
    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(where) as f:
        f.write(text.encode())


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _dealt(paths: list[str]) -> list[_Paths]:
    """The files dealt to tasks: up to ``TASK_FILES`` each, fewer where there are few."""
    tasks = max(-(-len(paths) // TASK_FILES), min(len(paths), LEAST_TASKS))
    return [_Paths(paths[i::tasks]) for i in range(tasks)]


class _Files:
    def __init__(self, root: str):
        self.root = root

    def read(self, partition: _Paths) -> Iterator[tuple[str, str]]:
        system, _ = _filesystem(self.root)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            yield path, text


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[_Paths]:
        return _dealt([path for _, path in _listing(self.root)])


class _StreamReader(_Files, DataSourceStreamReader):
    """The offset is the last file seen, in order of modification time and path."""

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        files = _listing(self.root)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Paths]:
        after, until = (start["time"], start["path"]), (end["time"], end["path"])
        return _dealt([path for time, path in _listing(self.root) if after < (time, path) <= until])

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch that is done."""


class LandedFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


@register("landed_feed")
def _landed_feed(spark: SparkSession, root: str, stream: bool) -> DataFrame:
    from curata.session import ship_package
    ship_package(spark)
    spark.dataSource.register(LandedFeeds)
    reader = spark.readStream if stream else spark.read
    return reader.format("landed_feed").option("path", root).load()
