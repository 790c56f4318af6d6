"""Sources by Spark's Python data source API: text exports in a folder, and the entries of a legacy store in SQLite.

``exports`` lists a folder once, skips files by filters on path and size before any is opened, and packs the others into partitions of
about as many bytes each; files go through Arrow's file systems, so the folder may lie on any of them. ``legacy`` cuts the store into
ranges of its ids; its file has to lie where all executors see it. A lost task reads its files or its range again.
"""

from __future__ import annotations

import operator
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from lorekeep.sources.versions import VersionedTable

#: Files over this size are not read; bytes of a partition; ids of a legacy store's partition.
MAX_BYTES = 500 * 1024 * 1024
PARTITION_BYTES, PARTITION_IDS = 128 * 1024 * 1024, 50_000
SUFFIXES = ".txt,.md,.json,.jsonl"

TESTS = {
    D.EqualTo: operator.eq,
    D.In: lambda have, wanted: have in wanted,
    D.GreaterThan: operator.gt,
    D.GreaterThanOrEqual: operator.ge,
    D.LessThan: operator.lt,
    D.LessThanOrEqual: operator.le,
    D.StringStartsWith: str.startswith,
    D.StringEndsWith: str.endswith,
    D.StringContains: operator.contains,
}


def decided(filters: list[D.Filter], columns: tuple[str, ...]) -> tuple[list[D.Filter], list[D.Filter]]:
    """The filters that a listing of ``columns``, none of them null, decides, and the others."""
    ours = [f for f in filters if (type(f) in TESTS or isinstance(f, D.IsNotNull)) and f.attribute in {(c,) for c in columns} and not (type(f) in TESTS and f.value is None)]
    return ours, [f for f in filters if not any(f is o for o in ours)]


def passes(row: dict, filters: list[D.Filter]) -> bool:
    return all(isinstance(f, D.IsNotNull) or TESTS[type(f)](row[f.attribute[0]], f.value) for f in filters)


@dataclass
class Files(D.InputPartition):
    files: list[tuple]


class ExportReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.suffixes = tuple(options.get("suffixes", SUFFIXES).split(","))
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        self.filters, rest = decided(filters, ("path", "size"))
        yield from rest

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = sorted((i.path, i.size, i.mtime) for i in system.get_file_info(fs.FileSelector(folder, recursive=True)) if i.type == fs.FileType.File)
        packs, room = [[]], self.size
        for path, size, modified in found:
            name = path.rsplit("/", 1)[-1].lower()
            wanted = name.endswith(self.suffixes) and not name.endswith(".meta.json") and size <= MAX_BYTES
            if wanted and passes({"path": path, "size": size}, self.filters):
                if packs[-1] and size > room:
                    packs.append([])
                    room = self.size
                packs[-1].append((path, size, modified))
                room -= size
        return [Files(pack) for pack in packs]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        for path, size, modified in partition.files:
            with system.open_input_stream(path, compression=None) as stream:
                yield path, size, modified, stream.read().decode("utf-8", "replace")


class Exports(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lorekeep_exports"

    def schema(self) -> str:
        return "path string, size bigint, modified timestamp, content string"

    def reader(self, schema) -> ExportReader:
        return ExportReader(self.options)


@dataclass
class Ids(D.InputPartition):
    low: int
    high: int


class LegacyReader(D.DataSourceReader):
    """Keys and values of the entries; the file is opened for reading only."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionIds", PARTITION_IDS))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Ids]:
        db = self._open()
        low, high = db.execute("SELECT min(id), max(id) FROM embeddings").fetchone()
        db.close()
        return [Ids(0, 0)] if low is None else [Ids(at, at + self.size) for at in range(low, high + 1, self.size)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        db = self._open()
        asked = """SELECT e.embedding_id, m.key, m.string_value, m.int_value, m.float_value, m.bool_value
            FROM embeddings e LEFT JOIN embedding_metadata m ON m.id = e.id WHERE e.id >= ? AND e.id < ?"""
        for id_, key, text, whole, real, flag in db.execute(asked, (partition.low, partition.high)):
            yield id_, key, text, whole, real, None if flag is None else bool(flag)
        db.close()


class Legacy(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lorekeep_legacy"

    def schema(self) -> str:
        return "id string, key string, string_value string, int_value bigint, float_value double, bool_value boolean"

    def reader(self, schema) -> LegacyReader:
        return LegacyReader(self.options)


def _reader(spark: SparkSession, source: type[D.DataSource]):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name())


def exports(spark: SparkSession, folder: str, where: Column | None = None, **options: object) -> DataFrame:
    """(path, size, modified, content) of the text exports under ``folder``; bytes that aren't UTF-8 become U+FFFD. A condition on path or size,
    given here or later, decides which files are opened."""
    found = _reader(spark, Exports).options(**{k: str(v) for k, v in options.items()}).load(folder)
    return found if where is None else found.where(where)


def legacy(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(id, key, string_value, int_value, float_value, bool_value): one row for each key of each entry; a null key for an entry without any."""
    return _reader(spark, Legacy).options(**{k: str(v) for k, v in options.items()}).load(path)


# The key under which an entry's text lies, and what the store's own keys begin with.
TEXT_KEY, OWN = "chroma:document", "chroma:"


def legacy_records(entries: DataFrame, columns: tuple[str, ...] = ("domain", "topic", "source_file")) -> DataFrame:
    """(id, document, ``columns``, metadata): one row for each entry. A value is the first of string, whole number, real number and flag that
    isn't null; of a key that repeats the greatest. What isn't a column stays in ``metadata``; entries without a text have an empty one."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    once = entries.groupBy("id", "key").agg(F.max(value).alias("value"))
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    other = ~F.col("key").isin(*columns) & ~F.col("key").startswith(OWN) & F.col("value").isNotNull()
    pairs = F.collect_list(F.when(other, F.struct("key", "value")))
    return once.groupBy("id").agg(F.coalesce(of(TEXT_KEY), F.lit("")).alias("document"), *(of(c).alias(c) for c in columns), F.map_from_entries(F.array_sort(pairs)).alias("metadata"))


def migrate(spark: SparkSession, path: str, table: VersionedTable, **options: object) -> int:
    """Writes the records of a legacy store as the first version of a table; a migration that breaks leaves no version. Returns how many
    records there are."""
    if table.versions():
        raise ValueError(f"there is a table under {table.root} already")
    table.write(legacy_records(legacy(spark, path, **options)), 0, "migrate")
    return table.read().count()
