"""Tables kept as numbered versions in one folder, which share what no change touched.

Rows lie in buckets by a hash of their id. A version lists, for each bucket, folders of Parquet files; a change reads and writes the
buckets of the ids it names and carries all other folders over by name, so what it writes follows the change, not the table.
A version is there once its commit file is: ``commits/<number>.json`` is written last and never replaced, so a writer that
was overtaken fails and a reader never sees half a version. Nothing is updated in place. Paths go through Hadoop's file systems.

One bucket should be some files' worth of data: give large tables more ``buckets`` when they are made. Rows that are only added
become further folders of their buckets, which ``compact`` joins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.engine.shared import store

#: Buckets of a new table, and folders of a bucket from which on ``compact`` joins them.
BUCKETS, FOLDERS = 64, 8
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class VersionedTable:
    """A table of records by ``id`` under ``root``. Methods that read give DataFrames; those that write, the new version."""

    def __init__(self, spark: SparkSession, root: str, contract: dict[str, object] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.contract, self.buckets = spark, root.rstrip("/"), contract or {}, buckets
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        return sorted(int(n.split(".")[0]) for n in self._names("commits") if n.endswith(".json"))

    def commit_info(self, version: int) -> dict:
        """What a commit says: ``files`` (bucket: folders), ``schema``, ``note``, ``contract`` and ``state``."""
        stream = self._fs.open(self._path(f"{self.root}/commits/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _known(self, version: int | None = None) -> tuple[int, dict]:
        """The number and the commit of ``version``, by default the latest. A contract that differs from the stored one is an error."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise LookupError(f"no version {version} under {self.root}")
        number = known[-1] if version is None else version
        info = self.commit_info(number)
        differ = {k: (v, info["contract"][k]) for k, v in self.contract.items() if k in info["contract"] and info["contract"][k] != v}
        if differ:
            raise ValueError(f"the table was written under another contract: {differ}")
        return number, info

    def _rows(self, info: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(info["schema"])
        paths = [f"{self.root}/{f}" for b, folders in info["files"].items() if buckets is None or b in buckets for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version``, the latest by default. Columns that came later are null in older rows."""
        return self._rows(self._known(version)[1])

    def state(self, version: int | None = None) -> dict:
        """What writers keep beside the rows; each version has its own."""
        return self._known(version)[1]["state"]

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets)).cast("string")

    def _put(self, rows: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Writes rows; returns the folder of each bucket that has some. Large buckets become several files."""
        data = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{data}")
        return {n.partition("=")[2]: [f"{data}/{n}"] for n in self._names(data) if n.startswith(f"{BUCKET}=")}

    def _commit(self, version: int, files: dict[str, list[str]], schema: StructType, note: str, buckets: int, state: dict) -> int:
        fields = [f | {"nullable": True} for f in schema.jsonValue()["fields"]]
        body = {"files": files, "schema": {"type": "struct", "fields": fields}, "note": note, "contract": self.contract, "buckets": buckets, "state": state}
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        try:
            stream = self._fs.create(self._path(f"{self.root}/commits/{version:020d}.json"), False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.root} is there already") from e
        stream.write(json.dumps(body).encode())
        stream.close()
        return version

    def write(self, rows: DataFrame, base: int | None = None, note: str = "write", state: dict | None = None) -> int:
        """Commits ``rows`` as the whole version after ``base`` (0 for none; the latest by default)."""
        known = self.versions()
        version = (known[-1] if known else 0) + 1 if base is None else base + 1
        return self._commit(version, self._put(rows, self.buckets), rows.schema, note, self.buckets, state or {})

    def set_state(self, state: dict, note: str = "state") -> int:
        """A version with the same rows and another state."""
        base, info = self._known()
        return self._commit(base + 1, info["files"], StructType.fromJson(info["schema"]), note, info["buckets"], state)

    def change(self, how: Callable[[DataFrame], DataFrame], ids: DataFrame, note: str = "change", state: dict | None = None) -> int:
        """Commits what ``how`` makes of the rows in the buckets of ``ids``; other buckets stay as they are. ``how`` must change
        no row whose id isn't named."""
        base, info = self._known()
        touched = {r[0] for r in ids.select(self._bucket(info["buckets"]).alias("b")).distinct().collect()}  # as many as buckets at most
        after = how(self._rows(info, touched))
        files = {b: f for b, f in info["files"].items() if b not in touched} | (self._put(after, info["buckets"]) if touched else {})
        return self._commit(base + 1, files, after.schema, note, info["buckets"], info["state"] if state is None else state)

    def upsert(self, batch: DataFrame, order: str) -> int:
        """``batch`` over the table by id; the last by ``order`` of rows with one id. Columns missing on a side become null."""
        last = batch.withColumn("_nth", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))).where("_nth = 1").drop("_nth")
        if not self.versions():
            return self.write(last, 0, "upsert")
        last = store(last, "upsert")
        return self.change(lambda base: base.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True), last, "upsert")

    def add_if_absent(self, batch: DataFrame) -> int:
        """Adds rows whose id isn't there; of rows with one id in the batch one is added. Writes the new rows only."""
        new = batch.dropDuplicates(["id"])
        if not self.versions():
            return self.write(new, 0, "add")
        base, info = self._known()
        new = store(new, "add")
        touched = {r[0] for r in new.select(self._bucket(info["buckets"]).alias("b")).distinct().collect()}
        old = self._rows(info, touched)
        absent = old.limit(0).unionByName(new.join(old.select("id"), "id", "left_anti"), allowMissingColumns=True)
        files = dict(info["files"])
        for bucket, folders in self._put(absent, info["buckets"]).items():
            files[bucket] = [*files.get(bucket, []), *folders]
        return self._commit(base + 1, files, absent.schema, "add", info["buckets"], info["state"])

    def delete(self, ids: DataFrame) -> int:
        """Removes the rows whose ``id`` is in ``ids``."""
        ids = store(ids.select("id"), "delete")
        return self.change(lambda base: base.join(ids, "id", "left_anti"), ids, "delete")

    def replace_sources(self, batch: DataFrame, keys: tuple[str, ...] = ("source_file", "domain")) -> int:
        """Removes all rows of the batch's sources, then adds the batch. Finding them reads keys and ids of the whole table."""
        batch = store(batch, "replace")
        sources = batch.select(*keys).distinct()
        ids = self.read().join(sources, list(keys), "left_semi").select(F.col("id").cast("string").alias("id"))
        touched = ids.unionByName(batch.select(F.col("id").cast("string").alias("id")))
        return self.change(lambda base: base.join(sources, list(keys), "left_anti").unionByName(batch, allowMissingColumns=True), touched, "replace")

    def update(self, patch: DataFrame) -> int:
        """Sets what isn't null in ``patch`` on rows with its ids; ids that aren't there change nothing."""
        patch = store(patch, "update")

        def change(base: DataFrame) -> DataFrame:
            set_ = [c for c in patch.columns if c != "id"]
            renamed = patch.select("id", *(F.col(c).alias(f"_new_{c}") for c in set_))
            joined = base.join(renamed, "id", "left")
            return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in set_ else F.col(c) for c in base.columns))

        return self.change(change, patch, "update")

    def upsert_changed(self, batch: DataFrame, key: str = "source_file", digest: str = "content_hash") -> int:
        """Upserts rows whose digest differs from the one stored for their key, or that are new."""
        base = self.read()
        stored = base.select(F.col(key).alias("_key"), F.col(digest).alias("_digest")).distinct()
        changed = batch.join(stored, F.col(key).eqNullSafe(F.col("_key")) & F.col(digest).eqNullSafe(F.col("_digest")), "left_anti")
        return self.upsert(changed, key)

    def compact(self, folders: int = FOLDERS) -> int | None:
        """Joins the folders of buckets that have so many; returns the new version, or None where no bucket has."""
        base, info = self._known()
        many = {b for b, f in info["files"].items() if len(f) >= folders}
        if not many:
            return None
        files = {b: f for b, f in info["files"].items() if b not in many} | self._put(self._rows(info, many), info["buckets"])
        return self._commit(base + 1, files, StructType.fromJson(info["schema"]), "compact", info["buckets"], info["state"])

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the commits of all but the last ``keep`` versions, and the folders that only they name; returns how many
        versions went. Folders of writers that failed before their commit stay."""
        known = self.versions()
        old = known[:-keep] if keep > 0 else []
        folders = lambda versions: {f for v in versions for fs in self.commit_info(v)["files"].values() for f in fs}
        gone = folders(old) - folders(known[len(old) :])
        for version in old:
            self._fs.delete(self._path(f"{self.root}/commits/{version:020d}.json"), False)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return len(old)
