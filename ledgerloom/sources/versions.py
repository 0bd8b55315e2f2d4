"""Tables in versions: several tables change together, and a change rewrites only what it touches.

A table's rows lie in buckets by the hash of its key, each bucket in folders that are never changed
once written: ``<root>/<table>/<commit>/bucket=<n>``. A *manifest*, one small JSON file a version, says
which folders make up which bucket of which table. A commit writes new folders for the buckets it
touches and then, as its last step, the next manifest. So

* readers see all tables as of one version; a failure before the manifest leaves the old version as it
  was, and folders that no manifest names are swept later;
* changing k keys reads and rewrites at most k buckets, appending adds folders and rewrites none;
* of two writers that start from one version the second finds the next manifest taken and is told so.

The manifest grows with tables x buckets (and with appends since the bucket was last rewritten), not
with rows. Only it, and the numbers of touched buckets, pass through the driver. Any file system that
Spark writes to will do, if a rename does not replace an existing file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another commit made the next version first; start again from the newest one."""


@dataclass
class Manifest:
    version: int = 0
    #: table -> key columns, number of buckets, schema as JSON, and for each bucket the commits whose folders it consists of
    tables: dict[str, dict] = field(default_factory=dict)
    #: what writers note: batches already applied, for instance
    notes: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "tables": self.tables, "notes": self.notes})


class Versions:
    """A folder of tables in versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files -----------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read_text(self, *parts: str) -> str:
        path = self._path(*parts)
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, text: str, name: str) -> None:
        """Write next to the place and rename: the file is there whole or not at all, and never replaced."""
        hidden, place = self._path("_versions", f".{uuid.uuid4().hex}"), self._path("_versions", name)
        fs = place.getFileSystem(self._conf)
        stream = fs.create(hidden, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(hidden), fs.makeQualified(place), options)
        except Exception as error:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{self.root}: {name} exists") from None
            raise

    # Reading ---------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("_versions") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """What makes up a version, the newest one if none is named."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        return Manifest(**json.loads(self._read_text("_versions", f"{version:012d}.json")))

    def read(self, table: str, at: Manifest | int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a version; of the given buckets only, if any are given: no other file is opened."""
        at = at if isinstance(at, Manifest) else self.manifest(at)
        spec = at.tables[table]
        wanted = None if buckets is None else {str(b) for b in buckets}
        folders = [f"{self.root}/{table}/{commit}/{BUCKET}={b}" for b, commits in sorted(spec["parts"].items())
                   if wanted is None or b in wanted for commit in commits]
        schema = T.StructType.fromJson(spec["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def bucket_of(self, spec: dict, names: dict[str, str] | None = None) -> Column:
        """The bucket of a row's key; ``names`` where the key's columns are called otherwise."""
        columns = [F.coalesce(F.col((names or {}).get(k, k)).cast("string"), F.lit("")) for k in spec["key"]]
        return F.pmod(F.xxhash64(*columns), F.lit(spec["buckets"])).cast("int")

    def touched(self, spec: dict, rows: DataFrame, names: dict[str, str] | None = None) -> list[int]:
        """Numbers of the buckets that the rows' keys lie in; at most as many as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket_of(spec, names).alias(BUCKET)).distinct().collect())

    def of_keys(self, table: str, keys: DataFrame, at: Manifest | None = None, names: dict[str, str] | None = None) -> DataFrame:
        """Rows of a table whose key is among the given ones, from the buckets of these."""
        at = at or self.manifest()
        spec = at.tables[table]
        own = keys.select(*[F.col((names or {}).get(k, k)).alias(k) for k in spec["key"]]).distinct()
        return self.read(table, at, self.touched(spec, own)).join(own, spec["key"], "left_semi")

    def begin(self) -> "Commit":
        return Commit(self, self.manifest())

    def sweep(self, keep: int = 1) -> int:
        """Delete the manifests before the newest ``keep`` ones and the folders that only they name, or none does.
        Not while another commit is under way. Returns the number of deleted folders."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]] if keep else []
        named = {(t, c) for m in kept for t, spec in m.tables.items() for commits in spec["parts"].values() for c in commits}
        gone = 0
        for version in known[:-keep] if keep else known:
            path = self._path("_versions", f"{version:012d}.json")
            path.getFileSystem(self._conf).delete(path, False)
        for table in self._names():
            for commit in [] if table == "_versions" else self._names(table):
                if (table, commit) not in named:
                    path = self._path(table, commit)
                    path.getFileSystem(self._conf).delete(path, True)
                    gone += 1
        return gone


class Commit:
    """Changes of several tables that become visible together, by ``finish``."""

    def __init__(self, versions: Versions, base: Manifest):
        self.versions, self.base = versions, base
        self.now = Manifest(base.version, json.loads(json.dumps(base.tables)), dict(base.notes))
        self.id = uuid.uuid4().hex
        self._writes = 0

    def create(self, table: str, schema: T.StructType, key: str | list[str], buckets: int = 64) -> "Commit":
        """A table without rows, unless there is one. More rows want more buckets: a bucket is what an update rewrites."""
        spec = {"key": [key] if isinstance(key, str) else key, "buckets": buckets, "schema": schema.jsonValue(), "parts": {}}
        self.now.tables.setdefault(table, spec)
        return self

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table with what this commit has changed so far."""
        return self.versions.read(table, self.now, buckets)

    def of_keys(self, table: str, keys: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
        return self.versions.of_keys(table, keys, self.now, names)

    def _write(self, table: str, rows: DataFrame) -> tuple[str, list[str]]:
        """New folders with these rows: their commit's name and the buckets that got any."""
        spec = self.now.tables[table]
        schema = T.StructType.fromJson(spec["schema"])
        self._writes += 1
        name = f"{self.id}-{self._writes}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                   for f in schema.fields]
        # Rebalanced, not dealt by bucket alone: a bucket with one very frequent key is written by several tasks.
        (rows.select(*columns).withColumn(BUCKET, self.versions.bucket_of(spec)).hint("rebalance", BUCKET)
         .write.partitionBy(BUCKET).parquet(f"{self.versions.root}/{table}/{name}"))
        prefix = f"{BUCKET}="
        return name, [n.removeprefix(prefix) for n in self.versions._names(table, name) if n.startswith(prefix)]

    def append(self, table: str, rows: DataFrame) -> "Commit":
        """Add rows; no file of the table is rewritten."""
        name, buckets = self._write(table, rows)
        parts = self.now.tables[table]["parts"]
        for b in buckets:
            parts.setdefault(b, []).append(name)
        return self

    def change(self, table: str, keys: DataFrame, changed: Callable[[DataFrame], DataFrame], names: dict[str, str] | None = None) -> "Commit":
        """Rewrite the buckets of the given keys: ``changed`` gets their rows and gives what shall be there instead."""
        spec = self.now.tables[table]
        touched = self.versions.touched(spec, keys, names)
        if touched:
            name, buckets = self._write(table, changed(self.read(table, touched)))
            strange = set(buckets) - {str(b) for b in touched}
            if strange:
                raise ValueError(f"{table}: rows of other keys than the given ones in buckets {sorted(strange)}")
            for b in map(str, touched):
                spec["parts"].pop(b, None)
            for b in buckets:
                spec["parts"][b] = [name]
        return self

    def insert_new(self, table: str, rows: DataFrame, unique: str | None = None) -> "Commit":
        """Add the rows that are not stored, by the key or by another column that tells rows apart; one that comes twice is added once."""
        spec = self.now.tables[table]
        by = [unique] if unique else spec["key"]
        once = rows.dropDuplicates(by)
        stored = self.read(table, self.versions.touched(spec, once)).select(*by)
        return self.append(table, once.join(stored, by, "left_anti"))

    def note(self, name: str, value: int) -> "Commit":
        self.now.notes[name] = value
        return self

    def finish(self) -> Manifest:
        """Make all of it visible, or raise Conflict and leave the newest version as it is."""
        self.now.version = self.base.version + 1
        self.versions._publish(self.now.text(), f"{self.now.version:012d}.json")
        return self.now
