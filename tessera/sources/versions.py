"""Tables that change together: one manifest names the files of all, so a commit shows all of a change or none.

``root/data`` holds immutable folders; ``root/versions/<number>.json`` names, for every table, the
folder of each bucket of its key. A commit writes the rows of the buckets that change, then moves a
new manifest into place. That move refuses a number that exists, so of two writers
that began from one version the later one gets a ``Conflict`` and nothing of it is seen. A writer that dies leaves folders
that no manifest names; ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Change:
    """The new rows of a table's buckets; buckets None: of all. Rows of other buckets are refused at the write."""

    rows: DataFrame
    key: str
    buckets: list[int] | None = None


class Store:
    """Versioned tables in one folder, bucketed by the hash of a key column. ``buckets`` stays what it was first."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.count = spark, root.rstrip("/"), buckets
        self._held: list[str] = []
        found = self.manifest()
        if found["version"]:
            self.count = found["buckets"]

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        """What a version (None: the newest) holds."""
        numbers = [int(n[:-5]) for n in self._names(f"{self.root}/versions") if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "buckets": self.count, "tables": {}}
        number = max(numbers) if version is None else version
        p, fs = self._path(f"{self.root}/versions/{number:020d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.count)).cast("int")

    def buckets_of(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that rows fall in: at most the store's number."""
        return sorted(b for (b,) in rows.select(self.bucket(key)).distinct().collect())

    def table(self, name: str, buckets: list[int] | None = None, version: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
        """A table, or only some buckets of it; an unknown one is empty if a schema is given."""
        return self._read(self.manifest(version), name, buckets, schema)

    def _read(self, manifest: dict, name: str, buckets: list[int] | None, schema: T.StructType | str | None) -> DataFrame:
        held = manifest["tables"].get(name)
        if held is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        kind = T.StructType.fromJson(held["schema"])
        paths = sorted({p for b, p in held["files"].items() if buckets is None or int(b) in set(buckets)})
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/data/{p}" for p in paths]) if paths else self.spark.createDataFrame([], kind)

    def keep(self, df: DataFrame) -> DataFrame:
        """What a plan needs more than once, evaluated once: written beside the tables, as an embedder or a clock need not answer alike twice."""
        path = f"{self.root}/kept/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept = path
        self._held.append(path)
        return out

    def forget(self, but: list[DataFrame] | None = None) -> None:
        """Removes what ``keep`` wrote through this object, but for some tables."""
        spared = {df._kept for df in but or []}
        for path in [p for p in self._held if p not in spared]:
            p, fs = self._path(path)
            fs.delete(p, True)
        self._held = [p for p in self._held if p in spared]

    def _write(self, name: str, change: Change) -> tuple[dict[str, str], dict]:
        """(folder of each bucket that has rows, schema)."""
        folder = f"{name}-{uuid.uuid4().hex}"
        rows = change.rows.withColumn(BUCKET, self.bucket(change.key))
        if change.buckets is not None:
            rows = rows.withColumn(BUCKET, F.when(F.col(BUCKET).isin(change.buckets), F.col(BUCKET)).otherwise(F.raise_error(F.lit(f"a row of {name} is in no bucket that changes")).cast("int")))
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
        found = [n for n in self._names(f"{self.root}/data/{folder}") if n.startswith(f"{BUCKET}=")]
        return {n.split("=")[1]: f"{folder}/{n}" for n in found}, change.rows.schema.jsonValue()

    def commit(self, changes: dict[str, Change], base: int) -> int:
        """Makes the next version from ``base``: of each table the new rows of its buckets and the old ones of the others."""
        old = self.manifest()
        if old["version"] != base:
            raise Conflict(f"version {base} was read, {old['version']} is there")
        tables = dict(old["tables"])
        for name, change in changes.items():
            files, schema = self._write(name, change)
            kept = {} if change.buckets is None or name not in tables else {b: p for b, p in tables[name]["files"].items() if int(b) not in set(change.buckets)}
            tables[name] = {"files": {**kept, **files}, "schema": schema}
        self._publish({"version": base + 1, "buckets": self.count, "tables": tables})
        return base + 1

    def _publish(self, manifest: dict) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        staged, fs = self._path(f"{self.root}/staged/{uuid.uuid4().hex}.json")
        final, _ = self._path(f"{self.root}/versions/{manifest['version']:020d}.json")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.getFileSystem(conf).getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(final), no_options)
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is there") from e
            raise

    def update(self, plan: Callable[[Store, int], dict[str, Change]], tries: int = 5) -> int:
        """Commits what ``plan`` makes of the newest version, made anew from a newer one after a conflict."""
        for left in range(tries - 1, -1, -1):
            base = self.manifest()["version"]
            try:
                changes = plan(self, base)
                return self.commit(changes, base) if changes else base
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries is at least 1")

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest ``keep`` versions and the folders that none of them names; returns how many folders went.

        Not to be run while a commit is being written.
        """
        numbers = sorted(int(n[:-5]) for n in self._names(f"{self.root}/versions") if n.endswith(".json"))
        kept = numbers[-max(1, keep) :]
        used = {p.split("/")[0] for v in kept for t in self.manifest(v)["tables"].values() for p in t["files"].values()}
        for v in numbers[: len(numbers) - len(kept)]:
            p, fs = self._path(f"{self.root}/versions/{v:020d}.json")
            fs.delete(p, False)
        gone = [n for n in self._names(f"{self.root}/data") if n not in used]
        for n in gone:
            p, fs = self._path(f"{self.root}/data/{n}")
            fs.delete(p, True)
        return len(gone)
