"""Tables kept in hash buckets under a manifest: whole keys are replaced by copying the buckets they lie in.

A folder holds versions, numbered files ``_manifest/<version>.json`` that name, for each table and bucket, the folder with its
rows. A change writes the buckets that it touches to new folders and then one manifest, made under another name and
renamed, which fails if that version is there already: readers see the old state or the new one, never a part of it, and of two
writers at a time one is told to try again. The number of files follows the buckets and the bytes, not the keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has set the next version in the meantime."""


class Store:
    """Tables in one folder that change together; ``keys`` say which rows are replaced, the first of them deals the buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place = self._path(f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, buckets, tables: {name: {schema, folders: {bucket: folder}}}} of a version, by default the last."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        stream = self._fs.open(self._path(f"{self.path}/_manifest/{version:010d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a table; of one that isn't there none, if a schema (DDL) is given."""
        found = self.manifest(version)["tables"].get(table)
        if found is None:
            if schema is None:
                raise ValueError(f"no table {table} in {self.path}")
            return self.spark.createDataFrame([], schema)
        return self._rows(found, found["folders"])

    def _rows(self, table: dict, buckets: Iterable[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(table["schema"])
        folders = sorted({table["folders"][b] for b in buckets})
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, many: int) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(many)).cast("int")

    def replace(self, gone: DataFrame, tables: dict[str, DataFrame]) -> int:
        """Replaces, in each of the tables, all rows whose keys ``gone`` holds by the given ones; returns the version.

        ``gone`` may hold keys without new rows: they are deleted. New rows whose keys it lacks are an error. Rows of one
        bucket that are too many for one task are split (rebalance), so a hot key isn't one task's.
        """
        old = self.manifest()
        many = old["buckets"]
        gone = gone.select(*self.keys).distinct().cache()
        try:
            touched = sorted(str(r.b) for r in gone.select(self.bucket(many).alias("b")).distinct().collect())  # as many as buckets at most
            new = {"version": old["version"] + 1, "buckets": many, "tables": {n: {"schema": t["schema"], "folders": dict(t["folders"])} for n, t in old["tables"].items()}}
            for name, rows in tables.items():
                if not rows.join(gone, self.keys, "left_anti").isEmpty():
                    raise ValueError(f"rows of {name} with keys that aren't replaced")
                had = new["tables"].get(name, {"schema": json.loads(rows.schema.json()), "folders": {}})
                stays = self._rows(had, [b for b in touched if b in had["folders"]]).join(gone, self.keys, "left_anti")
                whole = stays.unionByName(rows.select(*stays.columns)).withColumn("_bucket", self.bucket(many))
                folder = f"data/{name}-{uuid.uuid4().hex}"
                whole.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                place = self._path(f"{self.path}/{folder}")
                written = {s.getPath().getName().split("=")[1] for s in self._fs.listStatus(place) if "=" in s.getPath().getName()}
                for b in touched:
                    had["folders"].pop(b, None)
                had["folders"] |= {b: f"{folder}/_bucket={b}" for b in written}
                new["tables"][name] = had
            self._commit(new)
        finally:
            gone.unpersist()
        return new["version"]

    def _commit(self, manifest: dict) -> None:
        folder = f"{self.path}/_manifest"
        self._fs.mkdirs(self._path(folder))
        made = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"{folder}/{manifest['version']:010d}.json")
        if self._fs.exists(target) or not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what only versions before the last ``keep`` need; the number of folders deleted. Not while someone writes."""
        known = self.versions()
        used = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        data, gone = self._path(f"{self.path}/data"), 0
        for write in self._fs.listStatus(data) if self._fs.exists(data) else []:
            place = f"data/{write.getPath().getName()}"
            parts = [s.getPath() for s in self._fs.listStatus(write.getPath()) if "=" in s.getPath().getName()]
            unused = [p for p in parts if f"{place}/{p.getName()}" not in used]
            gone += sum(bool(self._fs.delete(p, True)) for p in unused)
            if len(unused) == len(parts):
                self._fs.delete(write.getPath(), True)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_manifest/{v:010d}.json"), False)
        return gone
