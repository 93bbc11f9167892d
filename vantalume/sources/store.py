"""Collections of vectors as versioned Parquet folders, dealt to buckets by a hash of the id.

A version is a manifest: of each bucket, the folders that hold its rows. The current version is the highest manifest, which is renamed
into place last, so a replacement becomes visible at once, and a failed write never does. Appends add folders; an upsert writes the new rows
once and rewrites only the buckets that they touch. Everything goes through Hadoop's file systems: any path that Spark can
write serves. One writer at a time is assumed for each collection.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import removed

COLLECTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("collection_id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType(), False)), T.StructField("path", T.StringType()), T.StructField("timestamp", T.DoubleType())])
BUCKETS = 64
#: A bucket is rewritten once it has more folders than this.
MOST_FOLDERS = 16


class Store:
    """A folder opened as a set of collections; it is made if it is absent."""

    def __init__(self, spark: SparkSession, db_path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.db_path, self.buckets = spark, str(db_path).rstrip("/"), buckets
        self._fs(self.db_path)[0].mkdirs(self._fs(self.db_path)[1])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write_text(self, name: str, text: str) -> None:
        """A small file of the store, complete or absent."""
        fs, part = self._fs(f"{self.db_path}/{name}.part")
        out = fs.create(part, True)
        out.write(text.encode())
        out.close()
        if not fs.rename(part, self._fs(f"{self.db_path}/{name}")[1]):
            raise FileExistsError(f"{self.db_path}/{name} exists")

    def read_text(self, name: str) -> str:
        fs, p = self._fs(f"{self.db_path}/{name}")
        source = fs.open(p)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def read_json(self, name: str, schema: str) -> DataFrame:
        """All JSON files of a folder of the store."""
        there = any(x.endswith(".json") for x in self._names(f"{self.db_path}/{name}"))
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.db_path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[1:-5]) for v in self._names(f"{self.db_path}/{name}") if v.startswith("v") and v.endswith(".json"))

    def _manifest(self, name: str, version: int | None = None) -> dict[str, list[str]]:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no collection {name!r} in {self.db_path}")
        return json.loads(self.read_text(f"{name}/v{versions[-1] if version is None else version:09d}.json"))

    def _commit(self, name: str, manifest: dict[str, list[str]]) -> None:
        self.write_text(f"{name}/v{(self._versions(name) or [-1])[-1] + 1:09d}.json", json.dumps(manifest))

    def _write(self, name: str, rows: DataFrame, part: str) -> dict[str, list[str]]:
        """Rows as a folder of bucket folders, which no reader of a folder above sees; of each bucket that has rows, its folder."""
        folder = f"_d{(self._versions(name) or [-1])[-1] + 1:09d}-{part}"
        path = f"{self.db_path}/{name}/{folder}"
        removed(self.spark, path)  # of a write that failed
        # adaptive execution splits a bucket that is too large for one task
        dealt = rows.withColumn("bucket__", F.pmod(F.xxhash64("id"), F.lit(self.buckets))).hint("rebalance", "bucket__")
        dealt.write.partitionBy("bucket__").parquet(path)
        return {b.split("=")[1]: [f"{folder}/{b}"] for b in self._names(path) if b.startswith("bucket__=")}

    def _read(self, name: str, folders: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.db_path}/{name}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def list(self) -> list[str]:
        return [n for n in self._names(self.db_path) if not n.startswith("_") and self._versions(n)]

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def open(self, name: str, schema: T.StructType = COLLECTION) -> DataFrame:
        return self._read(name, [f for fs in self._manifest(name).values() for f in fs], schema)

    def create(self, name: str, schema: T.StructType = COLLECTION) -> DataFrame:
        """An empty collection, unless it exists."""
        if not self.exists(name):
            self._commit(name, {})
        return self.open(name, schema)

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """A new version; readers of the old one aren't disturbed."""
        self._commit(name, self._write(name, rows, "all"))

    def append(self, name: str, rows: DataFrame) -> None:
        self.create(name, rows.schema)
        old, new = self._manifest(name), self._write(name, rows, "new")
        self._commit(name, old | {b: old.get(b, []) + new[b] for b in new})
        self._compact(name, rows.schema)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of equal id and are added otherwise. They are computed once; only buckets that they touch are read and rewritten."""
        self.create(name, rows.schema)
        old, new = self._manifest(name), self._write(name, rows, "new")
        touched = [f for b in new for f in old.get(b, [])]
        kept = {}
        if touched:
            written = self._read(name, [f for fs in new.values() for f in fs], rows.schema)
            kept = self._write(name, self._read(name, touched, rows.schema).join(written.select("id"), "id", "left_anti").select(*rows.columns), "kept")
        self._commit(name, old | {b: kept.get(b, []) + new[b] for b in new})

    def _compact(self, name: str, schema: T.StructType) -> None:
        """Rewrite the buckets that many appends have spread over many folders."""
        manifest = self._manifest(name)
        spread = {b: fs for b, fs in manifest.items() if len(fs) > MOST_FOLDERS}
        if spread:
            self._commit(name, manifest | self._write(name, self._read(name, [f for fs in spread.values() for f in fs], schema), "compact"))

    def count(self, name: str) -> int:
        return self.open(name).count()

    def counts(self) -> DataFrame:
        """(collection, n) of all collections; only files' row counts are read."""
        return self.spark.createDataFrame([(name, self.count(name)) for name in self.list()], "collection string, n bigint")

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Remove all but the last versions, and the folders that only they name."""
        versions = self._versions(name)
        used = {f.split("/")[0] for v in versions[-keep:] for fs in self._manifest(name, v).values() for f in fs}
        for v in versions[:-keep]:
            removed(self.spark, f"{self.db_path}/{name}/v{v:09d}.json")
        for folder in self._names(f"{self.db_path}/{name}"):
            if folder.startswith("_d") and folder not in used:
                removed(self.spark, f"{self.db_path}/{name}/{folder}")


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in the place of those of equal keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def conflicts(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys of new that old has; only the key column is read."""
    return new.select(key).join(old.select(key), key, "left_semi")


def check_dim(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """df; a row whose vector has another length fails the job."""
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"expected vectors of length {dim}, got "), F.size(vector).cast("string")))))
