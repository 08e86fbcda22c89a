"""A table of the latest row of each key, written by upserts and read as one version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that are kept for readers that began with one of them.
KEPT_VERSIONS = 3


class LatestTable:
    """Keyed rows in buckets of keys. An upsert writes the buckets that it touches anew, as parts of its own, and then a commit marker.

    A marker names for each bucket the version that wrote it last. A reader takes the newest marker and reads just the parts it names: one version, a row for
    each key. What a batch wrote that failed before its marker is never read, and is written over when the batch runs again. A batch
    whose marker stands is passed over. One writer at a time is assumed, as a stream is.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.order, self.schema, self.buckets = spark, path.rstrip("/"), keys, order, schema, buckets

    def _fs(self, path: str) -> tuple[object, object]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        fs, where = self._fs(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()) if fs.exists(where) else []

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Which version wrote each bucket last, as of a committed version; of the newest, if none is given."""
        have = self.versions()
        if not have:
            return {}
        fs, where = self._fs(f"{self.path}/commits/{have[-1] if version is None else version}")
        stream = fs.open(where)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _parts(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/parts/version={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The latest row of each key, as of the newest committed version or a given one."""
        return self._parts(self.manifest(version))

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Put a batch's rows in place of the older ones of their keys: of several rows of a key that with the greatest ``order`` stays, the batch's in a tie."""
        if number in self.versions():
            return
        now = self.manifest()
        columns = [c.split(" ")[0] for c in self.schema.split(", ")]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = batch.select(*columns).withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most as many as there are buckets
            old = self._parts({b: now[b] for b in touched if b in now}).withColumn("bucket", bucket)
            both = old.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
            rest = [c for c in columns if c not in self.keys]
            latest = both.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.order, "_new")).alias("r")).select("bucket", *self.keys, "r.*")
            latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/parts/version={number}")
        finally:
            batch.unpersist()
        self._commit(number, now | dict.fromkeys(touched, number))

    def _commit(self, number: int, manifest: dict[int, int]) -> None:
        """Write the marker under another name and rename it, so that it is there as a whole or not at all; then drop parts that no kept version names."""
        fs, temporary = self._fs(f"{self.path}/commits/.{number}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(temporary, self._fs(f"{self.path}/commits/{number}")[1]):
            raise OSError(f"version {number} couldn't be committed at {self.path}")
        have = self.versions()
        named = {(v, b) for kept in have[-KEPT_VERSIONS:] for b, v in self.manifest(kept).items()}
        for old in have[:-KEPT_VERSIONS]:
            was = self.manifest(old)
            for b, v in was.items():
                if (v, b) not in named:
                    fs.delete(self._fs(f"{self.path}/parts/version={v}/bucket={b}")[1], True)
            fs.delete(self._fs(f"{self.path}/commits/{old}")[1], False)
