"""A keyed table of which a batch rewrites only what it touches.

Rows lie in buckets by a hash of their key. A merge reads the current files of
the batch's buckets, reduces them with the batch, and writes those buckets as a
new version; a manifest, written last of all, names the version of each bucket.
So readers see a whole batch or none of it, a run that dies leaves the table as it
was, and a batch that comes again changes nothing. What a merge costs grows with
the batch's buckets, not with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from handbill.sources.storage import discard, file_system, kept

MANIFEST = "bucket int, version int, batch long"


class BucketedTable:
    """Rows at ``path`` by ``key``, in ``buckets`` buckets; the number must stay the same for the table's life."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """The whole versions, oldest first."""
        at, files = file_system(self.spark, f"{self.path}/manifest/version=*/_SUCCESS")
        return sorted(int(str(f.getPath().getParent().getName()).removeprefix("version=")) for f in files.globStatus(at) or [])

    def manifest(self, version: int | None = None) -> dict[int, tuple[int, int]]:
        """bucket: (version of its files, last batch); a row a bucket at most. Empty before the first merge."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={known[-1] if version is None else version}")
        return {r.bucket: (r.version, r.batch) for r in rows.collect()}

    def files(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/version={version}/_bucket={bucket}"

    def merge(self, batch: DataFrame, reduce: Callable[[DataFrame], DataFrame], batch_id: int) -> set[int]:
        """Brings a batch in; the buckets that were rewritten. ``reduce`` gives a row a key, or fewer, and must not mind rows that it has seen."""
        current = self.manifest()
        if current and batch_id <= max(b for _, b in current.values()):
            return set()
        staged = kept(batch.withColumn("_bucket", self.bucket_of()))
        touched = {r[0] for r in staged.select("_bucket").distinct().collect()}
        if not touched:
            return touched
        before = [self.files(current[b][0], b) for b in touched if b in current]
        rows = staged.drop("_bucket")
        if before:
            rows = self.spark.read.schema(rows.schema).parquet(*before).unionByName(rows)
        version = (self.versions() or [0])[-1] + 1
        # Keys are spread within a bucket, so that few buckets are no few tasks.
        spread = reduce(rows).withColumn("_bucket", self.bucket_of())
        spread.repartition(F.col("_bucket"), F.pmod(F.hash(self.key), F.lit(4))).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/version={version}")
        told = [(b, version, batch_id) if b in touched else (b, *current[b]) for b in sorted(touched | current.keys())]
        self.spark.createDataFrame(told, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")
        return touched

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless told otherwise."""
        parts = [self.files(v, b) for b, (v, _) in sorted(self.manifest(version).items())]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes the files and manifests that none of the newest ``keep`` versions needs; their folders."""
        known = self.versions()
        old = known[:-keep]
        if not old:
            return []
        wanted = {self.files(v, b) for version in known[-keep:] for b, (v, _) in self.manifest(version).items()}
        gone = sorted({self.files(v, b) for version in old for b, (v, _) in self.manifest(version).items()} - wanted)
        for folder in [*gone, *(f"{self.path}/manifest/version={v}" for v in old)]:
            discard(self.spark, folder)
        return gone
