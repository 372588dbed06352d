"""Tables that grow by whole batches, and tables that take upserts, on plain Parquet folders.

An import has two steps. ``stage`` writes a batch aside, where it can be read
back for a preview; ``confirm`` writes those of its rows that the table does
not hold yet, then one marker of a single file. Readers take only batches that
have a marker, so a batch is seen whole or not at all, whenever a job dies; both
steps may be run again and give the same table. Batches are confirmed one at a
time; a batch that is staged for good is ignored.

A ``Snapshot`` is such a table whose batches are versions of buckets of a key's
hash: an upsert reads and rewrites the buckets that its keys fall into, and
readers take each bucket at its last version with a marker. Old versions stay
readable for queries that run, until ``vacuum``.

All paths go through Spark, so any store it reads will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folder(batch: str) -> str:
    return f"batch=id-{batch}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Batches:
    """An append-only table at ``path``; ``key``: the columns that tell a row from all others."""

    path: str
    key: tuple[str, ...]

    def stage(self, rows: DataFrame, batch: str) -> None:
        """Writes a batch aside, over what was staged under its name."""
        rows.write.mode("overwrite").parquet(f"{self.path}/staged/{_folder(batch)}")

    def staged(self, spark: SparkSession, batch: str) -> DataFrame:
        """A staged batch, each row with ``is_duplicate``: the table, or an earlier place of the batch, holds its key."""
        rows = spark.read.parquet(f"{self.path}/staged/{_folder(batch)}")
        content = F.xxhash64(*rows.columns)  # of rows with one key the first in this order is the new one
        repeat = F.row_number().over(Window.partitionBy(*self.key).orderBy(content, *[c for c, kind in rows.dtypes if not kind.startswith("map")])) > 1
        rows = rows.withColumn("is_duplicate", repeat)
        known = self.read(spark, besides=batch)
        if known is None:
            return rows
        held = known.select(*self.key).distinct().withColumn("held", F.lit(True))
        met = rows.alias("r").join(held.alias("h"), [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in self.key], "left")
        return met.select(*[f"r.{c}" for c in rows.columns if c != "is_duplicate"], (F.col("is_duplicate") | F.col("held").isNotNull()).alias("is_duplicate"))

    def discard(self, spark: SparkSession, batch: str) -> None:
        remove(spark, f"{self.path}/staged/{_folder(batch)}")

    def confirm(self, spark: SparkSession, batch: str) -> None:
        """The new rows of a staged batch become part of the table; once only, however often it is called."""
        if self.committed(spark, batch):
            return
        target = f"{self.path}/rows/{_folder(batch)}"
        self.staged(spark, batch).where(~F.col("is_duplicate")).drop("is_duplicate").write.mode("overwrite").parquet(target)
        self._mark(spark, batch)

    def _mark(self, spark: SparkSession, batch: str) -> None:
        # one row in one file: its rename is the moment of commit
        spark.range(1).select(F.lit(batch).alias("name")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{_folder(batch)}")

    def committed(self, spark: SparkSession, batch: str) -> bool:
        names = self._commits(spark)
        return names is not None and bool(names.where(F.col("name") == batch).head(1))

    def _commits(self, spark: SparkSession) -> DataFrame | None:
        path = f"{self.path}/commits"
        return spark.read.schema("name string, batch string").parquet(path) if exists(spark, path) else None

    def read(self, spark: SparkSession, besides: str | None = None) -> DataFrame | None:
        """The committed rows; None before the first commit. Batches without a marker are pruned as partitions."""
        names = self._commits(spark)
        if names is None or not names.head(1):
            return None
        rows = spark.read.parquet(f"{self.path}/rows")
        seen = names.select("batch").distinct() if besides is None else names.where(F.col("name") != besides).select("batch").distinct()
        return rows.join(seen, "batch", "left_semi").drop("batch")


@dataclass(frozen=True)
class Rewritten:
    """What an upsert wrote: its version, the buckets and the bytes of theirs and of the whole table before."""

    version: int
    buckets: int
    bytes_read: int
    bytes_before: int


@dataclass(frozen=True)
class Snapshot:
    """A table of one row for each ``key`` at ``path``, in ``buckets`` parts by the hash of ``by`` (a part of the key; all of it by default)."""

    path: str
    key: tuple[str, ...]
    buckets: int = 64
    by: tuple[str, ...] = ()

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*(self.by or self.key)), F.lit(self.buckets)).cast("int")

    def _latest(self, spark: SparkSession) -> DataFrame | None:
        """(bucket, version): the last committed version of each bucket, one row for each bucket."""
        path = f"{self.path}/commits"
        if not exists(spark, path):
            return None
        marks = spark.read.schema(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])).parquet(path)
        return marks.groupBy("bucket").agg(F.max("version").alias("version"))

    def _next(self, spark: SparkSession) -> int:
        latest = self._latest(spark)
        return 1 + ((latest.agg(F.max("version")).first()[0] or 0) if latest is not None else 0)

    def _commit(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        spark = rows.sparkSession
        target = f"{self.path}/rows/version={version}"
        # one task for each bucket at least; what a job that died has left is overwritten
        rows.withColumn("bucket", self._bucket()).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={version}")

    def create(self, rows: DataFrame) -> None:
        """The first version; every bucket counts as written."""
        self._commit(rows, self._next(rows.sparkSession), list(range(self.buckets)))

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The rows; of some buckets only, if these are named. Other partitions are not read."""
        latest = self._latest(spark)
        latest = latest if buckets is None else latest.where(F.col("bucket").isin(buckets))
        rows = spark.read.parquet(f"{self.path}/rows")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.join(F.broadcast(latest), ["version", "bucket"], "left_semi").drop("version", "bucket")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that these rows' keys fall into; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def files(self, spark: SparkSession, buckets: list[int] | None = None) -> int:
        """Bytes of the files that hold the rows now."""
        latest = self._latest(spark)
        rows = spark.read.parquet(f"{self.path}/rows")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        held = rows.select("version", "bucket", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).join(F.broadcast(latest), ["version", "bucket"], "left_semi")
        return held.select("file", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def replace(self, spark: SparkSession, rows: DataFrame, touched: list[int]) -> Rewritten:
        """These rows become all there is of the named buckets."""
        version, before, read = self._next(spark), self.files(spark), self.files(spark, touched)
        self._commit(rows, version, touched)
        return Rewritten(version, len(touched), read, before)

    def upsert(self, changes: DataFrame, gone: DataFrame | None = None) -> Rewritten:
        """Rows replace those of their key or are added; keys of ``gone`` go. A key stands once in ``changes``."""
        spark = changes.sparkSession
        keys = changes.select(*self.key) if gone is None else changes.select(*self.key).union(gone.select(*self.key))
        touched = self.touched(keys)
        kept = self.read(spark, touched).join(keys, list(self.key), "left_anti")
        if gone is not None:
            changes = changes.join(gone.select(*self.key), list(self.key), "left_anti")
        return self.replace(spark, kept.unionByName(changes), touched)

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes versions that no bucket uses any more; how many."""
        used = {r.version for r in self._latest(spark).select("version").distinct().collect()}
        old = [v for v in range(1, self._next(spark)) if v not in used and exists(spark, f"{self.path}/rows/version={v}")]
        for version in old:
            remove(spark, f"{self.path}/rows/version={version}")
        return len(old)
