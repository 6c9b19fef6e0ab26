"""Change streams: filtered changelogs, enrichment, incremental counts.

A table is kept in buckets of its keys. A micro-batch writes anew only the
buckets that its keys fall into, below a new version, and then a manifest that
names the version of every bucket: so a batch costs what it touches, one that
fails or is played again leaves no half-written state, and readers see whole
versions. The last applied offset of a key is part of its row, deleted keys
keep theirs as tombstones, and only that decides what a message changes: a
batch, a checkpoint that was lost, or a whole stream may be played again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

OFFSET = "__offset"
DELETED = "__deleted"
BUCKETS = 64


class VersionedTable:
    """Parquet buckets below a folder, and manifests of whole versions."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self.stored = T.StructType([*schema, T.StructField(DELETED, T.BooleanType())])
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self._fs.exists(self._path(name)) else []

    def version(self) -> int:
        """The current version, -1 before the first."""
        return max([int(n.removeprefix("manifest-")) for n in self._names() if n.startswith("manifest-")], default=-1)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Version of every bucket that has rows."""
        v = self.version() if version is None else version
        if v < 0 or not self._fs.exists(self._path(f"manifest-{v}")):
            return {}
        stream = self._fs.open(self._path(f"manifest-{v}"))
        try:
            text = bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {int(b): n for b, n in json.loads(text).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read_stored(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows with tombstones, of some buckets or of all."""
        paths = [f"{self.folder}/v={n}/__bucket={b}" for b, n in self.manifest().items() if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def read(self) -> DataFrame:
        return self.read_stored().where(~F.col(DELETED)).drop(DELETED)

    def touched(self, messages: DataFrame) -> list[int]:
        """Buckets of the messages' keys: at most ``buckets`` numbers."""
        return [r[0] for r in messages.select(self.bucket().alias("b")).distinct().collect()]

    def write(self, rows: DataFrame, touched: list[int], keep: int = 2) -> int:
        """A new version in which the touched buckets hold ``rows`` and all others
        what they held; buckets that no manifest of the last ``keep`` names go."""
        v = self.version() + 1
        rows.withColumn("__bucket", self.bucket()).repartition(max(1, len(touched)), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.folder}/v={v}")
        made = {int(n.removeprefix("__bucket=")): v for n in self._names(f"v={v}") if n.startswith("__bucket=")}
        now = {b: n for b, n in self.manifest().items() if b not in set(touched)} | made
        out = self._fs.create(self._path(f"new-{v}"), True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self._fs.rename(self._path(f"new-{v}"), self._path(f"manifest-{v}"))
        self._forget(v, keep)
        return v

    def _forget(self, version: int, keep: int) -> None:
        kept = range(max(0, version - keep + 1), version + 1)
        used = {item for k in kept for item in self.manifest(k).items()}
        for name in self._names():
            kind, _, n = name.partition("-") if name.startswith("manifest-") else name.partition("=")
            if kind == "manifest" and int(n) not in kept:
                self._fs.delete(self._path(name), True)
            elif kind == "v" and int(n) <= version:
                for b in [x for x in self._names(name) if x.startswith("__bucket=") and (int(x.removeprefix("__bucket=")), int(n)) not in used]:
                    self._fs.delete(self._path(f"{name}/{b}"), True)


def latest(messages: DataFrame, key: str, offset: str) -> DataFrame:
    """The last message of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(offset).desc()))
    return messages.withColumn("__r", rank).where("__r = 1").drop("__r")


def apply_stored(state: DataFrame, messages: DataFrame, key: str, offset: str = OFFSET, operation: str = "operation") -> DataFrame:
    """State with tombstones (``DELETED``) after a batch: inserts and updates
    replace, deletes leave a tombstone, control messages (without operation) and
    offsets already seen change nothing."""
    known = state.select(F.col(key), F.col(offset).alias("__seen"))
    data = messages.where(F.col(operation).isin("insert", "update", "delete") & F.col(key).isNotNull())
    new = latest(data, key, offset).join(known, key, "left").where(F.col("__seen").isNull() | (F.col(offset) > F.col("__seen"))).drop("__seen")
    new = new.withColumn(DELETED, F.col(operation) == "delete")
    return state.join(new.select(key), key, "left_anti").unionByName(new.select(*state.columns))


def apply_messages(state: DataFrame, messages: DataFrame, key: str, offset: str = OFFSET, operation: str = "operation") -> DataFrame:
    """State after a batch, without tombstones on either side."""
    after = apply_stored(state.withColumn(DELETED, F.lit(False)), messages, key, offset, operation)
    return after.where(~F.col(DELETED)).drop(DELETED)


def follow(stream: DataFrame, table: VersionedTable, checkpoint: str, predicate: Column | None = None, **trigger) -> StreamingQuery:
    """Keep a table in step with a changelog. The predicate belongs to the
    stream: another one needs another table and checkpoint. A row that no longer
    meets the predicate counts as deleted."""
    meets = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    left = F.col("operation").isin("insert", "update") & ~meets
    shaped = stream.withColumn("operation", F.when(left, "delete").otherwise(F.col("operation")))

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.where(F.col("operation").isNotNull() & F.col(table.key).isNotNull()).persist()
        try:
            if touched := table.touched(df):
                table.write(apply_stored(table.read_stored(touched), df, table.key), touched)
        finally:
            df.unpersist()

    return shaped.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def enrich(state: DataFrame, messages: DataFrame, key: str, fields: list[str], offset: str = "offset") -> tuple[DataFrame, DataFrame]:
    """(state with the fields of each law's last message, messages of unknown laws)."""
    last = latest(messages.where(F.col(key).isNotNull()), key, offset)
    new = last.select(key, F.lit(True).alias("__hit"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = state.join(new, key, "left")
    out = joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in state.columns])
    return out, messages.join(state.select(key), key, "left_anti")


def add_counts(counts: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """Counts per key (``key, n, latest``) after a batch of inserts and deletes.
    ``latest`` is a high-water mark: deletes don't lower it."""
    sign = F.when(F.col("operation") == "delete", -1).when(F.col("operation") == "insert", 1).otherwise(0)
    new = batch.groupBy(key).agg(F.sum(sign).alias("n"), F.max(F.when(F.col("operation") != "delete", F.col(at))).alias("latest"))
    return counts.select(key, "n", "latest").unionByName(new).groupBy(key).agg(F.sum("n").cast("bigint").alias("n"), F.max("latest").alias("latest")).where("n > 0")


def notify(batch: DataFrame, table: str, action: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """One notification per batch and operation, to be written by the caller."""
    kind = F.col("operation") if action is None else action(batch)
    return batch.groupBy(kind.alias("action")).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(table))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows, and those without operation, as it is read:
    the counters cost no pass of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("operation").isNull()).alias("control")), seen
