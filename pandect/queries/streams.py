"""Change streams run to their end over the events table, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandect.plans.cut import shared_folder
from pandect.sources.tables import table
from pandect.streaming import changelog as S

_STATE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField(S.OFFSET, T.LongType())])


def _messages(df):
    """Events as messages: signups insert, errors delete, the rest update."""
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return df.select("user_id", "event_type", "value", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias(S.OFFSET), kind.alias("operation"))


def _merge_stream(spark, d):
    """The events table as a stream of files, followed until it has been read; then
    played again from the start with another checkpoint, which changes nothing."""
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = f"{d.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(source).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    where, pattern = (source, "*.parquet") if folder else (d, "events.parquet")
    state = S.VersionedTable(spark, f"{place}/table", _STATE, "user_id", 8)
    for run in ("first", "again"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 4).parquet(where)
        S.follow(_messages(stream), state, f"{place}/checkpoint-{run}").awaitTermination()
    return state.read().select("user_id", "event_type", "value")


def _counts(spark, d):
    messages = _messages(table(spark, d, "events")).withColumn("at", F.col(S.OFFSET))
    empty = spark.createDataFrame([], "user_id bigint, n bigint, latest bigint")
    half = F.expr("user_id % 2 = 0")
    first = S.add_counts(empty, messages.where(half), "user_id", "at")
    return S.add_counts(first, messages.where(~half), "user_id", "at")


def _enrich(spark, d):
    state = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    messages = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("offset"))
    return S.enrich(state, messages, "c_custkey", ["c_acctbal"])


def _counters(spark, d):
    """Counters of a batch that come with its rows as they are written."""
    df, seen = S.counted(_messages(table(spark, d, "events")), f"counters-{uuid.uuid4().hex}")
    df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["control"])], "rows bigint, control bigint")


QUERIES = {
    "batch_counters": _counters,
    "changelog_merge": _merge_stream,
    "changelog_latest": lambda spark, d: S.latest(_messages(table(spark, d, "events")), "user_id", S.OFFSET).select("user_id", "event_type", "value"),
    "incremental_counts": _counts,
    "enrich_state": lambda spark, d: _enrich(spark, d)[0],
    "enrich_unknown": lambda spark, d: _enrich(spark, d)[1].select("c_custkey", "offset"),
    "notifications": lambda spark, d: S.notify(_messages(table(spark, d, "events")), "events"),
}

_M = "m AS (SELECT *, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation FROM events)"
ORACLE = {
    "batch_counters": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS control FROM events",
    "changelog_merge": f"WITH {_M} SELECT user_id, event_type, value FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) WHERE operation <> 'delete'",
    "changelog_latest": "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1",
    "incremental_counts": f"WITH {_M} SELECT user_id, CAST(sum(CASE operation WHEN 'delete' THEN -1 WHEN 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS n, max(CASE WHEN operation <> 'delete' THEN epoch_us(ts) END) AS latest FROM m GROUP BY 1 HAVING sum(CASE operation WHEN 'delete' THEN -1 WHEN 'insert' THEN 1 ELSE 0 END) > 0",
    "enrich_state": "WITH m AS (SELECT o_custkey * 2 AS k, o_totalprice AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT c_custkey, c_name, coalesce(p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN m ON k = c_custkey",
    "enrich_unknown": "SELECT o_custkey * 2 AS c_custkey, o_orderkey AS \"offset\" FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "notifications": f"WITH {_M} SELECT operation AS action, count(*) AS rows, 'events' AS table_name FROM m GROUP BY 1",
}
