"""Files: CSV updates, session JSON, metric logs, delimited exports, Arrow."""

from __future__ import annotations

import io
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandect.functions.citations import without_bom
from pandect.operators.changes import merged

#: Events of the metric log. Durations are in microseconds.
METRIC = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("measurements", T.MapType(T.StringType(), T.LongType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A CSV export with its header: ``columns`` maps names in the file to names
    here; headers the file lacks give null columns, a byte-order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = {c.lstrip("﻿").strip(): c for c in df.columns}
    return df.select(*[(without_bom(F.col(f"`{clean[a]}`")) if a in clean else F.lit(None).cast("string")).alias(b) for a, b in columns.items()])


def update_from_csv(state: DataFrame, csv: DataFrame, key: str = "name") -> DataFrame:
    """State with the non-empty values of a CSV written over it, for known keys."""
    shared = [c for c in csv.columns if c != key and c in state.columns]
    kinds = dict(state.dtypes)
    known = csv.join(state.select(key), key, "left_semi")
    new = known.select(key, *[F.expr(f"try_cast(`{c}` as {kinds[c]})").alias(c) if c in shared else F.lit(None).cast(kinds[c]).alias(c) for c in state.columns if c != key])
    return merged(state, new, [key], "overwrite_non_empty")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents that may span lines; broken ones give null rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, folder: str) -> None:
    """Append events to the log, one folder per day."""
    df.withColumn("day", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("day").json(folder)


def read_metrics(spark: SparkSession, folder: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """Events of the log; the day of a bound prunes folders, the rest is filtered."""
    df = spark.read.schema(T.StructType([*METRIC, T.StructField("day", T.StringType())])).json(folder)
    if after is not None:
        df = df.where((F.col("day") >= after[:10]) & (F.col("timestamp") > after))
    if before is not None:
        df = df.where((F.col("day") <= before[:10]) & (F.col("timestamp") < before))
    return df


def metric_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days that the log has, newest first."""
    return read_metrics(spark, folder).select("day").distinct().orderBy(F.desc("day"))


def clear_metrics(spark: SparkSession, folder: str, day: str | None = None) -> bool:
    """Drop one day of the log, or all of it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder if day is None else f"{folder}/day={day}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_delimited(df: DataFrame, path: str, other_columns: Sequence[str] | None = None, sep: str = "\t") -> list[str]:
    """Export the columns that both sides have, in this side's order; nested
    values are written as JSON. Returns the columns."""
    shared = [c for c in df.columns if other_columns is None or c in set(other_columns)]
    kinds = dict(df.dtypes)
    cols = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in shared]
    df.select(*cols).write.mode("overwrite").option("sep", sep).option("header", True).option("nullValue", "\\N").csv(path)
    return shared


def arrow_bytes(df: DataFrame, int32: Sequence[str] = ()) -> bytes:
    """A result of bounded size as an Arrow stream, named columns as 32-bit integers.
    For answers to a client; tables are exported with ``write_delimited`` or Parquet."""
    table = df.select(*[F.col(c).cast("int") if c in set(int32) else F.col(c) for c in df.columns]).toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def from_arrow_bytes(spark: SparkSession, payload: bytes, first_only: bool = False) -> DataFrame:
    """Rows of an Arrow stream; broken payloads raise ``pyarrow.ArrowInvalid``."""
    table = pa.ipc.open_stream(payload).read_all()
    return spark.createDataFrame(table.slice(0, 1) if first_only else table)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def answer(df: DataFrame, form: str, int32: Sequence[str] = ()) -> bytes | list[str]:
    """A query's answer in the form that is asked for."""
    if form == "arrow":
        return arrow_bytes(df, int32)
    if form == "json":
        return [r["value"] for r in as_json(df).collect()]
    raise ValueError(form)
