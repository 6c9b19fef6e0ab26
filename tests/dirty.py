"""Tables with nulls in every column, repeated rows, and columns whose names clash."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SMALL

CLASHING = ["size", "n", "kind", "total", "segment", "core", "item", "entry", "node", "parent", "h", "slot", "mask", "snapshot", "letters", "shard", "posterior", "share", "cuts", "offset", "verdict", "measure", "length"]


def write_dirty(spark, folder: str, tables: list[str], empty: bool = False) -> str:
    for t in tables:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if empty:
            df = df.limit(0)
        cut = [F.when(F.rand(7 * i + 1) < 0.25, F.lit(None)).otherwise(F.col(c)).alias(c) for i, c in enumerate(df.columns)]
        out = df.select(*cut).union(df.limit(300)).union(df.limit(150))
        for c in CLASHING:
            if c not in df.columns:
                out = out.withColumn(c, F.lit("clash"))
        out.coalesce(2).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return folder


def check(df, empty: bool) -> None:
    got = [tuple(r) for r in df.collect()]
    if empty:
        assert got == []
    else:
        assert got and all(v is not None for r in got for v in r)
        assert len(got) == len(set(got))
