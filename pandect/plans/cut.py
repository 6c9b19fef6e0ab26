"""Cutting lineage in the folder that the cluster shares.

``stored`` writes a Parquet table there: it outlives lost executors, and its
readers prune columns and skip row groups. The tables belong to the session: it
deletes them when it ends, or earlier by ``release``, when nothing lazily reads
them any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PLACES: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without
    one gets a folder of its own."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if shared is None and known.isDefined():
        shared = known.get()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pandect-")
    if not known.isDefined():
        sc.setCheckpointDir(shared)
    return shared


def stored(df: DataFrame) -> DataFrame:
    """``df`` from a Parquet table that is written once in the shared folder."""
    place = f"{shared_folder(df.sparkSession).rstrip('/')}/pandect-{uuid.uuid4().hex}"
    df.write.parquet(place)
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    _PLACES.append(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def release(spark: SparkSession) -> int:
    """Delete all tables stored so far, for use between jobs whose results have
    been written; how many there were."""
    n = len(_PLACES)
    while _PLACES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PLACES.pop())
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    return n
