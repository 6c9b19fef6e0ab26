"""Problem 1 on the register: observations of a law's status and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.functions.text import letters
from pandect.functions.times import iso_micros, micros, utc_text
from pandect.operators.merkle_history import LEVELS, Maintained, maintain
from pandect.plans.cut import stored

#: Stretch of the ordered observations: 30 days in microseconds.
SPAN = 30 * 86_400_000_000
#: Years between the snapshots at which the register's feed is compared.
PERIOD_YEARS = 2


def json_or_text(c):
    """The text of a JSON string; what is no JSON stays as it is."""
    decoded = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.when(F.startswith(F.trim(c), F.lit('"')), F.coalesce(decoded, c)).otherwise(c)


def observations(laws: DataFrame, statuses: DataFrame) -> DataFrame:
    """``law_name, at`` (microseconds), ``status_code, snapshot`` (period of delivery).

    Rows observe ``live`` at ``updated_at``; log entries with a readable time
    observe the new value of the field ``live``. Texts that are no status, and
    rows without name, give nothing; without ``synced_at`` a row counts to the
    first snapshot.
    """
    snapshot = F.coalesce(F.floor(F.year("synced_at") / PERIOD_YEARS).cast("int"), F.lit(0))
    base = laws.select(F.col("name").alias("law_name"), "live", "updated_at", "record_change_log", snapshot.alias("snapshot"))
    here = base.select("law_name", micros(F.col("updated_at")).alias("at"), letters(F.col("live")).alias("letters"), "snapshot")
    log = base.select("law_name", F.explode("record_change_log").alias("e"), "snapshot")
    log = log.select("law_name", iso_micros(F.col("e.timestamp")).alias("at"), letters(json_or_text(F.col("e.changes")["live"]["new"])).alias("letters"), "snapshot")
    known = statuses.where(F.col("status_code").isNotNull() & F.col("label").isNotNull()).groupBy(letters(F.col("label")).alias("letters")).agg(F.min("status_code").alias("status_code"))
    both = here.unionByName(log).where("law_name is not null and at is not null and letters <> ''")
    return both.join(known, "letters").select("law_name", "at", "status_code", "snapshot")


def maintained(laws: DataFrame, statuses: DataFrame) -> Maintained:
    """The history kept over the feed's snapshots; the state at a snapshot is
    all that was observed in rows that came up to it, each observation once."""
    seen = observations(laws, statuses)
    # One row per content with the first snapshot that has it; partial sums before the shuffle.
    seen = stored(seen.groupBy("law_name", "at", "status_code").agg(F.min("snapshot").alias("snapshot")))
    periods = [r[0] for r in seen.select("snapshot").distinct().sort("snapshot").collect()]
    states = [seen.where(F.col("snapshot") <= p).drop("snapshot") for p in periods] or [seen.drop("snapshot")]
    return maintain(states, ["law_name"], "at", "status_code", SPAN)


def history(laws: DataFrame, statuses: DataFrame) -> DataFrame:
    """``law_name, status_code, valid_from, valid_to`` in microseconds."""
    return maintained(laws, statuses).history


def descent(laws: DataFrame, statuses: DataFrame) -> DataFrame:
    """``comparison, nodes, differing_nodes, leaves, differing_leaves``: what the
    comparison of each two neighbouring snapshots looked at and what it pruned."""
    spark = laws.sparkSession
    out = spark.createDataFrame([], "comparison int, nodes bigint, differing_nodes bigint, leaves bigint, differing_leaves bigint")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__level") == LEVELS).alias("m"))
    for i, (other, now) in enumerate(maintained(laws, statuses).looked_at, 1):
        every, differ = count(now).toDF("nodes", "leaves"), count(other).toDF("differing_nodes", "differing_leaves")
        # Two single rows side by side.
        out = out.unionByName(every.withColumn("comparison", F.lit(i)).join(differ.withColumn("comparison", F.lit(i)), "comparison"))
    return out


def found(laws: DataFrame, statuses: DataFrame) -> DataFrame:
    """``law_name, valid_from, status_code``: each version of a law's status."""
    return history(laws, statuses).select("law_name", utc_text(F.col("valid_from")).alias("valid_from"), "status_code").distinct()


def periods(laws: DataFrame, statuses: DataFrame) -> DataFrame:
    """The full history: each version with the period in which it was valid;
    ``valid_to`` of the current version is empty."""
    h = history(laws, statuses)
    return h.select("law_name", "status_code", utc_text(F.col("valid_from")).alias("valid_from"), F.coalesce(utc_text(F.col("valid_to")), F.lit("")).alias("valid_to"), F.col("valid_to").isNull().alias("is_current"))
