"""References to records that do not exist: missing, deleted or arrived later.

A reference is a composite key, some of whose parts may be null. References
are grouped by their null mask; each mask is anti-joined on its non-null
columns under the declared match semantics of SQL's foreign keys:

* ``simple``: a reference with any null part is satisfied;
* ``partial``: the non-null parts must match some record;
* ``full``: all parts null is satisfied, some null is never satisfied.

References are stored once with their mask, and only masks that occur are
joined. The anti-join keeps the state of the key that a reference failed on, so
one join per mask finds the orphans and tells why they are some.

A record satisfies a reference only if it isn't deleted and did not arrive
after the referring row. Orphans are then told apart:

* ``deleted``: the key is listed as removed and no record of it arrived after
  the (last) removal;
* ``missing``: no record has the key;
* ``late``: the earliest record of the key arrived after the referring row.

Cases: a reference without arrival time can't be early, so it is never
``late``; removals without time are ignored; records whose key is partly null
satisfy only masks that don't ask for that part; equal references come out as
often as they came in; further columns of the references are kept, internal
names start with ``__``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.plans.cut import stored

MATCHES = ("simple", "partial", "full")


def null_mask(keys: Sequence[str]):
    """Bit i is set where key i is null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)])


def key_states(records: DataFrame, removed: DataFrame | None, keys: Sequence[str], arrived: str, removed_at: str) -> DataFrame:
    """Per key: ``__first`` arrival, whether it ``__exists`` and is ``__deleted``.

    Both sides are combined per key in one aggregation with partial sums on the
    map side, so a key with very many records is no burden.
    """
    # "__has" is true of records, "__gone" the time of removals.
    rows = records.select(*keys, F.col(arrived).alias("__in"), F.lit(True).alias("__has"), F.lit(None).cast("timestamp_ntz").alias("__gone"))
    if removed is not None:
        rows = rows.unionByName(removed.where(F.col(removed_at).isNotNull()).select(*keys, F.lit(None).cast("timestamp_ntz").alias("__in"), F.lit(False).alias("__has"), F.col(removed_at).cast("timestamp_ntz").alias("__gone")))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    state = rows.groupBy(*keys).agg(F.min("__in").alias("__first"), F.max("__in").alias("__last"), F.bool_or("__has").alias("__exists"), F.max("__gone").alias("__gone"))
    deleted = F.col("__gone").isNotNull() & (F.col("__last").isNull() | (F.col("__last") <= F.col("__gone")))
    return state.select(*keys, "__first", "__exists", deleted.alias("__deleted"))


def masked(references: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The references with their ``__mask``, stored."""
    return stored(references.withColumn("__mask", null_mask(keys)))


def mask_counts(references: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``null_keys`` (names of the null parts) and how many ``references`` have that mask."""
    names = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]))
    return references.groupBy(*by, F.array_join(names, ",").alias("null_keys")).agg(F.count(F.lit(1)).alias("references"))


def orphans(references: DataFrame, records: DataFrame, keys: Sequence[str], match: str = "full", arrived: str = "arrived_at", removed: DataFrame | None = None, removed_at: str = "removed_at") -> DataFrame:
    """The references that aren't satisfied, with their ``kind``.

    ``references`` and ``records`` (and ``removed``) have the columns ``keys``
    and ``arrived`` (``removed_at``); each mask that the semantics check and
    that occurs is joined on its own columns.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    refs = masked(references, keys)
    everything = (1 << len(keys)) - 1
    # At most two to the number of keys masks reach the driver.
    occurring = sorted(r[0] for r in refs.select("__mask").distinct().collect())
    out = [refs.where("false").drop("__mask").withColumn("kind", F.lit(""))]
    for mask in occurring:
        if mask == everything or mask and match == "simple":
            continue
        part = refs.where(F.col("__mask") == mask).drop("__mask")
        if mask and match == "full":
            out.append(part.withColumn("kind", F.lit("missing")))
            continue
        on = [k for i, k in enumerate(keys) if not mask >> i & 1]
        # Stored, the states are shuffled on their own by the join, which lets AQE split a key
        # that holds a third of all references; straight from the aggregation it can't.
        states = stored(key_states(records, removed, on, arrived, removed_at))
        states = states.select(*[F.col(k).alias(f"__{k}") for k in on], "__first", "__exists", "__deleted")
        judged = part.join(states, [F.col(k) == F.col(f"__{k}") for k in on], "left")
        in_time = F.coalesce(F.col("__first") <= F.col(arrived).cast("timestamp_ntz"), F.lit(True))
        satisfied = F.coalesce(F.col("__exists") & ~F.col("__deleted") & in_time, F.lit(False))
        kind = F.when(F.col("__deleted"), "deleted").when(F.col("__exists"), "late").otherwise("missing")
        out.append(judged.where(~satisfied).withColumn("kind", kind).drop(*[f"__{k}" for k in on], "__first", "__exists", "__deleted"))
    return reduce(DataFrame.unionByName, out)


def counts(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Orphans per table, period and whatever ``by`` names."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("orphans"))
