"""History of changing attributes, kept by Merkle comparison of snapshots.

Every key belongs to a leaf bucket by its hash; ``FANOUT`` neighbouring
buckets form a node of the level above, up to one root. A bucket's digest is
the exclusive-or of the hashes of its distinct rows (two independent 64-bit
hashes, so 128 bits). Two snapshots are compared from the root down: only
below nodes whose digests differ are the children looked at, and only rows of
leaf buckets that differ are compared themselves.

``maintain`` keeps the history of a chain of snapshots that way: the first is
loaded as a whole; of every later one the tree is compared with the tree of
the one before, the rows of changed leaves are diffed, and of the keys that
the diff names the versions are made anew and appended, while all others keep
theirs. So what a snapshot costs beyond its digests follows what changed.

Cases: rows with a null key are left out; null values count as values; a row
given twice counts once; an empty snapshot has no buckets and differs from
any that has some; columns that aren't named are ignored, and internal names
start with ``__``, so that no column of the input clashes with them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandect.plans.cut import stored

FANOUT = 256
LEVELS = 2
#: Snapshots whose comparisons share a job.
BLOCK = 8
_A, _B = "__digest_a", "__digest_b"


def leaf_of(keys: Sequence[str], levels: int = LEVELS, fanout: int = FANOUT) -> Column:
    """Leaf bucket of a key, 0 to fanout ** levels - 1."""
    return F.pmod(F.xxhash64(*keys), F.lit(fanout**levels)).cast("bigint")


def _hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    # A null is hashed by its flag: xxhash64 skips nulls, so (1, null) and (null, 1) would collide.
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def tree(rows: DataFrame, keys: Sequence[str], values: Sequence[str], bucket: Sequence[str], levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """Digests of all nodes: ``__level`` (0 is the root), ``__node``, two digests.

    ``rows`` must be distinct in keys and values; ``bucket`` are the columns
    whose hash gives the leaf. Leaves are combined on the map side; only their
    digests go on to the levels above.
    """
    a, b = _hashes([*keys, *values])
    leaf = rows.select(leaf_of(bucket, levels, fanout).alias("__node"), a.alias(_A), b.alias(_B))
    leaf = leaf.groupBy("__node").agg(F.bit_xor(_A).alias(_A), F.bit_xor(_B).alias(_B))
    places = F.array(*[F.struct(F.lit(n).alias("__level"), F.floor(F.col("__node") / F.lit(fanout ** (levels - n))).cast("bigint").alias("__at")) for n in range(levels + 1)])
    node = leaf.select(F.inline(places), _A, _B)
    return node.groupBy("__level", F.col("__at").alias("__node")).agg(F.bit_xor(_A).alias(_A), F.bit_xor(_B).alias(_B))


def _descend(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """Leaves below differing nodes only; ``nodes`` are those that differ."""
    level = lambda n: nodes.where(F.col("__level") == n).select("__node")
    changed = level(0)
    for n in range(1, levels + 1):
        parent = changed.select(F.col("__node").alias("__parent"))
        child = level(n).withColumn("__parent", F.floor(F.col("__node") / fanout).cast("bigint"))
        changed = child.join(parent, "__parent", "left_semi").drop("__parent")
    return changed


def differing(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """``__level, __node`` of the nodes whose digests differ between two trees."""
    at = ["__level", "__node"]
    o = old_nodes.select(*at, F.col(_A).alias("__old_a"), F.col(_B).alias("__old_b"))
    same = F.col(_A).eqNullSafe(F.col("__old_a")) & F.col(_B).eqNullSafe(F.col("__old_b"))
    return new_nodes.join(o, at, "full_outer").where(~same).select(*at)


def changed_leaves(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """Leaf buckets (``__node``) whose rows differ between two snapshots."""
    trees = [tree(x, keys, values, keys, levels, fanout) for x in (old, new)]
    return _descend(stored(differing(*trees)), levels, fanout)


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], levels: int = LEVELS, fanout: int = FANOUT, leaves: DataFrame | None = None, bucket: Sequence[str] | None = None) -> DataFrame:
    """Changed keys between two snapshots: keys, new values, ``change``
    ('insert', 'update', 'delete'; a deleted key has null values).

    A snapshot should hold a key once; of several rows the one greatest in its
    values counts. ``bucket`` are the columns whose hash gives the leaf (the
    keys, if not given); ``leaves`` the changed ones, if they are known.
    """
    cols = [*keys, *values]
    bucket = list(bucket or keys)

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(*cols)
        for k in keys:
            df = df.where(F.col(k).isNotNull())
        return df

    def single(df: DataFrame) -> DataFrame:
        if not values:
            return df.distinct()
        best = df.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__v"))
        return best.select(*keys, *[F.col("__v")[v].alias(v) for v in values])

    old, new = clean(old), clean(new)
    if leaves is None:
        old, new = single(old), single(new)
        leaves = changed_leaves(old, new, keys, values, levels, fanout)
    pick = lambda df: df.withColumn("__node", leaf_of(bucket, levels, fanout)).join(leaves, "__node", "left_semi").drop("__node")
    o = single(pick(old)).select(*keys, F.struct(F.lit(1).alias("__one"), *values).alias("__old"))
    n = single(pick(new)).select(*keys, F.struct(F.lit(1).alias("__one"), *values).alias("__new"))
    both = n.join(o, list(keys), "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    change = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").otherwise("update")
    return both.select(*keys, *[F.col("__new")[v].alias(v) for v in values], change.alias("change"))


def append_versions(history: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], as_of: Column) -> DataFrame:
    """History (keys, values, valid_from, valid_to) after the changes of one
    more snapshot: open versions of changed keys end, new ones begin."""
    mark = changes.select(*keys, F.col("change").alias("__change"))
    closed = history.join(mark, list(keys), "left").withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("__change").isNotNull(), as_of).otherwise(F.col("valid_to"))).drop("__change")
    opened = changes.where("change <> 'delete'").select(*keys, *values, as_of.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return closed.select(*keys, *values, "valid_from", "valid_to").unionByName(opened)


class Maintained:
    """What ``maintain`` gives: ``history`` (as ``versions``), and of every
    snapshot but the first the stored ``differing`` nodes (``looked_at``)."""

    def __init__(self, history: DataFrame, looked_at: list[tuple[DataFrame, DataFrame]]):
        self.history, self.looked_at = history, looked_at


def maintain(snapshots: Sequence[DataFrame], keys: Sequence[str], at: str, value: str, span: int, levels: int = LEVELS, fanout: int = FANOUT) -> Maintained:
    """The history of an attribute after a chain of snapshots, each of which
    holds distinct observations (keys, ``at``, ``value``) without nulls.

    A snapshot may add observations at any time, or lack some of the one
    before; the history is always that of the last one.
    """
    content = [*keys, at, value]
    numbered = lambda parts: reduce(DataFrame.unionByName, [df.withColumn("__i", F.lit(i)) for i, df in parts])
    of = lambda df, i: df.where(F.col("__i") == i).drop("__i")
    history = versions(snapshots[0], keys, at, value, span)
    looked_at = []
    # A block of snapshots takes one job each for its trees, its comparisons and its diffs.
    for first in range(1, len(snapshots), BLOCK):
        links = range(first, min(first + BLOCK, len(snapshots)))
        trees = stored(numbered([(i, tree(snapshots[i], content, (), keys, levels, fanout)) for i in (first - 1, *links)]))
        differ = stored(numbered([(i, differing(of(trees, i - 1), of(trees, i))) for i in links]))
        diff = lambda i: diff_snapshots(snapshots[i - 1], snapshots[i], content, (), levels, fanout, _descend(of(differ, i), levels, fanout), keys)  # noqa: E731, B023
        # Of a key that several snapshots of the block changed the last one's versions stay.
        changed = stored(numbered([(i, diff(i).select(*keys)) for i in links]).groupBy(*keys).agg(F.max("__i").alias("__i")))
        rows = reduce(DataFrame.unionByName, [snapshots[i].join(of(changed, i), list(keys), "left_semi") for i in links])
        history = append_observed(history if first == 1 else stored(history), changed, rows, keys, at, value, span)
        looked_at += [(of(differ, i), of(trees, i)) for i in links]
    return Maintained(history, looked_at)


def append_observed(history: DataFrame, changed: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, value: str, span: int) -> DataFrame:
    """History (as ``versions``) with those of the ``changed`` keys made anew
    from ``rows``, all their observations: one that came late may part a version
    or join two."""
    fresh = versions(rows, keys, at, value, span)
    return history.join(changed, list(keys), "left_anti").unionByName(fresh)


def versions(observations: DataFrame, keys: Sequence[str], at: str, value: str, span: int) -> DataFrame:
    """Versions of an attribute: keys, value, ``at`` as ``valid_from``, ``valid_to``.

    In order of ``at`` (ties: of the value) a version begins at the first
    observation and at each with another value than the one before; it ends
    where the next begins, the last is open (null). ``span`` is the length of
    the stretches in which a key's observations are ordered separately, so no
    task needs all observations of one key: within a stretch by a window, from
    stretch to stretch by the last value of the one before.
    """
    stretch = F.floor(F.col(at) / F.lit(span)).cast("bigint")
    rows = observations.select(*keys, at, value).withColumn("__stretch", stretch)
    inside = Window.partitionBy(*keys, "__stretch").orderBy(at, value)
    rows = rows.withColumn("__before", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    # Only the ends of runs matter from here on; the last value of a stretch carries over to the next.
    rows = rows.where(F.col("__first") | (F.col(value) != F.col("__before")))
    ends = rows.groupBy(*keys, "__stretch").agg(F.max(F.struct(at, value))[value].alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__stretch")
    ends = ends.select(*keys, "__stretch", F.lag("__last").over(along).alias("__carried"))
    starts = rows.join(ends, [*keys, "__stretch"]).where(~F.col("__first") | F.col("__carried").isNull() | (F.col("__carried") != F.col(value)))
    starts = starts.select(*keys, "__stretch", at, value)
    nxt = F.lead(at).over(inside)
    heads = starts.groupBy(*keys, "__stretch").agg(F.min(at).alias("__head"))
    heads = heads.select(*keys, "__stretch", F.lead("__head").over(along).alias("__head"))
    out = starts.withColumn("__next", nxt).join(heads, [*keys, "__stretch"])
    return out.select(*keys, value, F.col(at).alias("valid_from"), F.coalesce("__next", "__head").alias("valid_to"))
