"""Splitting oversized items at natural boundaries, by pointer doubling.

An item is a text of some size, made of one unit or of many in order. Its
legal cuts are positions between characters: natural ones after a sentence, a
clause or a unit; where two of those are more than ``GAP`` apart, blanks
between words at most ``GAP`` apart; where there is no blank either, positions
``GAP`` apart. From a cut the next is the farthest legal one that keeps the
piece, overlap included, under the limit: a natural one if any lies beyond a
third of the reach, else any. So every cut has exactly one successor, and the
pieces are the path from 0 to the end of the text.

That path is not walked. The successor table is squared: after k squarings it
leads 2**k cuts on, and the set of cuts known to lie on the path doubles with
each. Tables of ``SEGMENT`` characters are held as arrays and squared in
place; an item larger than one segment gets a table from each segment's entry
cuts to the exit cuts in a later one, which is squared by joins over the
whole cluster. So no task holds more of an item than one segment with its
overlap, whatever an item's size.

Cases: blanks of any kind, in any number, count as one, none at the ends; null
and empty texts have size 0; items within the limit give no pieces; a text
without any blank is cut every so many characters; rows given twice have been
folded before (newest row per unit); null law names come out as ''.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pandect.functions.keys import law_key
from pandect.plans.cut import stored
from pandect.plans.newest import newest

LIMIT = 1_200
OVERLAP = 100
#: Characters of one array-held successor table.
SEGMENT = 8_192
#: Units of one stretch of a provision whose offsets are summed in one window.
STRETCH = 1_024
#: Stretches that units without a position are dealt into.
LOOSE = 64

#: Natural cuts: after the end of a sentence, or of a clause that ends with ; : or a dash.
_NATURAL = re.compile(r"[.!?][\"”’')\]]*(?= )|[;:—](?= )")
KEYS = ("item_kind", "law_name", "item_key")


def gap_of(limit: int, overlap: int) -> int:
    """Legal cuts are never farther apart: two fit into every reach."""
    return max(1, (limit - overlap) // 2 - 1)


def legal_cuts(text: str, gap: int) -> np.ndarray:
    """Cuts of a text without superfluous blanks, each as 2 * position, plus 1
    if it is natural; the end of the text is one, its start is not."""
    size = len(text)
    if not size:
        return np.empty(0, np.int64)
    natural = [m.end() for m in _NATURAL.finditer(text)]
    natural.append(size)
    out: list[int] = []
    before = 0
    for at in natural:
        while at - before > gap:
            blank = text.rfind(" ", before + 1, before + gap + 1)
            before = blank if blank > before else before + gap
            out.append(2 * before)
        if at > before:
            out.append(2 * at + 1)
            before = at
    return np.asarray(out, np.int64)


def successors(cuts: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Index of every cut's farthest legal successor; the last has itself.

    The start of an item (position 0) has nothing to repeat, so it reaches
    farther than all others.
    """
    at, natural = cuts >> 1, np.flatnonzero(cuts & 1)
    reach = at + np.where(at == 0, limit, limit - overlap)
    far = np.searchsorted(at, reach, "right") - 1
    if len(natural):
        best = natural[np.maximum(np.searchsorted(at[natural], reach, "right") - 1, 0)]
        far = np.where((at[best] >= at + (limit - overlap) // 3) & (best <= far) & (best > np.arange(len(at))), best, far)
    return far


def path_from(entry: int, table: np.ndarray) -> np.ndarray:
    """Indices on the path from ``entry``, by squaring the table."""
    known = np.zeros(len(table), bool)
    known[entry] = True
    n = 0
    while True:
        known[table[np.flatnonzero(known)]] = True
        if (m := int(known.sum())) == n:
            return np.flatnonzero(known)
        n, table = m, table[table]


def _measured(units: DataFrame, limit: int, overlap: int, with_text: bool) -> DataFrame:
    """``section_id, law_name, path, position, updated_at, synced_at, size,
    cuts`` (and ``text``): texts are squeezed, measured and searched for cuts
    before anything is shuffled."""
    gap = gap_of(limit, overlap)
    source = units.select("section_id", "law_name", F.col("hierarchy_path").alias("path"), "position", "updated_at", "synced_at", F.col("text").alias("__text")).where("section_id is not null and updated_at is not null")
    kept = [f for f in source.schema if f.name != "__text"]
    added = [T.StructField("size", T.LongType()), T.StructField("cuts", T.ArrayType(T.LongType()))] + [T.StructField("text", T.StringType())] * with_text

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(t.split()) if t else "" for t in b.column(b.num_columns - 1).to_pylist()]
            made = [pa.array([len(t) for t in texts], pa.int64()), pa.array([legal_cuts(t, gap) for t in texts], pa.list_(pa.int64()))]
            if with_text:
                made.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*[f.name for f in kept], *[f.name for f in added]])

    out = source.mapInArrow(measure, T.StructType([*kept, *added]))
    return out.withColumn("law_name", F.coalesce(law_key(F.col("law_name")), F.lit("")))


def provision_path(c):
    """The path up to and including its first level that starts with
    ``provision.``, empty levels left out; null if there is none."""
    levels = F.filter(F.split(c, "/"), lambda x: x != "")
    upto = F.array_position(F.transform(levels, lambda x: F.startswith(x, F.lit("provision."))), True)
    return F.when(upto > 0, F.array_join(F.slice(levels, F.lit(1), F.greatest(upto.cast("int"), F.lit(1))), "/"))


def _parts(units: DataFrame, limit: int) -> DataFrame:
    """Units as parts of oversized items: KEYS, ``total``, ``offset``, ``size``,
    ``cuts`` and, if there, ``text``. The offset of a unit in its provision is
    summed in stretches of positions: within a stretch by a window, from
    stretch to stretch by the stretches' sums. Units without a position come
    first, in ``LOOSE`` stretches by the hash of their section_id."""
    text = ["text"] if "text" in units.columns else []
    alone = units.where(F.col("size") > limit).select(F.lit("unit").alias("item_kind"), "law_name", F.col("section_id").alias("item_key"), F.col("size").alias("total"), F.lit(0).cast("bigint").alias("offset"), "size", "cuts", *text)
    rows = units.withColumn("item_key", provision_path(F.col("path"))).where("item_key is not null")
    rows = rows.withColumn("__stretch", F.coalesce(F.floor(F.col("position") / STRETCH), -1 - F.pmod(F.xxhash64("section_id"), F.lit(LOOSE))).cast("bigint")).select("law_name", "item_key", "__stretch", "position", "section_id", "size", "cuts", *text)
    sums = rows.groupBy("law_name", "item_key", "__stretch").agg(F.sum(F.col("size") + 1).alias("__sum"))
    whole = Window.partitionBy("law_name", "item_key")
    along = whole.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("total", F.sum("__sum").over(whole) - 1).withColumn("__before", F.coalesce(F.sum("__sum").over(along), F.lit(0))).where(F.col("total") > limit)
    inside = Window.partitionBy("law_name", "item_key", "__stretch").orderBy("position", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums.drop("__sum"), ["law_name", "item_key", "__stretch"])
    rows = rows.withColumn("offset", F.col("__before") + F.coalesce(F.sum(F.col("size") + 1).over(inside), F.lit(0)))
    joined = rows.select(F.lit("provision").alias("item_kind"), "law_name", "item_key", "total", "offset", "size", "cuts", *text)
    return alone.unionByName(joined)


def _segments(parts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Per item and segment its cuts (those of the following ``limit``
    characters included) in order, and its text with the overlaps if wanted."""
    with_text = "text" in parts.columns
    last = F.greatest(F.col("offset") + F.col("size"), F.col("offset"))
    first_seg = F.floor(F.greatest(F.col("offset") - limit, F.lit(0)) / SEGMENT).cast("bigint")
    last_seg = F.floor((last + overlap) / SEGMENT).cast("bigint")
    top = F.floor((F.col("total") - 1) / SEGMENT).cast("bigint")
    spread = parts.withColumn("segment", F.explode(F.sequence(first_seg, F.least(last_seg, top))))
    low, high = F.col("segment") * SEGMENT, (F.col("segment") + 1) * SEGMENT + limit
    # A unit's cuts in the item: moved by its offset; an empty unit has its end as cut.
    own = F.when(F.size("cuts") > 0, F.col("cuts")).otherwise(F.array(F.lit(1).cast("bigint")))
    moved = F.filter(F.transform(own, lambda c: c + 2 * F.col("offset")), lambda c: (F.shiftright(c, 1) >= low) & (F.shiftright(c, 1) < high) & (F.shiftright(c, 1) > 0))
    cols = [F.sort_array(F.array_distinct(F.flatten(F.collect_list("moved")))).alias("cuts")]
    spread = spread.withColumn("moved", moved)
    if with_text:
        # The joint behind a unit is a line end, except behind the last.
        body = F.when(F.col("offset") + F.col("size") < F.col("total"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
        start = F.greatest(low - overlap - F.col("offset"), F.lit(0))
        piece = F.substring(body, (start + 1).cast("int"), F.greatest(high - F.col("offset") - start, F.lit(0)).cast("int"))
        spread = spread.withColumn("piece", F.struct("offset", piece.alias("t")))
        cols.append(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["t"]), "").alias("text"))
    return spread.groupBy(*KEYS, "total", "segment").agg(*cols)


_SPAN = [T.StructField("piece_start", T.LongType()), T.StructField("piece_end", T.LongType())]


def _table(cuts, segment: int, total: int, limit: int, overlap: int):
    """(cuts with start or end added, successors, first index past the segment)."""
    cuts = np.asarray(cuts, np.int64)
    if segment == 0:
        cuts = np.concatenate([[0], cuts])
    nxt = successors(cuts, limit, overlap)
    past = int(np.searchsorted(cuts >> 1, min((segment + 1) * SEGMENT, total)))
    nxt[past:] = np.arange(past, len(cuts))
    return cuts, nxt, past


def _exits(segments: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Of every cut at which a segment can be entered, where its path leaves it."""
    source = segments.select(*KEYS, "total", "segment", "cuts")
    schema = T.StructType([*[source.schema[k] for k in KEYS], T.StructField("entry", T.LongType()), T.StructField("exit", T.LongType())])

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, entry, exits = [], [], []
            for i, (total, seg, cuts) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)):
                cuts, nxt, past = _table(cuts, seg, total, limit, overlap)
                while not np.array_equal(nxt[nxt], nxt):
                    nxt = nxt[nxt]
                n = 1 if seg == 0 else int(np.searchsorted(cuts >> 1, seg * SEGMENT + limit))
                n = min(n, past)
                at += [i] * n
                entry += (cuts[:n] >> 1).tolist()
                exits += (cuts[nxt[:n]] >> 1).tolist()
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int32())) for k in range(3)], pa.array(entry, pa.int64()), pa.array(exits, pa.int64())], names=[*KEYS, "entry", "exit"])

    return source.mapInArrow(leave, schema)


def entries_on_path(table: DataFrame, keys: Sequence[str], rounds: int) -> DataFrame:
    """``keys, entry``: entries reached from 0, by squaring the successor table
    (``keys, entry, exit``) with joins, ``rounds`` times."""
    known = table.where("entry = 0").select(*keys, "entry")
    step = table
    for _ in range(rounds):
        onward = known.join(step, [*keys, "entry"]).select(*keys, F.col("exit").alias("entry"))
        known = stored(known.unionByName(onward).distinct())
        second = step.select(*keys, F.col("entry").alias("exit"), F.col("exit").alias("__beyond"))
        step = stored(step.join(second, [*keys, "exit"], "left").select(*keys, "entry", F.coalesce("__beyond", "exit").alias("exit")))
    return known


def _spans(segments: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces from segments with the ``entry`` at which the path enters them."""
    with_text = "text" in segments.columns
    source = segments.select(*KEYS, "total", "segment", "cuts", "entry", *(["text"] if with_text else []))
    schema = T.StructType([*[source.schema[k] for k in KEYS], *_SPAN] + [T.StructField("piece", T.StringType())] * with_text)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, starts, ends, pieces = [], [], [], []
            texts = b.column(7).to_pylist() if with_text else [None] * b.num_rows
            for i, (total, seg, cuts, entry, text) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6)), texts, strict=True)):
                cuts, nxt, past = _table(cuts, seg, total, limit, overlap)
                where = cuts >> 1
                path = path_from(int(np.searchsorted(where, entry)), nxt)
                stops = where[path]
                for s, e in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                    s = max(s - overlap, 0)
                    at.append(i)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        base = max(seg * SEGMENT - overlap, 0)
                        pieces.append(text[s - base : e - base])
            made = [pa.array(starts, pa.int64()), pa.array(ends, pa.int64())] + [pa.array(pieces, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int32())) for k in range(3)], *made], names=[f.name for f in schema])

    return source.mapInArrow(walk, schema)


def pieces(units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """KEYS, ``piece_start, piece_end`` (positions in the item) and ``piece``,
    its text: at most ``limit`` characters, the first ``overlap`` of which
    repeat the end of the piece before, save of an item's first piece."""
    measured = _measured(units, limit, overlap, with_text)
    kept = ["law_name", "path", "position", "size", "cuts"] + ["text"] * with_text
    # Stored: texts are measured once, though single units, offsets and sums each read some of it.
    now = stored(newest(measured, "section_id", kept))
    segments = stored(_segments(_parts(now, limit), limit, overlap))
    alone = segments.where(F.col("total") <= SEGMENT).withColumn("entry", F.lit(0).cast("bigint"))
    large = segments.where(F.col("total") > SEGMENT)
    most = large.agg(F.max("segment")).first()[0]
    entered = alone
    if most is not None:
        known = entries_on_path(stored(_exits(large, limit, overlap)), KEYS, math.ceil(math.log2(most + 2)))
        known = known.withColumn("segment", F.floor(F.col("entry") / SEGMENT).cast("bigint"))
        # The end of the text is no entry: no segment begins there, or its path is empty.
        entered = alone.unionByName(large.join(known, [*KEYS, "segment"]).select(*alone.columns))
    return _spans(entered, limit, overlap)


def found(units: DataFrame) -> DataFrame:
    """``item_kind, law_name, item_key``: the items that had to be split, each
    once: those of which a piece starts the text but doesn't end it."""
    cutup = pieces(units, with_text=False)
    return cutup.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEYS)


def numbered_pieces(units: DataFrame) -> DataFrame:
    """Every piece with its 1-based number; an item's pieces are numbered in
    windows over its starts, which hold no texts."""
    w = Window.partitionBy(*KEYS).orderBy("piece_start", "piece_end")
    return pieces(units).withColumn("piece_no", F.row_number().over(w)).select(*KEYS, "piece_no", "piece_start", "piece_end", "piece")


def verified(units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """KEYS, ``total`` (the item's size) and what must hold of its pieces:
    ``within_limit``, ``overlapping`` (each repeats exactly the end of the one
    before), ``covering`` (from the item's start to its end) and ``texts_fit``."""
    rows = pieces(units, limit, overlap)
    w = Window.partitionBy(*KEYS).orderBy("piece_start", "piece_end")
    rows = rows.withColumn("before", F.lag("piece_end").over(w)).withColumn("size", F.length("piece"))
    repeats = F.col("before").isNull() | (F.col("piece_start") == F.col("before") - overlap)
    out = rows.groupBy(*KEYS).agg(
        F.max("piece_end").alias("total"),
        (F.max("size") <= limit).alias("within_limit"),
        F.bool_and(repeats).alias("overlapping"),
        (F.min("piece_start") == 0).alias("covering"),
        F.bool_and(F.col("size") == F.col("piece_end") - F.col("piece_start")).alias("texts_fit"),
    )
    return out
