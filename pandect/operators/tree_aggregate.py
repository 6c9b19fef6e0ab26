"""Per-key results without one reducer per heavy key: tree aggregation.

Input is combined in chunks of a fixed number of rows; the chunk states of a
key are merged ``fan_in`` at a time, round after round, until one is left. A
key that holds a third of all rows has as many chunk states as its rows fill
chunks; no task of any round merges more than ``fan_in`` of them.

Chunks are stretches of an input partition, so combining a chunk is the map
side of the first shuffle and never moves rows. Their states are stored, which
tells the largest slot (partition and chunk) there is: as a round merges the
slots of one stretch of ``fan_in``, and there are as many rounds as bring the
largest slot below ``fan_in``, no merge, the last included, ever takes more
than ``fan_in`` states, however the rows lie in their partitions. Each round
shuffles states only.

Cases: null keys form a group as in SQL; an empty input gives no groups; a
state must be merged by the same function that makes it (sum, min, max,
bool_or, bit_xor), which all of ``MERGES`` are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandect.plans.cut import stored

CHUNK_ROWS = 65_536
FAN_IN = 16
MERGES = {"sum": F.sum, "min": F.min, "max": F.max, "any": F.bool_or, "xor": F.bit_xor}
_ROW_BITS = 33


def rounds_for(slots: int, fan_in: int = FAN_IN) -> int:
    """Fan-in rounds that bring slots 0 to ``slots`` - 1 to at most ``fan_in``."""
    rounds = 0
    while slots > fan_in:
        slots = -(-slots // fan_in)
        rounds += 1
    return rounds


def merges(rows: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[Column, str]], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> list[DataFrame]:
    """The states (``keys``, ``__slot``, one column per state) before each
    merge: those of the chunks first, those that the last merge takes at the end."""
    place = F.monotonically_increasing_id()
    made = rows.select(*keys, F.shiftright(place, _ROW_BITS).alias("__part"), F.floor(F.pmod(place, F.lit(1 << _ROW_BITS)) / chunk_rows).cast("bigint").alias("__chunk"), *[c.alias(n) for n, (c, _) in states.items()])
    merged = [MERGES[how](n).alias(n) for n, (_, how) in states.items()]
    made = stored(made.groupBy(*keys, "__part", "__chunk").agg(*merged))
    parts, chunks = made.agg(F.coalesce(F.max("__part"), F.lit(0)) + 1, F.coalesce(F.max("__chunk"), F.lit(0)) + 1).first()
    out = [made.select(*keys, (F.col("__part") + F.col("__chunk") * parts).alias("__slot"), *states)]
    for _ in range(rounds_for(parts * chunks, fan_in)):
        out.append(out[-1].withColumn("__slot", F.floor(F.col("__slot") / fan_in).cast("bigint")).groupBy(*keys, "__slot").agg(*merged))
    return out


def tree_aggregate(rows: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[Column, str]], chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``keys`` and one column per state; ``states`` maps a name to what is
    combined and how (a key of ``MERGES``)."""
    last = merges(rows, keys, states, chunk_rows, fan_in)[-1]
    return last.groupBy(*keys).agg(*[MERGES[how](n).alias(n) for n, (_, how) in states.items()])
