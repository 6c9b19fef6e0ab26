"""Filling containers of fixed capacity: sum-of-squares online packing.

Documents come one after another; each goes to the fill level at which the
sum of the squares of the numbers of containers per partial fill level
becomes least. Those numbers are the level array, the only state besides the
open containers of each level. A document above the capacity fills whole
containers of its own with consecutive parts; what is left is packed like a
document. Ties go to the fullest level, so full containers win.

The stream is dealt into shards of about ``SHARD_ROWS`` documents by the hash
of their id, each packed on its own in order of id; the waste of a shard is
bounded by its own open containers, so it vanishes as shards are full. Sizes,
not texts, are shuffled.

Cases: a null or blank text has no tokens and takes no room, it gets a place
in the first container of its shard; repeated texts are packed as often as
they come; null ids are left out as they can't be named in the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandect.functions.text import token_count

CAPACITY = 512
SHARD_ROWS = 50_000
PLACED = "doc_id bigint, part_no int, tokens int, container_id bigint, place int, token_offset int"


def pack(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(item, part, tokens, container, place, offset) for items of given sizes in order."""
    counts = np.zeros(capacity + 1, np.int64)  # counts[h]: containers filled to h; 0 and full ones aren't partial
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]  # (container, items in it)
    out: list[tuple[int, int, int, int, int, int]] = []
    made = 0
    empties: list[int] = []
    for i, size in enumerate(sizes.tolist()):
        part = 1
        while size > capacity:
            out.append((i, part, capacity, made, 1, 0))
            made += 1
            part += 1
            size -= capacity
        if size == 0:
            empties.append(i)
            continue
        # Change of the sum of squares, by the level from which a container is taken.
        change = 2 * (counts[size:capacity] - counts[: capacity - size]) + 2  # from h to h + size, both partial
        best, level = 2 * int(counts[size]) + 1 if size < capacity else 0, 0  # a new container
        if len(change) > 1:
            change = np.where(counts[1 : capacity - size] > 0, change[1:], np.iinfo(np.int64).max)
            if len(change) and change.min() <= best:
                h = len(change) - 1 - int(np.argmin(change[::-1]))
                best, level = int(change[h]), h + 1
        full = capacity - size
        if 0 < full < capacity and counts[full] > 0 and 1 - 2 * int(counts[full]) <= best:
            level = full
        if level:
            container, n = stacks[level].pop()
            counts[level] -= 1
        else:
            container, n = made, 0
            made += 1
        if level + size < capacity:
            stacks[level + size].append((container, n + 1))
            counts[level + size] += 1
        out.append((i, part, size, container, n + 1, level))
    placed = [0] * max(made, 1)
    for row in out:
        placed[row[3]] += 1
    for i in empties:
        placed[0] += 1
        out.append((i, 1, 0, 0, placed[0], 0))
    return out


def packed(documents: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, part_no, tokens, container_id, place, token_offset``: where
    every part of every document is. Container ids are unique over all shards."""
    shards = max(1, math.ceil(documents.count() / shard_rows))  # the count comes from file metadata
    sized = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text")).cast("bigint").alias("size"))
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size"], kind="stable", ignore_index=True)
        rows = pack(pdf["size"].to_numpy(), capacity)
        item, part, tokens, container, place, offset = (np.asarray(x) for x in zip(*rows, strict=True))
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[item], "part_no": part, "tokens": tokens, "container_id": container + (int(pdf["shard"].iloc[0]) << 32), "place": place, "token_offset": offset})

    # One partition per shard: left alone, adaptive execution would join small shards into one task.
    return sized.repartition(shards, "shard").groupBy("shard").applyInPandas(one, PLACED)


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that had to be divided, each once."""
    return packed(documents).where("part_no = 2").select("doc_id").distinct()


def fill_report(documents: DataFrame) -> DataFrame:
    """Containers, tokens and the part of the room that is used, by whether the
    container holds a part of a divided document."""
    per = packed(documents).groupBy("container_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"), F.max("part_no").alias("parts"))
    out = per.groupBy((F.col("parts") > 1).alias("divided")).agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def verified(documents: DataFrame) -> DataFrame:
    """``doc_id, tokens, parts`` as placed, and ``fits``: no container that holds
    a part of the document is filled beyond its capacity."""
    rows = packed(documents)
    used = rows.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    rows = rows.join(used, "container_id")
    return rows.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.bool_and(F.col("used") <= CAPACITY).alias("fits"))
