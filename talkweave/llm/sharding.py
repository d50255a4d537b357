"""Sharding by sampled splitters: ranges of a content key, cut so that shards hold near equal bytes.

Rows are ordered by a hash of their text, so equal texts lie together. A size-weighted sample of
keys gives splitters at its quantiles; the exact bytes of every range are then summed, ranges that
hold too much are split again by a denser sample of their own until none does, and shards take runs of
whole ranges; a few ranges then move from the fullest shard to the emptiest. Groups of equal texts too
large for a range are ranges by themselves; those larger than a shard's part, and no others, are split.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch

RANGES = 64  # ranges per shard
SAMPLE = 32  # sampled keys per range
ROUNDS = 40  # times that overfull ranges are split again, each by a denser sample; beyond that is an error


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _unit(*what: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*what), 11).cast("double") / F.lit(float(1 << 53))


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below the key."""
    cuts = np.array(splitters, np.int64)

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.searchsorted(cuts, b.to_numpy(np.int64), side="right"))

    return place(key)


def assign_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES
) -> DataFrame:
    """One row per row of ``docs``: (id, size, text_crc32, shard, slot).

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` counts the rows of a shard from 0 without
    gaps. The law is bytes: sizes of shards are near equal (within about a range, a 64th of a shard).
    Equal texts are in one shard unless together they exceed a shard's part; where groups just below a
    part leave no other way, that law comes before equal sizes.

    On the driver are: splitters, sums for each range and the groups that exceed a range's part: all
    bounded by ``shards * ranges`` (a sample holds its expected 32 keys per range and little more).

    Defined results: a null text has size 1, crc 0 and is the same as an empty text; a text larger
    than a shard's part is one row and stays whole; null ids and repeated rows get slots of their own;
    slots within a range go by key, id, size and crc, and rows alike in all four are interchangeable;
    of equally full shards the first is taken; other columns, whatever their names, are neither read
    nor returned; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.save(
            docs.select(
                F.col(id_col).alias("id"),
                text_size(F.col(text_col)).alias("size"),
                F.crc32(text.cast("binary")).alias("crc"),
                F.xxhash64(text).alias("key"),
            ),
            "rows",
        )
        total = rows.agg(F.sum("size")).first()[0] or 0
        part, fine = total / shards, max(1.0, total / (shards * ranges))

        # groups of equal texts that exceed a range: fewer than there are ranges
        large = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > fine).collect()
        large = sorted(((r["key"], r["bytes"]) for r in large), key=lambda x: (-x[1], x[0]))
        small = rows.where(~F.col("key").isin([k for k, _ in large])) if large else rows

        def sample(of: DataFrame, bytes_per_key: float, seed: int) -> list[int]:
            """A row is drawn with the probability size / bytes_per_key."""
            drawn = of.where(_unit(F.lit(seed), F.col("key"), F.col("id")) * bytes_per_key < F.col("size"))
            return sorted(r["key"] for r in drawn.select("key").collect())

        keys = sample(small, fine / SAMPLE, 0)
        splitters = sorted(set(keys[SAMPLE // 2 :: SAMPLE]))
        for r in range(ROUNDS):
            held = dict(small.groupBy(_range_of(F.col("key"), splitters).alias("range")).agg(F.sum("size")).collect())
            over = sorted(k for k, b in held.items() if b > 2 * fine)
            if not over:
                break
            # no text in them exceeds a range, so every overfull range holds several keys
            inside = small.where(_range_of(F.col("key"), splitters).isin(over))
            by_range: dict[int, set[int]] = {}
            for k in sample(inside, fine / (SAMPLE << (r + 1)), r + 1):
                by_range.setdefault(bisect.bisect_right(splitters, k), set()).add(k)
            more = set()
            for of, own in by_range.items():
                own, pieces = sorted(own), 2 * math.ceil(held[of] / fine)
                more.update(own[len(own) * j // pieces] for j in range(1, pieces))
            splitters = sorted({*splitters, *more})
        else:
            raise RuntimeError(f"ranges {over[:5]} are still overfull after {ROUNDS} rounds")

        # ranges of a large group: by a hash of the id, as many as the group has range sizes
        pieces = {k: max(1, round(b / fine)) for k, b in large}
        first = len(splitters) + 1
        base = {}
        for k, _ in large:
            base[k], first = first, first + pieces[k]
        spark = docs.sparkSession
        groups = spark.createDataFrame(
            [(k, base[k], pieces[k]) for k, _ in large], "large_key long, base long, pieces long"
        )
        row = F.monotonically_increasing_id().cast(rows.schema["id"].dataType)  # rows without an id are spread by their place
        placed = rows.withColumn("row", row).join(F.broadcast(groups), F.col("key") == F.col("large_key"), "left").select(
            "id",
            "size",
            "crc",
            "key",
            F.when(F.col("base").isNotNull(), F.col("base") + F.floor(_unit(F.lit(9), F.coalesce("id", "row")) * F.col("pieces")))
            .otherwise(_range_of(F.col("key"), splitters))
            .cast("long")
            .alias("range"),
        )
        placed = scratch.save(placed, "placed")
        held = {
            r["range"]: (r["bytes"], r["n"])
            for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        }
        to = _pack(held, [(base[k], pieces[k], b) for k, b in large], shards, part)
        offsets, used = [], [0] * shards
        for r in sorted(held):
            offsets.append((r, to[r], used[to[r]]))
            used[to[r]] += held[r][1]
        offsets = spark.createDataFrame(offsets, "of_range long, shard int, offset long")
        in_range = Window.partitionBy("range").orderBy("key", "id", "size", "crc")
        return scratch.keep(
            placed.withColumn("place", F.row_number().over(in_range))
            .join(F.broadcast(offsets), F.col("range") == F.col("of_range"))
            .select(
                F.col("id").alias(id_col),
                "size",
                F.col("crc").alias("text_crc32"),
                "shard",
                (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            )
        )


def _pack(
    held: dict[int, tuple[int, int]], large: list[tuple[int, int, int]], shards: int, part: float
) -> dict[int, int]:
    """Range to shard: large groups first, whole unless larger than a part, then runs of the other ranges."""
    load = [0.0] * shards
    to: dict[int, int] = {}
    for base, pieces, size in large:  # largest first, to the emptiest shard
        least = min(range(shards), key=lambda s: (load[s], s))
        if size <= part:
            for r in range(base, base + pieces):
                to[r] = least
            load[least] += size
        else:
            for r in range(base, base + pieces):
                least = min(range(shards), key=lambda s: (load[s], s))
                to[r] = least
                load[least] += held.get(r, (0, 0))[0]
    free = [max(0.0, part - x) for x in load]
    rest = sum(b for r, (b, _) in held.items() if r not in to)
    scale = rest / sum(free) if sum(free) > 0 else 0.0
    ends = np.cumsum([f * scale for f in free])
    reached = 0.0
    for r in sorted(held):
        if r not in to:
            middle = reached + held[r][0] / 2
            to[r] = min(shards - 1, int(np.searchsorted(ends, middle, side="right")))
            reached += held[r][0]
    _level(held, {base + i for base, pieces, size in large if size <= part for i in range(pieces)}, to, shards)
    return to


def _level(held: dict[int, tuple[int, int]], whole: set[int], to: dict[int, int], shards: int) -> None:
    """Moves single ranges, but not those of a group that is kept whole, from the fullest shard to the emptiest."""
    load, own = [0] * shards, [set() for _ in range(shards)]
    for r, (b, _) in held.items():
        load[to[r]] += b
        if r not in whole:
            own[to[r]].add(r)
    for _ in range(8 * shards):
        most, least = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[most] - load[least]
        r = min(own[most], key=lambda r: (abs(held[r][0] - gap / 2), r), default=None)
        if r is None or not 0 < held[r][0] < gap:
            break
        for s, sign in ((most, -1), (least, 1)):
            load[s] += sign * held[r][0]
        own[most].remove(r)
        own[least].add(r)
        to[r] = least
