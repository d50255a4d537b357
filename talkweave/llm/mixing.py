"""Mixing sources to target weights by block quotas and a multivariate-hypergeometric splitting tree.

Every source's rows fall into ``BLOCKS`` blocks by a hash of the id. A source's target in words
becomes a quota of block draws: whole passes over its blocks and a run of further blocks, the last of
them in part. The tree shares these quotas among output shards: each node draws, source by source,
how many of its blocks go to its left half. Leaves then own disjoint runs of each source's permuted
blocks, and a row is taken as often as leaves drew its block. All of it is DataFrame work; what has a
row per source, per block or per tree node stays small, and rows themselves are never sorted together.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch

BLOCK_BITS = 12
BLOCKS = 1 << BLOCK_BITS
MOST_COPIES = 3
FAN = 256  # sources, or bundles of them, that one fold of the tree passes over


def word_count(text: Column) -> Column:
    """Words are runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _md5_number(said: Column, digits: int) -> Column:
    """The first hexadecimal digits of MD5 as a number."""
    return F.conv(F.substring(F.md5(said), 1, digits), 16, 10).cast("long")


def row_hash(id_: Column, text: Column, seed: int) -> Column:
    """60 bits of MD5 over seed and id: the place of a row in its source's permutation. Rows without an
    id are told apart by their texts."""
    own = F.coalesce(id_.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return _md5_number(F.concat(F.lit(f"mix:{seed}:"), own), 15)


def _targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with weights 1, 2, 3, ... and targets by water filling.

    Each source gets weight * level, but at most MOST_COPIES times its size; the level is what makes
    the sum 100 % of all sizes. Sources are full in order of cap / weight, so running sums over that
    order give the level in one pass.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.asc_nulls_last("source"))
    fill = every.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * MOST_COPIES)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open_weight").cast("double"))
        # the first source, in this order, that its cap doesn't stop sets the level for the rest
        .withColumn("stopped", F.col("cap").cast("double") <= F.col("weight").cast("double") * F.col("level"))
        .withColumn("place", F.row_number().over(fill))
        .withColumn("open_level", F.min(F.when(~F.col("stopped"), F.struct("place", "level"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
                F.col("weight").cast("double") * F.col("open_level")["level"]
            ),
        )
        .select("source", "source_size", "weight", "target")
    )


def _uniform(said: Column) -> Column:
    """A number in [0, 1) that depends on nothing but what is said."""
    return _md5_number(said, 13).cast("double") / F.lit(float(1 << 52))


def _hypergeometric(u: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` are marked, by inverting the distribution at ``u``.

    Weights follow from the ratio of neighbouring terms, over 12 standard deviations and 20 on
    either side of the mean (what lies beyond is less than a double can tell) or the whole support.
    """
    N, K, n = (c.cast("double") for c in (population, marked, drawn))
    low = F.greatest(F.lit(0).cast("long"), drawn - (population - marked))
    high = F.least(drawn, marked)
    mean = n * K / F.greatest(N, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (1 - K / F.greatest(N, F.lit(1.0))) * (N - n) / F.greatest(N - 1, F.lit(1.0)), F.lit(0.0)))
    reach = F.ceil(12 * spread).cast("long") + 20
    first = F.greatest(low, F.floor(mean).cast("long") - reach)
    last = F.least(high, F.floor(mean).cast("long") + reach)

    def step(a: Column, k: Column) -> Column:  # to the weight of k + 1
        x = k.cast("double")
        return a["weight"] * ((K - x) * (n - x) / ((x + 1) * (N - K - n + x + 1)))

    def summed(a: Column, k: Column) -> Column:
        return F.struct(step(a, k).alias("weight"), (a["sum"] + step(a, k)).alias("sum"))

    def walked(a: Column, k: Column) -> Column:
        past = a["sum"] <= a["goal"]
        return F.struct(
            step(a, k).alias("weight"),
            (a["sum"] + step(a, k)).alias("sum"),
            F.when(past, k + 1).otherwise(a["k"]).alias("k"),
            a["goal"].alias("goal"),
        )

    ks = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    one = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"))
    goal = u * F.aggregate(ks, one, summed)["sum"]
    start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), first.alias("k"), goal.alias("goal"))
    return F.aggregate(ks, start, walked)["k"]


def _tree(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, rank, quota): how many blocks of each source (rank, draws) every shard gets.

    A node with m shards passes floor(m / 2) / m of its blocks to the left, shared among its sources by
    a multivariate hypergeometric draw: a fold over them in order of rank, each drawing from what is
    left. A fold passes over ``FAN`` entries at most; of more sources, bundles of ranks are drawn
    first and then shared within each bundle, so no row ever holds all sources.
    """
    top = sources.agg(F.max("rank")).first()[0] or 0
    levels = 1
    while FAN**levels <= top:
        levels += 1

    def shared(parts: DataFrame, level: int, drawn: DataFrame | None) -> DataFrame:
        """(shard, width, part, left) from (shard, width, part, q), a part being ``FAN ** level`` ranks."""
        bundle = F.floor(F.col("part") / FAN).cast("long") if drawn is not None else F.lit(0).cast("long")
        rows = parts.groupBy("shard", "width", bundle.alias("bundle")).agg(
            F.array_sort(F.collect_list(F.struct("part", "q"))).alias("parts"), F.sum("q").alias("total")
        )
        if drawn is None:
            rows = rows.withColumn("share", F.expr("cast(total * (width div 2) div width as bigint)"))
        else:
            rows = rows.join(drawn.select("shard", F.col("part").alias("bundle"), F.col("left").alias("share")), ["shard", "bundle"])
        none = F.array().cast("array<struct<part:bigint,q:bigint,left:bigint>>")
        start = F.struct(F.col("total").alias("population"), F.col("share").alias("drawn"), none.alias("out"))

        def draw(a: Column, x: Column) -> Column:
            said = F.concat_ws(":", F.lit(f"draw:{seed}"), "shard", "width", F.lit(str(level)), x["part"].cast("string"))
            k = _hypergeometric(_uniform(said), a["population"], x["q"], a["drawn"])
            return F.transform(  # binds k, so that it is computed once
                F.array(k),
                lambda k: F.struct(
                    (a["population"] - x["q"]).alias("population"),
                    (a["drawn"] - k).alias("drawn"),
                    F.concat(a["out"], F.array(F.struct(x["part"].alias("part"), x["q"].alias("q"), k.alias("left")))).alias("out"),
                ),
            )[0]

        return rows.select("shard", "width", F.inline(F.aggregate("parts", start, draw)["out"]))

    nodes = sources.select(F.lit(0).alias("shard"), F.lit(shards).alias("width"), F.col("rank").cast("long").alias("part"), F.col("draws").alias("q"))
    widest = shards
    while widest > 1:
        wide, drawn = nodes.where("width > 1"), None
        for level in reversed(range(levels)):
            part = F.floor(F.col("part") / FAN**level).cast("long")
            parts = wide if level == 0 else wide.groupBy("shard", "width", part.alias("part")).agg(F.sum("q").alias("q"))
            drawn = shared(parts, level, drawn)
        half = F.expr("width div 2").cast("int")
        halves = F.array(
            F.struct(F.col("shard"), half.alias("width"), F.col("left").alias("q")),
            F.struct((F.col("shard") + half).alias("shard"), (F.col("width") - half).alias("width"), (F.col("q") - F.col("left")).alias("q")),
        )
        below = drawn.select("part", F.inline(halves)).select("shard", "width", "part", "q")
        # only where shards are not a power of two are some nodes done early
        nodes = below if shards & (shards - 1) == 0 else below.union(nodes.where("width <= 1"))
        widest = (widest + 1) // 2
    return nodes.select("shard", F.col("part").alias("rank"), F.col("q").alias("quota"))


def mix(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: (id, source, size, source_size, target, shards, places).

    ``size`` is in words. ``shards`` lists the output shards whose leaves drew the row's block, one
    element for each draw (none if the mix leaves the row out), and ``places`` the order of each copy
    within its shard. Sources weigh 1, 2, 3, repeating, by code point with null last; a target stops
    at three times its source's size, which hands the rest to the others by weight. A source's quota of
    draws is ``passes`` times all its blocks, and then its blocks in hash order up to the one where the
    words pass the target; of that one only rows up to the cut are taken, the last place before they
    pass it: found in block sums, then in the sums of the sub-blocks of one block, then in the hashes
    of one sub-block. Only those sums and the hashes of one sub-block in 16 million per source meet in
    one task. One row beyond the cut, if that brings the source nearer to its target, joins the last draw.
    A row per source (not its rows) meets in one task, for ranks and targets.

    Defined results: null texts have size 0, as have empty ones; a text of any length is one row and
    never split; a source with no words has target 0 and no copies; rows without an id are told apart
    by text; rows that repeat an id (or lack it and repeat a text) within a source have equal hashes
    and share a verdict, which is how ties of the order are settled; sources whose cap comes at the
    same level stop in order of code point; other columns, whatever their names, are neither read nor
    returned; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        mixed = _mix(scratch, docs, shards, seed, id_col, text_col, source_col)
        return scratch.keep(mixed.drop("h").withColumnRenamed("id", id_col))


def _mix(scratch: Scratch, docs: DataFrame, shards: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, h, source, size, source_size, target, shards, places) as :func:`mix` says."""
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            row_hash(F.col(id_col), F.col(text_col), seed).alias("h"),
        ),
        "rows",
    )
    block, sub = F.expr(f"h >> {60 - BLOCK_BITS}"), F.expr(f"(h >> {60 - 2 * BLOCK_BITS}) & {BLOCKS - 1}")
    blocks = scratch.save(
        rows.groupBy("source", block.alias("block")).agg(F.sum("size").alias("words")), "blocks"
    )
    sources = scratch.save(
        _targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
        .withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - (F.col("passes") * F.col("source_size")).cast("double")),
        "sources",
    )

    def last_within(parts: DataFrame, at: list[str]) -> DataFrame:
        """Of each source's ordered parts, the first that reaches past the rest, and the rest there."""
        run = Window.partitionBy("source").orderBy(*at)
        return (
            parts.withColumn("end", F.sum("words").over(run))
            .where("end > rest")
            .groupBy("source")
            .agg(F.min(F.struct(*at, (F.col("rest") - F.col("end") + F.col("words")).alias("rest"))).alias("x"))
            .select("source", *[f"x.{c}" for c in at], "x.rest")
        )

    def with_rest(parts: DataFrame, rest: DataFrame, on: list[str]) -> DataFrame:
        rest = rest.select(F.col("source").alias("of"), "rest", *[F.col(c).alias(f"of_{c}") for c in on])
        same = F.col("source").eqNullSafe(F.col("of"))
        for c in on:
            same = same & (F.col(c) == F.col(f"of_{c}"))
        return parts.join(rest, same).drop("of", *[f"of_{c}" for c in on])

    edge = scratch.save(last_within(with_rest(blocks, sources, []), ["block"]), "edge")
    subs = with_rest(rows.withColumn("block", block), edge, ["block"])
    subs = subs.groupBy("source", "block", sub.alias("sub"), "rest").agg(F.sum("size").alias("words"))
    edge = scratch.save(last_within(subs, ["block", "sub"]), "edge")
    last = with_rest(rows.withColumn("block", block).withColumn("sub", sub), edge, ["block", "sub"])
    last = last.groupBy("source", "block", "sub", "rest", "h").agg(F.sum("size").alias("size"))  # rows of one hash are one
    run = Window.partitionBy("source").orderBy("h")
    cut = scratch.save(
        last.withColumn("end", F.sum("size").over(run))
        .groupBy("source", "block")
        .agg(
            F.max(F.when(F.col("end") <= F.col("rest"), F.struct("h", (F.col("rest") - F.col("end")).alias("gap")))).alias("at"),
            F.min(F.struct(F.col("h") - 1, "rest")).alias("start"),
        )
        .select(
            F.col("source").alias("of"),
            F.col("block").alias("cut_block"),
            F.coalesce("at.h", "start.col1").alias("cut"),
            F.coalesce("at.gap", "start.rest").alias("gap"),
        ),
        "cut",
    )
    # one row beyond the cut, whose size is nearest to the words still wanted
    same_source = F.col("source").eqNullSafe(F.col("of"))
    extra = (
        rows.join(cut, same_source)
        .where("h > cut and abs(gap - size) < gap")
        .groupBy("of", "cut_block", "cut")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "h")).alias("x"))
        .select(F.col("of").alias("extra_of"), F.col("x.h").alias("extra"))
    )
    cut = scratch.save(
        cut.join(extra, F.col("of").eqNullSafe(F.col("extra_of")), "left").select("of", "cut_block", "cut", "extra"), "cut"
    )
    # draws: whole passes, the blocks before the cut's, and the cut's own block in part
    quotas = sources.join(
        cut,
        same_source,
        "left",
    ).select(
        "source",
        "source_size",
        "target",
        "passes",
        F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"),
        F.coalesce("extra", F.lit(-1).cast("long")).alias("extra"),
        "cut_block",
        (F.when(F.col("source_size") > 0, F.col("passes") * BLOCKS).otherwise(0) + F.coalesce(F.col("cut_block") + 1, F.lit(0))).cast("long").alias("draws"),
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1).alias("rank"),
    )
    quotas = scratch.save(quotas, "quotas")
    tree = scratch.save(_tree(quotas, shards, seed), "tree")
    # where each leaf's run of a source's draws ends: what it drew, on top of the leaves before
    ends = (
        tree.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
        .groupBy("rank")
        .agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("ends"))
        .select("rank", F.transform("ends", lambda e: e["end"]).alias("ends"))
    )
    plan = scratch.save(
        quotas.join(ends, "rank").select(F.col("source").alias("of"), "source_size", "target", "passes", "cut", "extra", "cut_block", "ends"), "plan"
    )
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("turns", _turns(block, seed))
        .select(
            "id",
            "h",
            "source",
            "size",
            "source_size",
            "target",
            F.transform("turns", lambda t: t["shard"]).alias("shards"),
            F.transform("turns", lambda t: _md5_number(F.concat_ws(":", F.lit(f"place:{seed}"), "h", t["turn"].cast("string")), 15)).alias("places"),
        )
    )


def _turns(block: Column, seed: int) -> Column:
    """(turn, shard) for every time that a leaf drew the row's block, as far as the row is in it.

    A whole pass draws blocks in a permuted order of its own; the pass at the end follows the hash,
    which is a permutation already, and ends in the cut's block.
    """
    whole = [
        F.pmod(block * F.lit(4 * (int(hashlib.md5(f"turn:{seed}:{c}".encode()).hexdigest()[:6], 16) % (BLOCKS // 4)) + 1) + c, F.lit(BLOCKS))
        for c in range(MOST_COPIES)
    ]
    at_end = F.when(F.col("h") == F.col("extra"), F.least(block, F.col("cut_block"))).otherwise(block)
    in_end = (block < F.col("cut_block")) | (F.col("h") <= F.col("cut")) | (F.col("h") == F.col("extra"))
    turns = [
        F.when(F.lit(c) < F.col("passes"), F.struct(F.lit(c).alias("turn"), (F.lit(c * BLOCKS) + at).alias("draw"))) for c, at in enumerate(whole)
    ]
    turns.append(F.when(in_end, F.struct(F.col("passes").cast("int").alias("turn"), (F.col("passes") * BLOCKS + at_end).alias("draw"))))
    placed = F.transform(
        F.filter(F.array(*turns), lambda t: t.isNotNull()),
        lambda t: F.struct(t["turn"].alias("turn"), F.size(F.filter("ends", lambda e: e <= t["draw"])).alias("shard")),
    )
    return F.filter(placed, lambda t: t["shard"] < F.size("ends"))  # beyond the last leaf's run nothing was drawn


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``, repeated as often as it takes them,
    in the order of its shards, each shuffled locally by the places drawn.

    Defined results: as :func:`mix`; rows it takes keep nulls and all columns, whatever their names;
    an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        mixed = _mix(scratch, docs, shards, seed, id_col, text_col, source_col)
        at = F.explode(F.arrays_zip("shards", "places")).alias("at")
        taken = mixed.select(F.col("h").alias("taken_h"), F.col("source").alias("taken_source"), "shards", "places").distinct()
        taken = scratch.keep(taken.select("taken_h", "taken_source", at).select("taken_h", "taken_source", "at.*"))
    rows = docs.select(F.struct("*").alias("row"), row_hash(F.col(id_col), F.col(text_col), seed).alias("h"), F.col(source_col).cast("string").alias("source"))
    drawn = rows.join(taken, (F.col("h") == F.col("taken_h")) & F.col("source").eqNullSafe(F.col("taken_source")))
    return _shuffled(drawn, "shards", "places").select("row.*")


def _shuffled(rows: DataFrame, shard: str, place: str) -> DataFrame:
    """Rows by shard, each shard in the order of its places; a shard is dealt to several tasks."""
    return rows.repartition(F.col(shard), F.pmod(F.col(place), F.lit(64))).sortWithinPartitions(shard, place)


def write_mix(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, id_col: str = "doc_id") -> None:
    """Writes (id, size, source, place) of the mix's copies as ``shard=K`` folders, shuffled within each.

    Defined results: as :func:`mix`; an empty table writes a folder without rows.
    """
    out = mix(docs, shards, seed, id_col).select(id_col, "source", "size", F.explode(F.arrays_zip("shards", "places")).alias("at"))
    out = out.select(id_col, "source", "size", F.col("at.shards").alias("shard"), F.col("at.places").alias("place"))
    _shuffled(out, "shard", "place").write.partitionBy("shard").parquet(path)
