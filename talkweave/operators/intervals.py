"""Order-dependent interval suppression as folds, and interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import overlap_ms


def greedy_mark(
    rows: DataFrame,
    key: str,
    rank: Column,
    share: float,
    limit: Column | None = None,
    containing: bool = False,
    third: Column | None = None,
    eligible: Column | None = None,
) -> DataFrame:
    """All ``rows`` plus ``place``: 1, 2, ... for the intervals that are kept, best first; else null.

    ``rank`` ascending is best first, then ``ord``. An interval falls if a kept one covers more than
    ``share`` of it, or (``containing``) if it contains a kept one. ``limit`` stops after so many; with
    ``third`` (a third of the source) no third gets more than max(limit div 2, 2). Rows that aren't
    ``eligible`` are passed over. Only kept rows suppress, so this is a fold over each key's rows, not
    an anti-join; rows pass through it once, payload and all, so nothing is joined back.
    """
    payload = F.struct(*[F.col(c) for c in rows.columns])
    item = F.struct(
        rank.alias("rank"), F.col("ord"), F.col("start_ms"), F.col("end_ms"), (F.lit(True) if eligible is None else eligible).alias("ok"), payload.alias("row")
    )
    cap = (limit if limit is not None else F.lit(None)).cast("long")
    grouped = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.first(cap).alias("cap"),
        F.first(third if third is not None else F.lit(1).cast("long")).alias("third"),
    )
    zero = F.expr("cast(array() as array<struct<ord:int,start_ms:bigint,end_ms:bigint>>)")

    def step(a: Column, x: Column) -> Column:
        def hits(k: Column) -> Column:
            shared = overlap_ms(k["start_ms"], k["end_ms"], x["start_ms"], x["end_ms"]).cast("double")
            over = shared / F.greatest(x["end_ms"] - x["start_ms"], F.lit(1)) > share
            return over | ((x["start_ms"] <= k["start_ms"]) & (x["end_ms"] >= k["end_ms"])) if containing else over

        def region(y: Column) -> Column:
            return F.least(F.floor(y["start_ms"] / F.col("third")), F.lit(2))

        fall = ~x["ok"]
        if limit is not None:
            fall = fall | (F.size(a) >= F.col("cap"))
        fall = fall | F.exists(a, hits)
        if third is not None:
            fall = fall | (F.size(F.filter(a, lambda k: region(k) == region(x))) >= F.greatest(F.floor(F.col("cap") / 2), F.lit(2)))
        new = F.struct(x["ord"].alias("ord"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))
        return F.when(fall, a).otherwise(F.concat(a, F.array(new)))

    kept = F.transform(F.aggregate("items", zero, step), lambda k: k["ord"])
    marked = grouped.select("items", kept.alias("kept")).select("kept", F.explode("items").alias("item"))
    return marked.select("item.row.*", F.nullif(F.array_position("kept", F.col("item.ord")), F.lit(0)).cast("int").alias("place"))


def words_inside(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["start_ms"] >= start) & (w["end_ms"] <= end))


def snapped(words: Column, start: Column, end: Column) -> Column:
    """struct (start_ms, end_ms): from the first word that ends after ``start`` to the last that starts
    before ``end``; null where no words lie between."""
    first = F.try_element_at(F.filter(words, lambda w: w["end_ms"] > start), F.lit(1))["start_ms"]
    last = F.try_element_at(F.filter(words, lambda w: w["start_ms"] < end), F.lit(-1))["end_ms"]
    return F.when(first < last, F.struct(first.alias("start_ms"), last.alias("end_ms")))


def interval_confidence(words: Column, start: Column, end: Column) -> Column:
    """Mean probability of the words inside; 1 without any."""
    inside = words_inside(words, start, end)
    total = F.aggregate(inside, F.lit(0.0), lambda a, w: a + w["p"].cast("double"))
    return F.coalesce(F.try_divide(total, F.size(inside)), F.lit(1.0))


def snap_to_words(intervals: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Two-sided as-of of ``intervals`` (doc_id, ord, start_ms, end_ms): (..., snapped_start, snapped_end,
    confidence). A document's intervals meet its words in one row, and each searches the array; documents
    without words give nulls and a confidence of 1."""
    own = intervals.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "start_ms", "end_ms")).alias("intervals"))

    def at(x: Column) -> Column:
        s = snapped(F.col("words"), x["start_ms"], x["end_ms"])
        return F.struct(
            x["ord"].alias("ord"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), s["start_ms"].alias("snapped_start"),
            s["end_ms"].alias("snapped_end"), interval_confidence(F.col("words"), x["start_ms"], x["end_ms"]).alias("confidence"),
        )

    rows = own.join(transcripts.select("doc_id", "words"), "doc_id", "left")
    kind = transcripts.schema["words"].dataType.simpleString()
    rows = rows.withColumn("words", F.coalesce("words", F.expr(f"cast(array() as {kind})")))
    return rows.select("doc_id", F.inline(F.transform("intervals", at)))
