"""Candidates by a language model: a request for each window of a transcript, and its replies made one list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import clock, clock_precise, plan_counts
from talkweave.operators.intervals import greedy_mark
from talkweave.operators.segments import HOP_MS, SIZE_MS, window_sentences

# Fixed value: share of a candidate that a better one may cover.
SAME_SHARE = 0.55


def window_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, duration_ms, win, start_ms, end_ms, lines): each window's sentences, one a line."""
    s = window_sentences(rows)
    line = F.concat(F.lit("["), clock_precise(F.col("start_ms")), F.lit(" --> "), clock_precise(F.col("end_ms")), F.lit("] "), F.col("text"), F.lit("\n"))
    held = F.array_sort(F.collect_list(F.when(F.col("sent_ord").isNotNull(), F.struct("sent_ord", line.alias("line")))))
    lines = s.groupBy("doc_id", "duration_ms", "win").agg(held.alias("held"))
    text = F.array_join(F.transform("held", lambda x: x["line"]), "")
    start = (F.col("win") * HOP_MS).cast("long")
    whole = F.size("held") == 0  # the one window of a source without sentences
    end = F.when(whole, F.col("duration_ms")).otherwise(F.least(start + SIZE_MS, F.col("duration_ms")))
    return lines.select("doc_id", "duration_ms", "win", start.alias("start_ms"), end.alias("end_ms"), text.alias("lines"))


def prompts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, win, per_window, prompt): what a model is asked about each window of ``rows``
    (:func:`segments.sentence_rows`); ``names`` (doc_id, filename)."""
    w = window_lines(rows)
    plan = plan_counts(F.col("duration_ms"))
    windows = w.groupBy("doc_id").agg(F.count("*").alias("windows"))
    w = w.join(windows, "doc_id").join(names, "doc_id", "left").withColumn("plan", plan)
    share = F.ceil(F.col("plan.proposals") / F.col("windows"))

    def said(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("")) for x in parts])

    # The words of the request.
    text = said(
        'Source: "', F.col("filename"), '" — total duration ', clock(F.col("duration_ms")), " (", F.col("duration_ms"), " ms). Planning target for the whole source: about ",
        F.col("plan.target"), " clip(s); this is guidance, not a quota.\n\nTranscript window (", clock(F.col("start_ms")), " → ", clock(F.col("end_ms")),
        "), one sentence per line as [start --> end] text:\n\n", F.col("lines"), "\n\nPropose up to ", F.greatest(share, F.lit(2)),
        " strong candidates from THIS window only. Timestamps are absolute source milliseconds. Remember: return only the JSON object.",
    )
    return w.select("doc_id", "win", F.greatest(share, F.lit(2)).cast("long").alias("per_window"), text.alias("prompt"))


def worth(c: Column) -> Column:
    """By what the better of two alike candidates is told."""
    return c["self_contained"] + c["payoff"] + c["opening_strength"] + c["clarity"] - c["context_dependency"] - c["slop_risk"]


def united(candidates: DataFrame) -> DataFrame:
    """The candidates (doc_id, win, nth, start_ms, end_ms, scores: a struct, ...) of all windows of a source, best
    first, ``place`` counting from 1; of two that share more than 55 % of the worse one, the better stays.

    A source of one window keeps all that the model gave, in its order. ``windows`` (how many were
    asked about) comes with each row; equals stay in the order of windows and replies.
    """
    ord_ = F.struct("win", "nth")
    rows = candidates.withColumn("ord", (F.col("win").cast("long") * (1 << 20) + F.col("nth")).cast("int"))
    many = F.col("windows") > 1
    rank = F.struct(F.when(many, -worth(F.col("scores"))).alias("worth"), ord_.alias("ord"))
    marked = greedy_mark(rows.where(many), "doc_id", rank, SAME_SHARE)
    own = rows.where(~many).withColumn("place", (F.col("nth") + 1).cast("int"))
    return marked.where("place is not null").unionByName(own).drop("ord")
