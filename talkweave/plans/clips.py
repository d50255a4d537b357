"""The flagship: documents to ranked, validated, non-overlapping excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import headline, quote_head, quote_tail
from talkweave.operators.intervals import greedy_mark
from talkweave.operators.signals import CUES, OVERLAP_REASON, SCORES_SQL, VALIDATION_SQL, document_windows, rejections, scored
from talkweave.operators.windows import shown_of_texts
from talkweave.sources.transcripts import WORD_MS, WORD_PITCH_MS

#: Signals that a reason for selection names.
TOLD = ["hook", "question_open", "contrast", "payoff_cue", "has_number", "repeated_claim", "exchange"]


def candidates(docs: DataFrame) -> DataFrame:
    """All scored windows of all documents: numbers and flags only, as rows are grouped from here on."""
    s = scored(document_windows(docs))
    return s.select("doc_id", "duration_ms", F.col("s").alias("ord"), "s", "e", "start_ms", "end_ms", "end_score", "composite", *SCORES_SQL, *TOLD)


def proposals(docs: DataFrame) -> DataFrame:
    """Scored windows that the proposal fold keeps; ``proposal`` is their place."""
    cap = F.least(F.greatest(F.expr("(duration_ms + 29999) div 30000"), F.lit(6)), F.lit(30))
    third = F.greatest(F.expr("duration_ms div 3"), F.lit(1))
    marked = greedy_mark(candidates(docs), "doc_id", -F.col("composite"), 0.25, cap, third=third)
    return marked.where("place is not null").withColumnRenamed("place", "proposal")


def validated(docs: DataFrame) -> DataFrame:
    """Proposals with their reasons for rejection; accepted ones have rank 1, 2, ... ``told`` orders a
    report's rejections: those by rules first, in the order proposed, then overlaps, best first.

    Proposals begin and end with words of their own text and quote it, so snapping and quotes, which
    ``operators.validation`` judges for candidates from outside, can't fail here.
    """
    p = proposals(docs).withColumn("reasons", F.expr(rejections())).withColumn("quality", F.expr(VALIDATION_SQL))
    p = p.withColumn("ord", F.col("proposal"))
    marked = greedy_mark(p, "doc_id", -F.col("quality"), 0.30, containing=True, eligible=F.size("reasons") == 0)
    return with_overlaps(marked)


def with_overlaps(marked: DataFrame) -> DataFrame:
    """Rows of a validator's fold with ``rank``, the reason of those it suppressed, and ``told``."""
    passed = F.size("reasons") == 0
    fallen = passed & F.col("place").isNull()
    told = F.when(F.col("place").isNull(), F.struct(passed.alias("late"), F.when(fallen, -F.col("quality")).alias("best"), F.col("ord").alias("ord")))
    rows = marked.withColumn("told", told).withColumn("reasons", F.when(fallen, F.array(F.lit(OVERLAP_REASON))).otherwise(F.col("reasons")))
    return rows.withColumnRenamed("place", "rank")


def _reason() -> Column:
    """Why a window was chosen, from its flags, in a fixed order."""
    # The clauses and the sentence around them.
    opens = (
        F.when(F.col("x.question_open"), "opens on a direct question")
        .when(F.col("x.hook"), "opens by naming its subject immediately")
        .otherwise("opens on a complete thought")
    )
    clauses = F.array(
        opens,
        F.when(F.col("x.contrast"), "sets up a tension or misconception"),
        F.when(F.col("x.has_number"), "grounds the point in specifics"),
        F.when(F.col("x.exchange"), "contains a quick question-and-answer turn"),
        F.when(F.col("x.repeated_claim"), "repeats its central claim for emphasis"),
        F.when(F.col("x.payoff_cue"), "lands on a stated takeaway before it ends").otherwise("resolves at a natural sentence boundary"),
    )
    return F.concat(F.lit("The excerpt "), F.array_join(clauses, ", "), F.lit(". Selected by local ranking across the full transcript."))


def presented(docs: DataFrame) -> DataFrame:
    """Proposals as a viewer sees them: (doc_id, proposal, headline, opening_quote, closing_quote, selection_reason).

    The headline is the best of a window's first five sentences (:func:`windows.appealing`). Proposals, numbers
    only, join their document's text once; sentences are made again of those documents alone.
    """
    own = proposals(docs).groupBy("doc_id").agg(F.collect_list(F.struct("proposal", "s", "e", *TOLD)).alias("chosen"))
    rows = shown_of_texts(docs.select("doc_id", "text").join(own, "doc_id"), CUES, WORD_PITCH_MS, WORD_MS)
    return rows.select(
        "doc_id",
        "x.proposal",
        headline(F.col("best")).alias("headline"),
        quote_head(F.col("opening")).alias("opening_quote"),
        quote_tail(F.col("closing")).alias("closing_quote"),
        _reason().alias("selection_reason"),
    )
