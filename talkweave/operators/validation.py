"""The validator's gates for candidates from any proposer: bounds, words, scores, duration, verbatim quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import clock, normalize
from talkweave.operators.intervals import greedy_mark, snapped, words_inside

# Slack after the source's end, and how near its end of the excerpt a quote must be, in bytes.
SLACK_MS, ZONE_SHARE, ZONE_BYTES = 500, 4, 160

SCORES = ["self_contained", "opening_strength", "specificity", "tension", "payoff", "clarity", "context_dependency", "slop_risk"]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def bounds_reasons(start: Column, end: Column, duration: Column) -> Column:
    late = F.concat(F.lit("end timestamp "), clock(end), F.lit(" is outside the source duration "), clock(duration))
    return F.filter(
        F.array(F.when(start >= end, "start time is not before end time"), F.when(end > duration + SLACK_MS, late)), lambda r: r.isNotNull()
    )


def quote_reason(excerpt: Column, quote: Column, label: str, near_start: bool) -> Column:
    """Null, or what is wrong with a quote; both texts normalised. An opening counts from its first, a
    closing from its last occurrence; positions are in bytes."""
    size = F.greatest(F.octet_length(excerpt), F.lit(1))
    zone = F.least(F.floor(size / ZONE_SHARE), F.lit(ZONE_BYTES))
    if near_start:
        at = F.octet_length(F.substring(excerpt, F.lit(1), F.instr(excerpt, quote) - 1))
        ok = at <= zone
    else:
        after = F.instr(F.reverse(excerpt), F.reverse(quote)) - 1  # characters behind the last occurrence
        ok = F.octet_length(F.substring(excerpt, F.char_length(excerpt) - after + 1, after)) <= F.least(zone, size)
    return (
        F.when(quote == "", f"{label} quote is empty")
        .when(~F.contains(excerpt, quote), f"{label} quote cannot be found in the transcribed excerpt")
        .when(~ok, f"{label} quote is not near the {'start' if near_start else 'end'} of the excerpt")
    )


def rule_reasons(c: Column, start: Column, end: Column) -> Column:
    """Reasons by scores and duration, in order; and whether only the exception lets the duration pass."""
    low = [("self_contained", 4), ("payoff", 3), ("clarity", 4)]
    high = [("context_dependency", 2), ("slop_risk", 2)]
    by_name = {k: F.when(c[k] < n, F.concat(F.lit(f"{k} "), c[k].cast("string"), F.lit(f" is below {n}"))) for k, n in low}
    by_name |= {k: F.when(c[k] > n, F.concat(F.lit(f"{k} "), c[k].cast("string"), F.lit(f" is above {n}"))) for k, n in high}
    ms = end - start
    usual = ms.between(20_000, 90_000)
    excepted = ms.between(15_000, 110_000) & (c["payoff"] >= 4) & (c["self_contained"] >= 5) & (c["clarity"] >= 4)
    far = F.when(~usual & ~excepted, F.concat(F.lit("duration "), F.floor(ms / 1000).cast("string"), F.lit("s falls outside 20–90 seconds")))
    return F.struct(F.array(*by_name.values(), far).alias("reasons"), (~usual & excepted).alias("excepted"))


def composite(c: Column) -> Column:
    """The rubric's weighted sum, in float and in this order, which decides ties."""
    # The weights.
    weights = [
        ("self_contained", 2.0), ("payoff", 1.6), ("opening_strength", 1.4), ("clarity", 1.2), ("tension", 1.0), ("specificity", 0.8),
        ("context_dependency", -1.5), ("slop_risk", -2.0),
    ]
    out = F.lit(0.0).cast("float")
    for name, w in weights:
        out = out + c[name].cast("float") * F.lit(w).cast("float")
    return out


def judged(candidates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(doc_id, ord, start_ms, end_ms, reasons, excepted, quality) of ``candidates`` (doc_id, ord, start_ms,
    end_ms, opening_quote, closing_quote and the eight scores) by ``transcripts`` (doc_id, words, duration_ms).

    Times are snapped to words where they can be. A candidate out of bounds, or without words, has that
    reason alone; any other has all that apply. A document's candidates meet its words in one row. A
    document without a transcript has no words and lasts 0 ms; null quotes are empty.
    """
    own = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "start_ms", "end_ms", "opening_quote", "closing_quote", *SCORES)).alias("all"))
    kind = transcripts.schema["words"].dataType.simpleString()
    rows = own.join(transcripts.select("doc_id", "words", "duration_ms"), "doc_id", "left").select(
        "doc_id", "all", F.coalesce("words", F.expr(f"cast(array() as {kind})")).alias("words"), F.coalesce("duration_ms", F.lit(0).cast("long")).alias("duration_ms")
    )

    def out(c: Column, start: Column, end: Column, reasons: Column, excepted: Column) -> Column:
        fell = F.filter(reasons, lambda r: r.isNotNull())
        return F.struct(
            c["ord"].alias("ord"), start.alias("start_ms"), end.alias("end_ms"), fell.alias("reasons"), excepted.alias("excepted"), composite(c).alias("quality")
        )

    def quoted(c: Column, at: Column) -> Column:
        said = normalize(F.array_join(F.transform(words_inside(F.col("words"), at["start_ms"], at["end_ms"]), lambda w: w["text"]), " "))
        rules = rule_reasons(c, at["start_ms"], at["end_ms"])
        first, last = (normalize(F.coalesce(c[q], F.lit(""))) for q in ("opening_quote", "closing_quote"))

        def full(x: Column) -> Column:
            quotes = F.array(quote_reason(x["said"], x["first"], "opening", True), quote_reason(x["said"], x["last"], "closing", False))
            return out(c, at["start_ms"], at["end_ms"], F.concat(x["rules"]["reasons"], quotes), x["rules"]["excepted"])

        return bound(F.struct(said.alias("said"), first.alias("first"), last.alias("last"), rules.alias("rules")), full)

    def one(c: Column) -> Column:
        outside = bounds_reasons(c["start_ms"], c["end_ms"], F.col("duration_ms"))
        silent = F.array(F.lit("interval contains no transcribed words"))
        no = F.lit(False)
        return bound(
            snapped(F.col("words"), c["start_ms"], c["end_ms"]),
            lambda at: F.when(F.size(outside) > 0, out(c, c["start_ms"], c["end_ms"], outside, no))
            .when(at.isNull(), out(c, c["start_ms"], c["end_ms"], silent, no))
            .otherwise(quoted(c, at)),
        )

    return rows.select("doc_id", F.inline(F.transform("all", one)))


def validated(candidates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``judged`` with ``place``: 1, 2, ... for those without a reason that no better one covers, best first."""
    rows = judged(candidates, transcripts)
    return greedy_mark(rows, "doc_id", -F.col("quality"), 0.30, containing=True, eligible=F.size("reasons") == 0)
