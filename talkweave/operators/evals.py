"""Run reports, rubric review and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUBRIC_SCORES = ["hook_1to5", "standalone_1to5", "payoff_1to5", "caption_accuracy_1to5", "framing_1to5", "would_post_1to5"]
DEFAULT_POLICY = {"max_new_source_failures": 0, "max_would_post_rate_drop": 0.05, "max_average_score_drop": 0.25}


def rejection_is_duplicate(reasons: Column) -> Column:
    return F.exists(reasons, lambda r: F.lower(r).contains("overlap") | F.lower(r).contains("duplicate"))


def operational(sources: DataFrame, *by: str) -> DataFrame:
    """Totals and rates over source rows, for all of them or by columns; failed_clips and duration_seconds
    (numbers only) are summed where the sources have them."""
    done = F.count_if(F.col("status") == "complete")
    candidates = F.sum(F.col("accepted") + F.col("rejected"))
    grouped = sources.groupBy(*by) if by else sources
    more = []
    if "failed_clips" in sources.columns:
        more.append(F.coalesce(F.sum("failed_clips"), F.lit(0)).alias("failed_clips"))
    if "duration_seconds" in sources.columns:
        more.append(F.round(F.coalesce(F.sum(F.col("duration_seconds").try_cast("double")), F.lit(0.0)), 3).alias("total_duration_seconds"))
    return grouped.agg(
        F.count("*").alias("source_count"),
        done.alias("completed_sources"),
        F.count_if(F.col("status") == "failed").alias("failed_sources"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled_sources"),
        F.round(F.try_divide(done.cast("double"), F.count("*")), 3).alias("completion_rate"),
        F.sum("ready_clips").alias("ready_clips"),
        F.sum("accepted").alias("accepted_candidates"),
        F.sum("rejected").alias("rejected_candidates"),
        F.sum("duplicate_rejections").alias("duplicate_rejections"),
        F.round(F.try_divide(F.sum("duplicate_rejections").cast("double"), candidates), 3).alias("duplicate_rate"),
        *more,
    )


def counters(sources: DataFrame, *columns: str) -> DataFrame:
    """(counter, value, n): how many sources have each value of each column, null being ``unknown``.

    One pass for all columns; rows combine before the shuffle.
    """
    said = F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns]))
    return sources.select(said).groupBy("counter", "value").agg(F.count("*").alias("n"))


def rubric_rows(raw: DataFrame, scores: list[str] = RUBRIC_SCORES) -> DataFrame:
    """Rubric rows with numeric scores and ``valid`` (every given score a number from 1 to 5)."""
    checks = [F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) | F.coalesce(F.col(c).try_cast("double").between(1, 5), F.lit(False)) for c in scores]
    blank = [F.coalesce(F.trim(F.col(c)) == "", F.lit(True)) for c in scores]
    valid, empty = checks[0], blank[0]
    for x, y in zip(checks[1:], blank[1:]):
        valid, empty = valid & x, empty & y
    return raw.where(~empty).withColumn("valid", valid).withColumns({c: F.col(c).try_cast("double") for c in scores})


def invalid_rows(rows: DataFrame, row: str = "row") -> DataFrame:
    """The numbers of the rubric rows that can't be used."""
    return rows.where(~F.col("valid")).select(row)


def review(rows: DataFrame, scores: list[str] = RUBRIC_SCORES) -> DataFrame:
    """One row: reviewed, would_post_count and would_post_rate (of all reviewed), averages over the scores present, decision errors."""
    good = rows.where("valid").withColumn("decision_error", F.lower(F.trim("decision_error")))
    posted = F.count_if(F.col("would_post_1to5") >= 4)
    return good.agg(
        F.count("*").alias("reviewed"),
        posted.alias("would_post_count"),
        F.round(F.try_divide(posted.cast("double"), F.count("*")), 3).alias("would_post_rate"),
        *[F.round(F.avg(c), 3).alias(c) for c in scores],
        F.count_if(F.col("decision_error") == "false_accept").alias("false_accepts"),
        F.count_if(F.col("decision_error") == "false_reject").alias("false_rejects"),
    )


def new_failures(current: DataFrame, baseline: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return current.where(failed).select("source_id").join(baseline.where(failed).select("source_id"), "source_id", "left_anti").distinct()


def latest(events: DataFrame, key: str, at: str) -> DataFrame:
    """Each key's last row, by a grouped maximum that combines before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("x")).select(key, "x.*")


def streaks(polls: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """(key, longest): the longest run of consecutive failures."""
    order = Window.partitionBy(key).orderBy(at)
    island = F.row_number().over(order) - F.sum(F.col("f")).over(order)
    runs = polls.withColumn("f", failed.cast("int")).withColumn("island", island).where("f = 1").groupBy(key, "island").count()
    return runs.groupBy(key).agg(F.max("count").alias("longest"))


def gate(current: DataFrame, baseline: DataFrame, failures: DataFrame, policy: dict | None = None, scores: list[str] = RUBRIC_SCORES) -> DataFrame:
    """One row (status, failure_reasons, warnings) from two one-row reviews and the new failures (source_id).

    A rate or average fails by dropping more than the policy allows; where either run has none it is
    a warning, except that scores missing from the baseline aren't compared.
    """
    allowed = DEFAULT_POLICY | (policy or {})
    cols = ["would_post_rate", *scores]
    lost = failures.agg(F.array_sort(F.collect_set("source_id")).alias("lost"))
    both = current.select(*[F.col(c).alias(f"c_{c}") for c in cols]).crossJoin(baseline.select(*[F.col(c).alias(f"b_{c}") for c in cols])).crossJoin(lost)
    reasons = [F.when(F.size("lost") > allowed["max_new_source_failures"], F.concat(F.lit("new source failures: "), F.array_join(F.col("lost").cast("array<string>"), ", ")))]
    warnings = [F.when(F.col("c_would_post_rate").isNull() | F.col("b_would_post_rate").isNull(), "would-post comparison unavailable until both runs are reviewed")]

    def dropped(c: str, most: float, what: str) -> Column:
        drop = F.round(F.col(f"b_{c}") - F.col(f"c_{c}"), 3)
        return F.when(drop > most, F.format_string(f"{what} dropped by %.3f", drop))

    reasons.append(dropped("would_post_rate", allowed["max_would_post_rate_drop"], "would-post rate"))
    for c in scores:
        reasons.append(dropped(c, allowed["max_average_score_drop"], f"{c} average"))
        warnings.append(F.when(F.col(f"b_{c}").isNotNull() & F.col(f"c_{c}").isNull(), f"{c} comparison unavailable"))
    out = both.select(F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("failure_reasons"), F.filter(F.array(*warnings), lambda w: w.isNotNull()).alias("warnings"))
    return out.select(F.when(F.size("failure_reasons") > 0, "fail").otherwise("pass").alias("status"), "failure_reasons", "warnings")
