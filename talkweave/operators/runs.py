"""Life of a run: stage records, retries and resumption, leases, outcomes, and what a viewer is told.

A project's log holds some dozens of events (seven stages, retried now and then), so it folds in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.functions.text import STAGES, clock

# Sources shorter than this are captioned whole, and how long a cancellation waits.
SHORT_MS, CANCEL_MS = 20_000, 5_000
# Why a stage is passed over.
SKIPPED = {
    "inspecting": "Already inspected",
    "extracting_audio": "Transcript already on disk",
    "transcribing": "Transcript already on disk",
    "selecting_candidates": "Proposals already on disk",
    "analyzing_layout": "Layouts already planned",
}
CHANNEL_CAPACITY = 512

_RECORD = "struct<name:string,started_at:bigint,completed_at:bigint,progress:double,detail:string,error:string>"


def _record(name: Column, started: Column, completed: Column, progress: Column, detail: Column, error: Column) -> Column:
    return F.struct(
        name.alias("name"), started.cast("long").alias("started_at"), completed.cast("long").alias("completed_at"),
        progress.cast("double").alias("progress"), detail.cast("string").alias("detail"), error.cast("string").alias("error"),
    )


def _blank(name: Column) -> Column:
    null = F.lit(None)
    return _record(name, null, null, null, null, null)


def _after(r: Column, e: Column) -> Column:
    """A stage's record after an event of its own."""
    name, at, said, null = r["name"], e["at_ms"], e["detail"], F.lit(None)
    return (
        F.when(e["kind"] == "begin", _record(name, at, null, F.lit(0.0), r["detail"], null))
        .when(e["kind"] == "complete", _record(name, r["started_at"], at, F.lit(1.0), said, r["error"]))
        .when((e["kind"] == "skip") & r["completed_at"].isNull(), _record(name, at, at, F.lit(1.0), said, r["error"]))
        .when(e["kind"] == "fail", _record(name, r["started_at"], r["completed_at"], r["progress"], r["detail"], said))
        .when(
            e["kind"] == "cancel",
            _record(name, F.coalesce(r["started_at"], at), at, F.coalesce(r["progress"], F.lit(0.0)), F.lit("Cancelled"), null),
        )
        .otherwise(r)
    )


def stage_records(events: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, status, error, stages): the state that a log of (key, seq, kind, stage, at_ms, detail) leads to.

    Kinds are begin, complete, skip, fail, cancel, retry and finish; retry and finish name no stage. A
    retry blanks the records of stages that failed or were cancelled. ``stages`` holds all seven, in
    order. Events of unknown kind or stage change no record; a null detail stays null.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "stage", F.col("at_ms").cast("long").alias("at_ms"), "detail")))
    fresh = F.transform(F.array(*[F.lit(s) for s in STAGES]), _blank).cast(f"array<{_RECORD}>")
    start = F.struct(F.lit("created").alias("status"), F.lit(None).cast("string").alias("error"), fresh.alias("stages"))

    def step(a: Column, e: Column) -> Column:
        lost = lambda r: r["error"].isNotNull() | F.coalesce(r["detail"] == "Cancelled", F.lit(False))
        status = (
            F.when((e["kind"] == "begin") & e["stage"].isin(STAGES), e["stage"])
            .when(e["kind"] == "fail", "failed")
            .when(e["kind"] == "cancel", "cancelled")
            .when(e["kind"] == "retry", "created")
            .when(e["kind"] == "finish", "complete")
            .otherwise(a["status"])
        )
        error = F.when(e["kind"] == "fail", e["detail"]).when(e["kind"].isin("cancel", "retry", "finish"), F.lit(None)).otherwise(a["error"])
        stages = F.when(e["kind"] == "retry", F.transform(a["stages"], lambda r: F.when(lost(r), _blank(r["name"])).otherwise(r))).otherwise(
            F.transform(a["stages"], lambda r: F.when(r["name"] == e["stage"], _after(r, e)).otherwise(r))
        )
        return F.struct(status.alias("status"), error.cast("string").alias("error"), stages.cast(f"array<{_RECORD}>").alias("stages"))

    return events.groupBy(key).agg(F.aggregate(log, start, step).alias("x")).select(key, "x.*")


def stage_state(record: Column) -> Column:
    """failed, done, active or pending, in this precedence."""
    return (
        F.when(F.coalesce(record["error"], F.lit("")) != "", "failed")
        .when(record["completed_at"].isNotNull(), "done")
        .when(record["started_at"].isNotNull(), "active")
        .otherwise("pending")
    )


def stage_line(record: Column) -> Column:
    """What a viewer reads beside a stage."""
    said, state = F.nullif(record["detail"], F.lit("")), stage_state(record)
    return (
        F.when(state == "failed", "Failed")
        .when(state == "done", F.coalesce(said, F.lit("Done")))
        .when(state == "active", F.coalesce(said, F.lit("Working…")))
        .otherwise("")
    )


def elapsed(stages: Column, now_ms: Column) -> Column:
    """``· M:SS elapsed`` of the first stage that runs; empty without one. Clocks that run behind give 0."""
    running = F.filter(stages, lambda r: r["started_at"].isNotNull() & r["completed_at"].isNull() & (F.coalesce(r["error"], F.lit("")) == ""))
    s = F.greatest(F.floor((now_ms - F.get(running, F.lit(0))["started_at"]) / 1000), F.lit(0))
    return F.when(F.size(running) > 0, F.format_string("· %d:%02d elapsed", F.floor(s / 60), s % 60)).otherwise("")


def resume_plan(artifacts: DataFrame) -> DataFrame:
    """(project_id, stage, action, detail): which stages run, and which are passed over as their results lie ready.

    ``artifacts``: (project_id, duration_ms, has_source, has_transcript, has_candidates, n_accepted,
    n_layouts), the last two null before there are any. Validation always runs; a short source is
    captioned whole; where nothing passed, layouts and rendering have nothing to do.
    """
    short = F.coalesce(F.col("duration_ms") < SHORT_MS, F.lit(False))
    none = F.coalesce(F.col("n_accepted") == 0, F.lit(False)) & ~short
    planned = F.coalesce(F.col("n_layouts") == F.col("n_accepted"), F.lit(False))
    skip = {
        "inspecting": F.when(F.col("has_source"), SKIPPED["inspecting"]),
        "extracting_audio": F.when(F.col("has_transcript"), SKIPPED["extracting_audio"]),
        "transcribing": F.when(F.col("has_transcript"), SKIPPED["transcribing"]),
        "selecting_candidates": F.when(F.col("has_candidates") & ~short, SKIPPED["selecting_candidates"]),
        "analyzing_layout": F.when(none, "No moments passed the quality bar").when(planned, SKIPPED["analyzing_layout"]),
        "rendering": F.when(none, "Nothing to render"),
    }
    null = F.lit(None).cast("string")
    rows = [F.struct(F.lit(i).alias("nth"), F.lit(s).alias("stage"), skip.get(s, null).alias("detail")) for i, s in enumerate(STAGES)]
    out = artifacts.select("project_id", F.inline(F.array(*rows)))
    return out.select("project_id", "nth", "stage", F.when(F.col("detail").isNull(), "run").otherwise("skip").alias("action"), "detail")


def retried(clips: DataFrame) -> DataFrame:
    """``clips`` (..., status, error) with those that failed or were being rendered pending again."""
    again = F.col("status").isin("failed", "rendering")
    return clips.withColumn("error", F.when(~F.coalesce(again, F.lit(False)), F.col("error"))).withColumn(
        "status", F.when(again, "pending").otherwise(F.col("status"))
    )


def outcomes(clips: DataFrame) -> DataFrame:
    """(project_id, total, ready, failed, face_tracked, status, detail, warning, error) of runs by their clips
    (project_id, status, mode). One clip's failure is its own: a run is complete with one ready clip."""
    n = clips.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ready").alias("ready"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("mode") == "face_crop").alias("face_tracked"),
    )
    good = F.col("ready") > 0
    return n.select(
        "*",
        F.when(good, "complete").otherwise("failed").alias("status"),
        F.when(good, F.format_string("%d of %d clip(s) rendered", "ready", "total")).alias("detail"),
        F.when(good & (F.col("failed") > 0), F.format_string("%d clip(s) failed to render. Use Retry to re-run just the failed clip(s).", "failed")).alias("warning"),
        F.when(~good, "All clip renders failed. Review the clip errors and retry.").alias("error"),
    )


def whole_percent(share: Column) -> Column:
    """A share in percent without decimals, exact halves to the even number."""
    return F.bround(share.cast("double") * 100, 0).cast("long").cast("string")


def transcript_detail(words: Column, confidence: Column) -> Column:
    return F.concat(words.cast("string"), F.lit(" words · avg confidence "), whole_percent(confidence), F.lit("%"))


def validation_detail(accepted: Column, rejected: Column) -> Column:
    return F.format_string("%d passed · %d rejected", accepted, rejected)


def proposal_detail(n: Column, selector: Column) -> Column:
    return F.format_string("%d proposal(s) from %s", n, selector)


def layout_detail(total: Column, tracked: Column) -> Column:
    return F.format_string("%d layout(s) planned · %d face-tracked", total, tracked)


def source_detail(width: Column, height: Column, duration_ms: Column, video: Column, audio: Column) -> Column:
    size = F.concat(width.cast("string"), F.lit("×"), height.cast("string"))
    return F.concat_ws(" · ", size, clock(duration_ms), F.concat(video, F.lit("/"), audio))


def confidence_warning(confidence: Column) -> Column:
    return F.when(confidence < 0.68, F.concat(F.lit("Transcription confidence was low ("), whole_percent(confidence), F.lit("%). Captions may contain errors.")))


def caption_only(duration_ms: Column) -> Column:
    return duration_ms < SHORT_MS


def full_video_candidates(transcripts: DataFrame) -> DataFrame:
    """The one candidate of each source too short for clips: all of it, quoted whole, without scores.

    ``transcripts``: (doc_id, words, duration_ms); a null duration is no short source.
    """
    said = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return transcripts.where(caption_only(F.col("duration_ms"))).select(
        "doc_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("").alias("headline"),
        said.alias("opening_quote"), said.alias("closing_quote"), F.lit("Full short video captioned without clipping.").alias("selection_reason"),
        F.lit(1).alias("rank"), F.lit(0.0).alias("composite"), F.lit(True).alias("duration_exception"),
    )


def result_titles(views: DataFrame) -> DataFrame:
    """``views`` (project_id, status, caption_only, total, ready, failed, selector) with ``title`` and ``sub``."""
    done = F.col("status") == "complete"
    some = F.when(F.col("ready") == 1, "1 strong clip found").otherwise(F.format_string("%d strong clips found", "ready"))
    title = (
        F.when(F.col("caption_only"), F.when(done, "Captioned video ready").otherwise("Captioning full video"))
        .when(F.col("total") == 0, "No clips produced")
        .when(F.col("failed") > 0, F.format_string("%d of %d clips ready · %d failed", "ready", "total", "failed"))
        .when(done, some)
        .otherwise(F.format_string("%d of %d clips ready", "ready", "total"))
    )
    lost = F.when(F.col("failed") > 0, F.format_string(", %d failed", "failed")).otherwise("")
    count = F.when(F.col("total") > 0, F.concat(F.format_string(" %d ready", "ready"), lost, F.lit("."))).otherwise("")
    by = F.when(F.coalesce("selector", F.lit("")) != "", F.concat(F.lit(" Selected by "), F.col("selector"), F.lit("."))).otherwise("")
    sub = F.when(F.col("caption_only"), "The full video is preserved without selecting or cutting clips.").otherwise(
        F.concat(F.lit("Ranked by self-contained opening, tension, payoff, and clarity."), count, by)
    )
    return views.withColumn("title", title).withColumn("sub", sub)


def leases(requests: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, seq, kind, generation, granted) for requests (key, seq, kind, generation) in their order.

    ``start`` is granted where no run is active, and gets the next generation; ``cancel``, as often as
    asked, where one is, whose generation it shows; ``finish`` only with the active run's generation,
    so that a run that was replaced can't end its successor. Else ``generation`` is as asked.
    """
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", F.col("generation").cast("long").alias("generation"))))
    start = F.expr(
        "named_struct('last', 0L, 'active', cast(null as bigint), 'out',"
        " cast(array() as array<struct<seq:bigint,kind:string,generation:bigint,granted:boolean>>))"
    )

    def step(a: Column, r: Column) -> Column:
        idle = a["active"].isNull()
        begins = (r["kind"] == "start") & idle
        stops = (r["kind"] == "cancel") & ~idle
        ends = (r["kind"] == "finish") & F.coalesce(a["active"] == r["generation"], F.lit(False))
        made = F.when(begins, a["last"] + 1).when(stops, a["active"]).otherwise(r["generation"])
        row = F.struct(
            r["seq"].cast("long").alias("seq"), r["kind"].alias("kind"), made.alias("generation"),
            F.coalesce(begins | stops | ends, F.lit(False)).alias("granted"),
        )
        return F.struct(
            F.when(begins, a["last"] + 1).otherwise(a["last"]).alias("last"),
            F.when(begins, a["last"] + 1).when(ends, F.lit(None)).otherwise(a["active"]).cast("long").alias("active"),
            F.concat(a["out"], F.array(row)).alias("out"),
        )

    return requests.groupBy(key).agg(F.aggregate(log, start, step)["out"].alias("out")).select(key, F.inline("out"))


def cancellations(requests: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, seq, generation, waited_ms, acknowledged) of the cancellations that met a run.

    ``requests`` as for :func:`leases`, with at_ms. Acknowledged is what ended within five seconds;
    ``waited_ms`` is null where the run never ended.
    """
    times = requests.select(key, F.col("seq").cast("long").alias("seq"), F.col("at_ms").cast("long").alias("at_ms"))
    seen = leases(requests, key).where("granted").join(times, [key, "seq"])
    by_run = Window.partitionBy(key, "generation")
    ended = F.min(F.when(F.col("kind") == "finish", F.col("at_ms"))).over(by_run)
    waited = (ended - F.col("at_ms")).alias("waited_ms")
    return seen.select(key, "seq", "kind", "generation", waited).where("kind = 'cancel'").select(
        key, "seq", "generation", "waited_ms", F.coalesce(F.col("waited_ms") <= CANCEL_MS, F.lit(False)).alias("acknowledged")
    )


def exclusive(claims: DataFrame, key: str) -> DataFrame:
    """``claims`` (key, seq, kind, ...) with ``granted``: of begins between two ends only the first one is."""
    order = Window.partitionBy(key).orderBy("seq")
    ends = F.sum((F.col("kind") == "end").cast("int")).over(order)
    first = F.row_number().over(Window.partitionBy(key, "_turn", "kind").orderBy("seq")) == 1
    return claims.withColumn("_turn", ends).withColumn("granted", (F.col("kind") == "begin") & first).drop("_turn")


def deliveries(subscribers: DataFrame, events: DataFrame, capacity: int = CHANNEL_CAPACITY) -> DataFrame:
    """(subscriber_id, nth, at_ms, message): what each subscriber (subscriber_id, project_id, joined_ms,
    read_ms, snapshot) gets of the project's events (project_id, seq, at_ms, message).

    First the snapshot (nth 0), then what was sent after joining and up to reading; who lags gets the last
    ``capacity`` messages, as many as the channel holds.
    """
    sent = subscribers.join(events, "project_id").where("at_ms > joined_ms and at_ms <= read_ms")
    late = Window.partitionBy("subscriber_id").orderBy(F.desc("seq"))
    kept = sent.withColumn("_back", F.row_number().over(late)).where(F.col("_back") <= capacity)
    nth = F.row_number().over(Window.partitionBy("subscriber_id").orderBy("seq"))
    first = subscribers.select("subscriber_id", F.lit(0).alias("nth"), F.col("joined_ms").alias("at_ms"), F.col("snapshot").alias("message"))
    return first.union(kept.select("subscriber_id", nth.alias("nth"), "at_ms", "message"))
