"""Registered queries over runs, requests, reviews and probes, on fixtures made of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.operators import evals, requests, reviews, runs, series
from talkweave.functions import text as X
from talkweave.plans import prompts
from talkweave.registration import fold_sql, query
from talkweave.sources import health
from talkweave.sources.transcripts import documents_as_transcripts, table

_KINDS = ["begin", "complete", "begin", "skip", "fail", "begin", "complete", "cancel", "retry", "begin", "complete", "finish"]


def _picked(options: list, at):
    return F.element_at(F.array(*[F.lit(o) for o in options]), at.cast("int") + 1)


def _list(options: list) -> str:
    return "[" + ", ".join("NULL" if o is None else "'" + o.replace("'", "''") + "'" for o in options) + "]"


def _log(spark, sf_dir):
    """Events as a log of stages: kinds and stages go round by event_id."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "user_id", i.alias("seq"), _picked(_KINDS, F.floor(i / 3) % len(_KINDS)).alias("kind"), _picked(X.STAGES, i % 7).alias("stage"),
        (i * 1000).alias("at_ms"), F.concat(F.lit("d"), i.cast("string")).alias("detail"),
    )


_LOG = f"""e AS (SELECT user_id, event_id AS seq, event_id * 1000 AS t, {_list(_KINDS)}[event_id // 3 % {len(_KINDS)} + 1] AS kind,
  {_list(X.STAGES)}[event_id % 7 + 1] AS stage, 'd' || event_id AS detail FROM events),
st AS (SELECT unnest({_list(X.STAGES)}) AS name, unnest(range(0, 7)) AS nth),
x AS MATERIALIZED (SELECT e.*, name, row_number() OVER (PARTITION BY user_id, name ORDER BY seq) AS rn FROM e, st WHERE kind = 'retry' OR (stage = name AND kind <> 'finish')),
rec AS (
  WITH RECURSIVE r AS (
    SELECT user_id, name, nth, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS c, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS er
    FROM (SELECT DISTINCT user_id FROM events), st
    UNION ALL
    SELECT user_id, name, nth, rn,
      CASE WHEN gone THEN NULL WHEN kind = 'begin' OR fresh THEN t WHEN kind = 'cancel' THEN coalesce(s, t) ELSE s END,
      CASE WHEN gone OR kind = 'begin' THEN NULL WHEN kind IN ('complete', 'cancel') OR fresh THEN t ELSE c END,
      CASE WHEN gone THEN NULL WHEN kind = 'begin' THEN 0 WHEN kind = 'complete' OR fresh THEN 1 WHEN kind = 'cancel' THEN coalesce(p, 0) ELSE p END,
      CASE WHEN gone THEN NULL WHEN kind = 'complete' OR fresh THEN detail WHEN kind = 'cancel' THEN 'Cancelled' ELSE d END,
      CASE WHEN gone OR kind IN ('begin', 'cancel') THEN NULL WHEN kind = 'fail' THEN detail ELSE er END
    FROM (SELECT r.user_id, r.name, r.nth, x.rn, s, c, p, d, er, kind, t, detail, kind = 'skip' AND c IS NULL AS fresh,
        kind = 'retry' AND (er IS NOT NULL OR coalesce(d = 'Cancelled', false)) AS gone
      FROM r JOIN x ON x.user_id = r.user_id AND x.name = r.name AND x.rn = r.rn + 1))
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY rn DESC) = 1),
job AS (SELECT user_id, coalesce(arg_max(CASE kind WHEN 'begin' THEN stage WHEN 'fail' THEN 'failed' WHEN 'cancel' THEN 'cancelled' WHEN 'retry' THEN 'created' ELSE 'complete' END, seq)
    FILTER (kind IN ('begin', 'fail', 'cancel', 'retry', 'finish')), 'created') AS status FROM e GROUP BY 1)"""


@query(
    f"""WITH {_LOG}, w AS (SELECT *, CASE WHEN er IS NOT NULL THEN 'failed' WHEN c IS NOT NULL THEN 'done' WHEN s IS NOT NULL THEN 'active' ELSE 'pending' END AS state FROM rec)
SELECT user_id, status, CAST(nth AS INT) AS nth, name, s AS started_at, c AS completed_at, p AS progress, d AS detail, er AS error, state,
CASE state WHEN 'failed' THEN 'Failed' WHEN 'done' THEN coalesce(d, 'Done') WHEN 'active' THEN coalesce(d, 'Working…') ELSE '' END AS line FROM w JOIN job USING (user_id)"""
)
def stage_records(spark, sf_dir):
    """Stage lifecycle and retries, with what a viewer reads of each stage."""
    out = runs.stage_records(_log(spark, sf_dir), "user_id").select("user_id", "status", F.posexplode("stages").alias("nth", "r"))
    return out.select("user_id", "status", "nth", "r.*", runs.stage_state(F.col("r")).alias("state"), runs.stage_line(F.col("r")).alias("line"))


@query(
    f"""WITH {_LOG}, a AS (SELECT user_id, arg_min(s, nth) AS s FROM rec WHERE s IS NOT NULL AND c IS NULL AND er IS NULL GROUP BY 1)
SELECT user_id, CASE WHEN s IS NULL THEN '' ELSE printf('· %d:%02d elapsed', greatest(9000000 - s, 0) // 60000, greatest(9000000 - s, 0) // 1000 % 60) END AS elapsed
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN a USING (user_id)"""
)
def stage_elapsed(spark, sf_dir):
    r = runs.stage_records(_log(spark, sf_dir), "user_id")
    return r.select("user_id", runs.elapsed(F.col("stages"), F.lit(9_000_000)).alias("elapsed"))


@query(
    f"""WITH a AS (SELECT doc_id, n_chars * 40 < 20000 AS short, doc_id % 2 = 0 AS src, doc_id % 3 = 0 AS tr, doc_id % 5 = 0 AS cand,
  CASE WHEN doc_id % 7 < 5 THEN doc_id % 4 END AS acc, CASE WHEN doc_id % 11 < 7 THEN doc_id % 3 END AS lay FROM documents),
s AS (SELECT unnest({_list(X.STAGES)}) AS stage, CAST(unnest(range(0, 7)) AS INT) AS nth),
j AS (SELECT doc_id AS project_id, nth, stage, CASE stage WHEN 'inspecting' THEN CASE WHEN src THEN 'Already inspected' END
  WHEN 'selecting_candidates' THEN CASE WHEN cand AND NOT coalesce(short, false) THEN 'Proposals already on disk' END WHEN 'validating_candidates' THEN NULL
  WHEN 'analyzing_layout' THEN CASE WHEN acc = 0 AND NOT coalesce(short, false) THEN 'No moments passed the quality bar' WHEN acc = lay THEN 'Layouts already planned' END
  WHEN 'rendering' THEN CASE WHEN acc = 0 AND NOT coalesce(short, false) THEN 'Nothing to render' END ELSE CASE WHEN tr THEN 'Transcript already on disk' END END AS detail FROM a, s)
SELECT project_id, nth, stage, CASE WHEN detail IS NULL THEN 'run' ELSE 'skip' END AS action, detail FROM j"""
)
def resume_plans(spark, sf_dir):
    i = F.col("doc_id")
    have = table(spark, sf_dir, "documents").select(
        i.alias("project_id"), (F.col("n_chars") * 40).alias("duration_ms"), (i % 2 == 0).alias("has_source"), (i % 3 == 0).alias("has_transcript"),
        (i % 5 == 0).alias("has_candidates"), F.when(i % 7 < 5, i % 4).alias("n_accepted"), F.when(i % 11 < 7, i % 3).alias("n_layouts"),
    )
    return runs.resume_plan(have)


def _clips(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "ready").otherwise("rendering")
    mode = F.when(F.col("l_linestatus") == "F", "face_crop").otherwise("blur_pad")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), "l_linenumber", status.alias("status"), mode.alias("mode"), F.col("l_returnflag").alias("error"))


_OUT = """o AS (SELECT l_orderkey AS project_id, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS ready, count(*) FILTER (l_returnflag = 'R') AS failed,
  count(*) FILTER (l_linestatus = 'F') AS face_tracked FROM lineitem GROUP BY 1)"""


@query(
    f"""WITH {_OUT} SELECT *, CASE WHEN ready > 0 THEN 'complete' ELSE 'failed' END AS status, CASE WHEN ready > 0 THEN ready || ' of ' || total || ' clip(s) rendered' END AS detail,
CASE WHEN ready > 0 AND failed > 0 THEN failed || ' clip(s) failed to render. Use Retry to re-run just the failed clip(s).' END AS warning,
CASE WHEN ready = 0 THEN 'All clip renders failed. Review the clip errors and retry.' END AS error, total || ' layout(s) planned · ' || face_tracked || ' face-tracked' AS layouts FROM o"""
)
def run_outcomes(spark, sf_dir):
    out = runs.outcomes(_clips(spark, sf_dir))
    return out.withColumn("layouts", runs.layout_detail(F.col("total"), F.col("face_tracked")))


@query(
    """SELECT l_orderkey AS project_id, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'ready' ELSE 'pending' END AS status, CASE WHEN l_returnflag = 'A' THEN 'A' END AS error FROM lineitem"""
)
def clips_retried(spark, sf_dir):
    return runs.retried(_clips(spark, sf_dir)).select("project_id", "l_linenumber", "status", "error")


@query(
    f"""WITH {_OUT}, v AS (SELECT *, project_id % 9 = 0 AS whole, CASE WHEN project_id % 4 > 0 THEN 'complete' ELSE 'rendering' END AS status,
  CASE project_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN '' END AS sel FROM o)
SELECT project_id, CASE WHEN whole THEN CASE WHEN status = 'complete' THEN 'Captioned video ready' ELSE 'Captioning full video' END WHEN failed > 0 THEN ready || ' of ' || total || ' clips ready · ' || failed || ' failed'
  WHEN status = 'complete' THEN ready || ' strong clip' || CASE WHEN ready = 1 THEN '' ELSE 's' END || ' found' ELSE ready || ' of ' || total || ' clips ready' END AS title,
CASE WHEN whole THEN 'The full video is preserved without selecting or cutting clips.' ELSE 'Ranked by self-contained opening, tension, payoff, and clarity. ' || ready || ' ready' ||
  CASE WHEN failed > 0 THEN ', ' || failed || ' failed' ELSE '' END || '.' || CASE WHEN sel = 'local' THEN ' Selected by local.' ELSE '' END END AS sub FROM v"""
)
def result_titles(spark, sf_dir):
    i = F.col("project_id")
    o = runs.outcomes(_clips(spark, sf_dir)).drop("status")
    v = o.withColumn("caption_only", i % 9 == 0).withColumn("status", F.when(i % 4 > 0, "complete").otherwise("rendering"))
    return runs.result_titles(v.withColumn("selector", F.when(i % 3 == 0, "local").when(i % 3 == 1, ""))).select("project_id", "title", "sub")


_ASK = {"signup": "start", "view": "start", "click": "cancel", "purchase": "finish", "error": "finish"}


def _requests(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for kv in _ASK.items() for x in kv])[F.col("event_type")]
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("user_id", i.alias("seq"), kind.alias("kind"), (i % 4 + 1).alias("generation"), (i * 10).alias("at_ms"))


_LEASES = f"""q AS MATERIALIZED (SELECT user_id, event_id AS seq, CASE {" ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in _ASK.items())} END AS kind, event_id % 4 + 1 AS g, event_id * 10 AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
lv AS MATERIALIZED (
  WITH RECURSIVE r AS (
    SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS t, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS act, CAST(NULL AS BIGINT) AS generation, false AS granted
    FROM (SELECT DISTINCT user_id FROM q)
    UNION ALL
    SELECT user_id, rn, seq, kind, t, CASE WHEN b THEN last + 1 ELSE last END, CASE WHEN b THEN last + 1 WHEN f THEN NULL ELSE act END,
      CASE WHEN b THEN last + 1 WHEN kind = 'cancel' AND act IS NOT NULL THEN act ELSE g END, b OR f OR (kind = 'cancel' AND act IS NOT NULL)
    FROM (SELECT r.user_id, q.rn, q.seq, q.kind, q.t, q.g, last, act, q.kind = 'start' AND act IS NULL AS b, q.kind = 'finish' AND coalesce(act = g, false) AS f
      FROM r JOIN q ON q.user_id = r.user_id AND q.rn = r.rn + 1))
  SELECT * FROM r WHERE rn > 0)"""


@query(f"WITH {_LEASES} SELECT user_id, seq, kind, generation, granted FROM lv")
def run_leases(spark, sf_dir):
    return runs.leases(_requests(spark, sf_dir), "user_id")


@query(
    f"""WITH {_LEASES}, f AS (SELECT user_id, generation, min(t) AS ended FROM lv WHERE granted AND kind = 'finish' GROUP BY 1, 2)
SELECT lv.user_id, seq, lv.generation, ended - t AS waited_ms, coalesce(ended - t <= 5000, false) AS acknowledged FROM lv LEFT JOIN f ON f.user_id = lv.user_id AND f.generation = lv.generation
WHERE kind = 'cancel' AND granted"""
)
def cancellations(spark, sf_dir):
    return runs.cancellations(_requests(spark, sf_dir), "user_id")


@query(
    """WITH c AS (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'begin' ELSE 'end' END AS kind FROM events)
SELECT user_id, seq, kind, kind = 'begin' AND coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY seq), 'end') = 'end' AS granted FROM c"""
)
def restyle_claims(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "begin").otherwise("end")
    claims = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"))
    return runs.exclusive(claims, "user_id")


@query(
    """WITH s AS (SELECT doc_id AS id, doc_id % 150 AS p, doc_id * 3 AS a, doc_id * 3 + 6000 AS b FROM documents),
m AS (SELECT id, event_id, event_type, row_number() OVER (PARTITION BY id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY id) AS n FROM s JOIN events ON user_id = p AND event_id > a AND event_id <= b)
SELECT id AS subscriber_id, 0 AS nth, a AS at_ms, 'snapshot' AS message FROM s
UNION ALL SELECT id, CAST(i - greatest(n - 16, 0) AS INT), event_id, event_type FROM m WHERE i > n - 16"""
)
def channel_deliveries(spark, sf_dir):
    """Live channels of 16 messages: snapshot first, laggards lose the oldest."""
    i = F.col("doc_id")
    subs = table(spark, sf_dir, "documents").select(
        i.alias("subscriber_id"), (i % 150).alias("project_id"), (i * 3).alias("joined_ms"), (i * 3 + 6000).alias("read_ms"), F.lit("snapshot").alias("snapshot")
    )
    sent = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("at_ms"), F.col("event_type").alias("message"))
    return runs.deliveries(subs, sent, 16)


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> '') AS l FROM documents),
d AS (SELECT doc_id, 360 * len(l) + 440 AS dur, array_to_string(l, ' ') AS t FROM l WHERE len(l) > 0)
SELECT doc_id, CAST(0 AS BIGINT) AS start_ms, CAST(dur AS BIGINT) AS end_ms, '' AS headline, t AS opening_quote, t AS closing_quote, 'Full short video captioned without clipping.' AS selection_reason,
1 AS rank, CAST(0 AS DOUBLE) AS composite, true AS duration_exception FROM d WHERE dur < 20000"""
)
def full_video_candidates(spark, sf_dir):
    t = documents_as_transcripts(table(spark, sf_dir, "documents"))
    return runs.full_video_candidates(t.withColumn("duration_ms", F.get("words", F.size("words") - 1)["end_ms"] + 500))


@query(
    r"""WITH d AS (SELECT doc_id, n_chars AS n, (doc_id * 37 % 1001) / 1000.0::DOUBLE AS p FROM documents), q AS (SELECT *, CAST(round_even(p * 100, 0) AS BIGINT) AS pc FROM d)
SELECT doc_id, n || ' words · avg confidence ' || pc || '%' AS transcript, CASE WHEN p < 0.68 THEN 'Transcription confidence was low (' || pc || '%). Captions may contain errors.' END AS warning,
n || ' passed · ' || doc_id || ' rejected' AS validation, n || ' proposal(s) from local' AS proposals,
'1920×1080 · ' || printf('%02d:%02d', n * 977 // 60000 % 60, n * 977 // 1000 % 60) || ' · h264/aac' AS source, n < 20000 AS caption_only FROM q WHERE n * 977 < 3600000"""
)
def detail_lines(spark, sf_dir):
    n, p = F.col("n_chars"), (F.col("doc_id") * 37 % 1001) / F.lit(1000.0)
    h = F.lit("h264")
    return table(spark, sf_dir, "documents").where(n * 977 < 3_600_000).select(
        "doc_id", runs.transcript_detail(n, p).alias("transcript"), runs.confidence_warning(p).alias("warning"), runs.validation_detail(n, F.col("doc_id")).alias("validation"),
        runs.proposal_detail(n, F.lit("local")).alias("proposals"), runs.source_detail(F.lit(1920), F.lit(1080), n * 977, h, F.lit("aac")).alias("source"), runs.caption_only(n).alias("caption_only"),
    )


_STYLES, _COLOURS, _MODES = [" Impact", "CLEAN", "minimal", None], ["#12ab34", "12AB34", "zz", None], ["manual", "random", " Optimized", "odd", "manual"]
_FILES, _FRAMES = ["A.MP4", "b.m4v", "c.mov", "d.mp4"], ["background ", "fill", "odd"]


def _uploads(spark, sf_dir):
    i = F.col("doc_id")

    def field(name: str, value=None, file_name=None, chunks=None):
        null = F.lit(None)
        return F.struct(
            F.lit(name).alias("name"), (null if value is None else value).cast("string").alias("value"), (null if file_name is None else file_name).cast("string").alias("file_name"),
            (null if chunks is None else chunks).cast("array<bigint>").alias("chunks"),
        )

    fields = F.array(
        field("caption_style", _picked(_STYLES, i % 4)), field("accent_color", _picked(_COLOURS, F.floor(i / 2) % 4)), field("accent_mode", _picked(_MODES, F.floor(i / 3) % 5)),
        field("framing_mode", _picked(_FRAMES, i % 3)), field("file", None, _picked(_FILES, F.floor(i / 5) % 4), F.array(F.col("n_chars"), F.lit(0))),
    )
    free = F.when(i % 7 == 0, 0.5).when(i % 11 > 0, 50.0)
    return table(spark, sf_dir, "documents").select(i.alias("request_id"), free.alias("free_gb"), F.when(i % 2 == 0, "#4FB5FF").alias("best_accent"), fields.alias("fields"))


_PALETTE = _list(series.ACCENTS)


@query(
    f"""WITH d AS (SELECT doc_id AS i, n_chars AS n, {_list(_STYLES)}[doc_id % 4 + 1] AS st, {_list(_COLOURS)}[doc_id // 2 % 4 + 1] AS co, lower(trim({_list(_MODES)}[doc_id // 3 % 5 + 1])) AS mo,
  {_list(_FRAMES)}[doc_id % 3 + 1] AS fr, {_list(_FILES)}[doc_id // 5 % 4 + 1] AS fi FROM documents),
e AS (SELECT *, CASE WHEN mo = 'odd' THEN 'accent_mode must be manual, random, or optimized' WHEN fi = 'c.mov' THEN 'Attach an .mp4 file. Other containers are post-MVP.'
  WHEN i % 7 = 0 AND n > 0 THEN 'Not enough free disk space for this video. Free up space and try again.' WHEN n = 0 THEN 'No file received. Drop one MP4 into the studio.' END AS error FROM d),
o AS (SELECT i, error, fi, CASE i % 4 WHEN 0 THEN 'impact' WHEN 1 THEN 'clean' END AS style, CASE mo WHEN 'random' THEN {_PALETTE}[CAST('0x' || sha256(CAST(i AS VARCHAR))[1:2] AS INT) % 6 + 1]
  WHEN 'optimized' THEN CASE WHEN i % 2 = 0 THEN '#4FB5FF' ELSE '#FFDD00' END ELSE CASE i // 2 % 4 WHEN 0 THEN '#12ab34' WHEN 1 THEN '#12AB34' END END AS colour,
  CASE WHEN i % 3 = 0 THEN 'background' ELSE 'fill' END AS framing, n FROM e)
SELECT i AS request_id, error, CASE WHEN error IS NULL THEN fi END AS original_name, CASE WHEN error IS NULL THEN style END AS caption_style, CASE WHEN error IS NULL THEN colour END AS accent_color,
CASE WHEN error IS NULL THEN framing END AS framing_mode, CASE WHEN error IS NULL THEN n END AS size FROM o"""
)
def upload_requests(spark, sf_dir):
    return requests.uploads(_uploads(spark, sf_dir))


_ASKED_STYLE, _ASKED_COLOUR, _ASKED_FONT = [None, "impact", " Clean", "minimal"], [None, "#00ff00", "ABCDEF", "red", None], [None, "arial", "Georgia ", "Comic", None, None]
_OLD_STYLE = ["minimal", None, "impact"]


@query(
    f"""WITH d AS (SELECT doc_id AS i FROM documents), e AS (SELECT i, CASE WHEN i % 4 = 3 THEN 'style must be "impact" or "clean"' WHEN i // 2 % 5 = 3 THEN 'accent_color must be #RRGGBB'
  WHEN i // 3 % 6 = 3 THEN 'font must be one of the curated caption fonts' END AS error,
  CASE i % 4 WHEN 1 THEN 'impact' WHEN 2 THEN 'clean' ELSE CASE WHEN i // 7 % 3 = 0 THEN 'clean' ELSE 'impact' END END AS s FROM d),
o AS (SELECT i, error, s, CASE i // 2 % 5 WHEN 1 THEN '#00ff00' WHEN 2 THEN '#ABCDEF' ELSE CASE WHEN i % 13 = 0 THEN '#010203' WHEN s = 'clean' THEN '#FFB224' ELSE '#FFDD00' END END AS c,
  CASE i // 3 % 6 WHEN 1 THEN 'Arial' WHEN 2 THEN 'Georgia' ELSE CASE WHEN i % 17 = 0 THEN 'Verdana' ELSE 'Inter' END END AS f, CASE WHEN i % 2 = 0 THEN 'new' WHEN i % 3 = 0 THEN 'old' END AS t FROM e)
SELECT i AS clip_id, error, CASE WHEN error IS NULL THEN s END AS style, CASE WHEN error IS NULL THEN c END AS accent_color, CASE WHEN error IS NULL THEN f END AS caption_font,
CASE WHEN error IS NULL THEN t END AS caption_text FROM o"""
)
def restyle_requests(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        i.alias("clip_id"), _picked(_ASKED_STYLE, i % 4).alias("style"), _picked(_ASKED_COLOUR, F.floor(i / 2) % 5).alias("accent_color"), _picked(_ASKED_FONT, F.floor(i / 3) % 6).alias("font"),
        F.when(i % 2 == 0, " new ").alias("text"), _picked(_OLD_STYLE, F.floor(i / 7) % 3).alias("old_style"), F.when(i % 13 == 0, "#010203").alias("old_accent"),
        F.when(i % 17 == 0, "Verdana").alias("old_font"), F.when(i % 3 == 0, "old").alias("old_text"),
    )
    return requests.restyled(rows, "Inter")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'face_crop' ELSE 'blur_pad' END AS mode, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 0.5::DOUBLE END AS centre,
sha256(CAST(doc_id AS VARCHAR))[1:10] AS short, '.clip.part-' || sha256(CAST(doc_id AS VARCHAR))[1:10] || '.mp4' AS temp, printf('%02d-', doc_id) || coalesce(nullif(regexp_replace(source, '[^a-z0-9]+', '-', 'g'), ''), 'clip') || '.mp4' AS file FROM documents"""
)
def layout_requests(spark, sf_dir):
    i = F.col("doc_id")
    mode, seen = F.when(i % 2 == 0, "fill").otherwise("background"), F.when(i % 3 == 0, "face_crop").otherwise("blur_pad")
    d = table(spark, sf_dir, "documents").withColumn("x", requests.framed(mode, seen))
    return d.select("doc_id", "x.mode", "x.centre", requests.short_id(i).alias("short"), requests.temp_name(F.lit("clip.mp4"), i).alias("temp"), X.clip_filename(i, F.col("source")).alias("file"))


@query(
    """WITH e AS (SELECT event_id AS i, CASE event_type WHEN 'view' THEN 'openai' WHEN 'click' THEN 'anthropic' WHEN 'error' THEN 'offline' ELSE 'other' END AS p,
  CASE WHEN event_id % 3 = 0 THEN 'mine' END AS m, event_id % 2 = 0 AS k FROM events),
f AS (SELECT *, coalesce(m, CASE WHEN p = 'anthropic' THEN 'claude-sonnet-4-5' ELSE 'gpt-4o-mini' END) AS model, CASE p WHEN 'openai' THEN 'OpenAI' WHEN 'anthropic' THEN 'Anthropic' END AS label FROM e)
SELECT i AS event_id, model, p = 'offline' OR k AS connected, p = 'offline' OR (label IS NOT NULL AND k) AS ok, CASE WHEN p = 'offline' THEN 'Local ranking is ready — no API key needed.' WHEN label IS NULL THEN 'Unknown provider `other`.'
WHEN NOT k THEN 'Enter an ' || label || ' API key first.' ELSE label || ' connection verified. Using model ' || model || '.' END AS message FROM f"""
)
def provider_connections(spark, sf_dir):
    t, i = F.col("event_type"), F.col("event_id")
    p = F.when(t == "view", "openai").when(t == "click", "anthropic").when(t == "error", "offline").otherwise("other")
    m, k = F.when(i % 3 == 0, " mine ").when(i % 3 == 1, " "), F.when(i % 2 == 0, "key").when(i % 5 > 0, " ")
    rows = table(spark, sf_dir, "events").select("event_id", requests.effective_model(p, m).alias("model"), requests.connected(p, k).alias("connected"), requests.connection_message(p, m, k).alias("x"))
    return rows.select("event_id", "model", "connected", "x.ok", "x.message")


def _review(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key, n = F.col("l_orderkey").alias("project_id"), F.col("l_linenumber")
    words = F.when(F.col("l_returnflag") == "A", "keep").when(F.col("l_returnflag") == "N", "maybe").when(n % 2 == 0, "skip").otherwise("odd")
    items = li.select(key, (n * 10).alias("item"), n.alias("nth")).distinct()
    made = li.where(F.col("l_quantity") > 20).groupBy(key, n).agg(F.min(words).alias("decision"))
    # one more decision is about an item that is no longer listed
    made = made.select("project_id", (n * 10).alias("item"), "decision").union(made.select("project_id", (n * 10 + 5).alias("item"), F.lit("keep")))
    return items, made


_REVIEW = """it AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS n FROM lineitem),
de AS (SELECT l_orderkey AS p, l_linenumber AS n, min(CASE l_returnflag WHEN 'A' THEN 'keep' WHEN 'N' THEN 'maybe' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'skip' ELSE 'odd' END END) AS d FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2),
ij AS (SELECT p, n, d FROM it LEFT JOIN de USING (p, n))"""


@query(f"WITH {_REVIEW} SELECT p AS project_id, count(*) FILTER (d = 'keep') AS keep, count(*) FILTER (d = 'maybe') AS maybe, count(*) FILTER (d = 'skip') AS skip FROM ij GROUP BY p")
def review_tallies(spark, sf_dir):
    return reviews.tallies(*_review(spark, sf_dir))


@query(f"WITH {_REVIEW} SELECT p AS project_id, coalesce(min(n) FILTER (d IS NULL), min(n)) * 10 AS item FROM ij GROUP BY p")
def review_next(spark, sf_dir):
    return reviews.next_items(*_review(spark, sf_dir))


def _run_folders(spark, sf_dir):
    """Documents as folders of a run: results of all, views of three in four, selections of some, as JSON."""
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", i.alias("folder"))
    result = F.when(k % 10 == 0, "{}").otherwise(
        F.concat(F.lit('{"source_id":"s'), i, F.lit('","category":"c'), (k % 3).cast("string"), F.lit('"'), F.when(k % 2 == 0, ',"status":"complete"').otherwise(""),
                 F.lit(',"duration_seconds":'), F.when(k % 6 == 0, '"7"').otherwise(F.concat((k % 50).cast("string"), F.lit(".5"))), F.lit("}"))
    )
    view = F.concat(F.lit('{"project":{"status":"failed"},"selector":"view","accepted":'), F.when(k % 5 == 0, "-3").otherwise((k % 4).cast("string")),
                    F.lit(',"rejected":2,"selection_report":{"rejected":["an Overlap","fine"]},"clips":[{"status":"ready"},{"status":"failed"},7,{"status":"ready"}]}'))
    selection = F.when(k % 3 == 0, "{}").otherwise(
        F.lit('{"selector":"local","accepted":[1,2,3],"rejected":[{"reason":"too long"},{"reasons":["x","DUPLICATE of y"]},"overlaps",{"detail":4},{"message":"Overlap"}]}')
    )
    return d.select("folder", result.alias("json")), d.where(k % 4 > 0).select("folder", view.alias("json")), d.where(k % 2 == 0).select("folder", selection.alias("json"))


@query(
    """WITH d AS (SELECT doc_id AS i, doc_id % 10 = 0 AS bare, doc_id % 4 > 0 AS v, doc_id % 2 = 0 AND doc_id % 3 > 0 AS s FROM documents)
SELECT CASE WHEN bare THEN CAST(i AS VARCHAR) ELSE 's' || i END AS source_id, CASE WHEN bare THEN 'unspecified' ELSE 'c' || (i % 3) END AS category,
CASE WHEN NOT bare AND i % 2 = 0 THEN 'complete' WHEN v THEN 'failed' ELSE 'unknown' END AS status, CAST(CASE WHEN v THEN 2 ELSE 0 END AS BIGINT) AS ready_clips, CAST(CASE WHEN v THEN 1 ELSE 0 END AS BIGINT) AS failed_clips,
CAST(CASE WHEN s THEN 3 WHEN v THEN CASE WHEN i % 5 = 0 THEN 0 ELSE i % 4 END ELSE 0 END AS BIGINT) AS accepted, CAST(CASE WHEN s THEN 5 WHEN v THEN 2 ELSE 0 END AS BIGINT) AS rejected,
CAST(CASE WHEN s THEN 3 WHEN v THEN 1 ELSE 0 END AS BIGINT) AS duplicate_rejections, CASE WHEN s THEN 'local' WHEN v THEN 'view' ELSE 'unknown' END AS selector,
CASE WHEN NOT bare AND i % 6 > 0 THEN i % 50 + 0.5::DOUBLE END AS duration_seconds, CAST(NULL AS VARCHAR) AS error FROM d"""
)
def run_evidence(spark, sf_dir):
    return reviews.evidence(*_run_folders(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id AS i, doc_id % 10 = 0 AS bare, doc_id % 4 > 0 AS v, doc_id % 2 = 0 AND doc_id % 3 > 0 AS s FROM documents),
r AS (SELECT CASE WHEN bare THEN 'unspecified' ELSE 'c' || (i % 3) END AS category, CASE WHEN s THEN 'local' WHEN v THEN 'view' ELSE 'unknown' END AS selector FROM d)
SELECT 'category' AS counter, category AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'selector', selector, count(*) FROM r GROUP BY 2"""
)
def evidence_counters(spark, sf_dir):
    return evals.counters(reviews.evidence(*_run_folders(spark, sf_dir)), "category", "selector")


@query(
    r"""WITH m AS (SELECT doc_id AS nth, CASE WHEN doc_id % 9 = 0 THEN '-' || source WHEN doc_id % 10 = 0 THEN NULL ELSE 'id.' || (doc_id % 700) END AS id, CASE WHEN doc_id % 4 > 0 THEN lang END AS path FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth) AS k FROM m),
e AS (SELECT nth, CASE WHEN id IS NULL THEN 'invalid source id: null' WHEN id NOT LIKE 'id.%' THEN 'invalid source id: ' || id WHEN k > 1 THEN 'duplicate source id: ' || id WHEN coalesce(path, '') = '' THEN 'missing path for ' || id END AS error FROM n)
SELECT * FROM e WHERE error IS NOT NULL"""
)
def manifest_errors(spark, sf_dir):
    i = F.col("doc_id")
    id_ = F.when(i % 9 == 0, F.concat(F.lit("-"), "source")).when(i % 10 > 0, F.concat(F.lit("id."), (i % 700).cast("string")))
    d = table(spark, sf_dir, "documents").select(i.alias("nth"), id_.alias("id"), F.when(i % 4 > 0, F.col("lang")).alias("path"))
    return reviews.manifest_errors(d)


_GIVEN = ["5", " 4 ", "", None, "2.5", "six", "9"]


def _rubric(spark, sf_dir):
    i = F.col("doc_id")
    scores = [_picked(_GIVEN, F.floor(i / (k + 1)) % (7 if k == 0 else 5)).alias(c) for k, c in enumerate(evals.RUBRIC_SCORES)]
    error = _picked([" False_Accept", "false_reject ", "none", None], i % 4)
    return evals.rubric_rows(table(spark, sf_dir, "documents").select((i + 2).alias("row"), error.alias("decision_error"), *scores))


_RUBRIC = f"""g AS (SELECT doc_id + 2 AS row, doc_id % 4 AS e, {", ".join(f"trim({_list(_GIVEN)}[doc_id // {k + 1} % {7 if k == 0 else 5} + 1]) AS {c}" for k, c in enumerate(evals.RUBRIC_SCORES))} FROM documents),
u AS (SELECT *, {" AND ".join(f"coalesce({c}, '') = ''" for c in evals.RUBRIC_SCORES)} AS blank, coalesce(hook_1to5, '') IN ('six', '9') AS bad FROM g)"""


@query(
    f"""WITH {_RUBRIC} SELECT count(*) AS reviewed, count(*) FILTER (would_post_1to5 IN ('5', '4')) AS would_post_count, round(count(*) FILTER (would_post_1to5 IN ('5', '4')) / CAST(count(*) AS DOUBLE), 3) AS would_post_rate,
{", ".join(f"round(avg(TRY_CAST(nullif({c}, '') AS DOUBLE)), 3) AS {c}" for c in evals.RUBRIC_SCORES)},
count(*) FILTER (e = 0) AS false_accepts, count(*) FILTER (e = 1) AS false_rejects FROM u WHERE NOT blank AND NOT bad"""
)
def rubric_review(spark, sf_dir):
    return evals.review(_rubric(spark, sf_dir))


@query(f"WITH {_RUBRIC} SELECT row FROM u WHERE bad")
def rubric_invalid(spark, sf_dir):
    return evals.invalid_rows(_rubric(spark, sf_dir))


@query(
    """WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role <> 'user' AND trim(text) <> '')
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS tail FROM l WHERE b <= 8 GROUP BY 1"""
)
def error_tails(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), (F.col("role") != "user").alias("is_err"), F.col("text").alias("line"))
    return health.error_tails(lines, "conv_id")


@query(
    """SELECT doc_id AS machine, doc_id % 3 = 0 AS encoder_ok, doc_id % 2 = 0 AS subtitles_ok, doc_id % 5 = 0 AS probe_ok, doc_id % 7 > 0 AS recogniser_ok, doc_id % 4 > 0 AS model_ok,
CASE WHEN doc_id % 4 > 0 THEN n_chars * 1000 // 1000000 END AS model_mb, false AS face_model_ok, CASE WHEN doc_id % 6 > 0 THEN n_chars / 1024.0::DOUBLE / 1024 END AS disk_free_gb FROM documents"""
)
def setup_status(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    disk = F.when(i % 6 > 0, F.concat(F.lit("Filesystem 1024-blocks Used Available Capacity Mounted\n/dev/a   9  8  "), n.cast("string"), F.lit("   7% /\n"))).otherwise("none")
    filters = F.concat(F.lit("Filters:\n T.. assx V->V\n"), F.when(i % 2 == 0, " ... ass V->V x\n").otherwise(" ass x\n"))
    d = table(spark, sf_dir, "documents").select(
        i.alias("machine"), F.when(i % 3 == 0, 0).when(i % 3 == 1, 1).alias("encoder_code"), filters.alias("filters"), F.when(i % 5 == 0, 0).alias("probe_code"), F.when(i % 7 > 0, "r").alias("recogniser"),
        F.when(i % 4 > 0, "m").alias("model"), (n * 1000).alias("model_bytes"), F.lit(None).cast("string").alias("face_model"), disk.alias("disk"),
    )
    return health.setup_status(d)


@query(
    """WITH h AS (SELECT page_id, hex(encode(url)) AS h FROM pages WHERE url IS NOT NULL), x AS (SELECT page_id, h, unnest(range(0, len(h) // 6)) AS i FROM h)
SELECT page_id, CAST('0x' || h[6 * i + 1:6 * i + 2] AS INT) AS r, CAST('0x' || h[6 * i + 3:6 * i + 4] AS INT) AS g, CAST('0x' || h[6 * i + 5:6 * i + 6] AS INT) AS b FROM x"""
)
def raw_pixels(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("data"))
    return health.pixels(raw, "page_id")


_SAME = "CAST(greatest(least(k.b, x.end_ms) - greatest(k.a, x.start_ms), 0) AS DOUBLE) / greatest(x.end_ms - x.start_ms, 1) > 0.55"
_CAND = """cd AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS win, l_linenumber AS nth, min(l_partkey) * 10 % 40000 AS start_ms, min(l_partkey) * 10 % 40000 + CAST(min(l_quantity) AS BIGINT) * 1000 AS end_ms,
  min(l_suppkey) % 5 + l_linenumber % 3 AS worth, l_orderkey % 4 > 0 AS many FROM lineitem GROUP BY l_orderkey, l_linenumber),
c1 AS MATERIALIZED (SELECT doc_id, nth AS ord, start_ms, end_ms, row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, win, nth) AS rn FROM cd WHERE many),
"""


@query(
    f"""WITH {_CAND}{fold_sql("c1", _SAME)} SELECT doc_id, CAST(ord AS INT) AS nth, CAST(place AS INT) AS place FROM g
UNION ALL SELECT doc_id, CAST(nth AS INT), CAST(nth + 1 AS INT) FROM cd WHERE NOT many"""
)
def candidates_united(spark, sf_dir):
    n = F.col("l_linenumber")
    zero, one = F.lit(0).cast("bigint"), F.col("l_suppkey") % 5
    scores = F.struct(
        one.alias("self_contained"), (n % 3).cast("bigint").alias("payoff"), zero.alias("opening_strength"), zero.alias("clarity"), zero.alias("context_dependency"), zero.alias("slop_risk")
    )
    start = (F.col("l_partkey") * 10 % 40000).cast("long")
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_suppkey")])
    rows = own.select(
        F.col("l_orderkey").alias("doc_id"), (n % 3).alias("win"), n.alias("nth"), start.alias("start_ms"), (start + F.col("l_quantity").cast("long") * 1000).alias("end_ms"),
        scores.alias("scores"), F.when(F.col("l_orderkey") % 4 > 0, 3).otherwise(1).alias("windows"),
    )
    return prompts.united(rows).select("doc_id", F.col("nth").cast("int").alias("nth"), "place")
