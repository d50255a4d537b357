"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave import run_queries  # noqa: F401 (registers its queries)
from talkweave.functions import text as X
from talkweave.operators import artifacts, captions, evals, framing, segments, series, signals, validation
from talkweave.operators.intervals import snap_to_words
from talkweave.plans import clips, prompts
from talkweave.registration import QUERIES, SQL, fold_sql, query
from talkweave.sources import reports
from talkweave.sources.transcripts import documents_as_transcripts, exploded_words, table
from talkweave.streaming import lifecycle

FLAGSHIP = "clips_validated"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_transcripts(_docs(spark, sf_dir))


_W = r"""
ws AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(trim(coalesce(text, '')), '\s+'), lambda x: x <> '') AS l FROM documents),
w AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS INT) AS ord, l[i] AS text, CAST(360 * (i - 1) AS BIGINT) AS start_ms, CAST(360 * (i - 1) + 300 AS BIGINT) AS end_ms,
  CAST(60 + (7 * doc_id + 13 * (i - 1)) % 40 AS DOUBLE) / 100 AS p FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ws))
"""
_S = (
    _W
    + r""",
hb AS (SELECT *, lead(start_ms) OVER d AS ns, regexp_matches(text, '[.?!…]["'')\]]*$') AS fin FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY ord)),
sg AS (SELECT *, coalesce(sum(CASE WHEN fin OR ns IS NULL OR ns - end_ms >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM hb),
pr AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY doc_id, seg ORDER BY ord) AS pre FROM sg),
gl AS MATERIALIZED (SELECT doc_id, seg, min(ord) AS base, list(pre ORDER BY ord) AS pre FROM pr GROUP BY 1, 2),
rc AS (
  WITH RECURSIVE r AS (
    SELECT doc_id, seg, base, pre, 1 AS a, least(len(pre), len(list_filter(pre, lambda x: x < 260)) + 1) AS b FROM gl
    UNION ALL
    SELECT doc_id, seg, base, pre, b + 1, least(len(pre), len(list_filter(pre, lambda x: x < pre[b] + 260)) + 1) FROM r WHERE b < len(pre))
  SELECT doc_id, base + a - 1 AS word_start, base + b AS word_end FROM r),
s AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY word_start) - 1 AS INT) AS sent_ord,
    array_to_string(l[word_start + 1:word_end], ' ') AS text, CAST(360 * word_start AS BIGINT) AS start_ms,
    CAST(360 * (word_end - 1) + 300 AS BIGINT) AS end_ms, CAST(word_start AS INT) AS word_start, CAST(word_end AS INT) AS word_end
  FROM rc JOIN ws USING (doc_id))
"""
)


@query(f"WITH {_W} SELECT doc_id, ord, text, start_ms, end_ms, p FROM w")
def words_from_documents(spark, sf_dir):
    return exploded_words(_transcripts(spark, sf_dir)).select("doc_id", "ord", "text", "start_ms", "end_ms", "p")


@query(
    f"""WITH {_S}, h AS (SELECT doc_id, seg, string_agg(text, ' ' ORDER BY ord) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(ord) AS word_start FROM sg GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY word_start) - 1 AS INT) AS sent_ord, text, start_ms, end_ms FROM h"""
)
def sentences_hard_breaks(spark, sf_dir):
    return segments.sentences(_transcripts(spark, sf_dir), None).select("doc_id", "sent_ord", "text", "start_ms", "end_ms")


@query(f"WITH {_S} SELECT * FROM s")
def sentences_full(spark, sf_dir):
    return segments.sentences(_transcripts(spark, sf_dir))


@query(
    f"""WITH {_W} SELECT doc_id, count(ord) AS n_words, CAST(round(coalesce(sum(CAST(round(p * 100) AS BIGINT)), 0) / greatest(count(ord), 1) / 100.0, 6) AS DOUBLE) AS confidence,
coalesce(sum(CAST(round(p * 100) AS BIGINT)) < 68 * count(ord), true) AS low_confidence
FROM ws LEFT JOIN w USING (doc_id) GROUP BY doc_id"""
)
def transcript_confidence(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.round(w["p"] * 100).cast("long"))
    n = F.size("words").cast("long")
    return t.select(
        "doc_id", n.alias("n_words"), F.round(total / F.greatest(n, F.lit(1)) / 100.0, 6).alias("confidence"), (((total < 68 * n)) | (n == 0)).alias("low_confidence")
    )


@query(
    f"""WITH {_S}, d AS (SELECT doc_id, max(end_ms) + 500 AS dur FROM w GROUP BY 1),
win AS (SELECT doc_id, dur, unnest(range(0, 1 + greatest(0, CAST(ceil((dur - 720000) / 600000.0) AS BIGINT)))) AS win FROM d)
SELECT doc_id, win, count(*) AS sentences, min(sent_ord) AS first_sent, max(sent_ord) AS last_sent
FROM win JOIN s USING (doc_id) WHERE NOT (s.end_ms < win * 600000 OR s.start_ms > least(win * 600000 + 720000, dur)) GROUP BY 1, 2"""
)
def hopping_windows(spark, sf_dir):
    return segments.hopping_windows(segments.sentence_rows(_transcripts(spark, sf_dir)))


_END_SCORE = (
    "CAST(0 AS FLOAT) + CASE WHEN terminal THEN CAST(1.0 AS FLOAT) ELSE CAST(0 AS FLOAT) END"
    " + CASE WHEN payoff_here THEN CAST(1.4 AS FLOAT) ELSE CAST(0 AS FLOAT) END"
    " + CASE WHEN next_start IS NULL THEN CAST(0.5 AS FLOAT) WHEN next_start - end_ms >= 700 THEN CAST(0.8 AS FLOAT) ELSE CAST(0 AS FLOAT) END"
    " + (CAST(1.0 AS FLOAT) - least(CAST(abs(CAST(CAST(end_ms - s_start AS FLOAT) / CAST(1000 AS FLOAT) AS FLOAT) - CAST(45 AS FLOAT)) / CAST(45 AS FLOAT) AS FLOAT), CAST(1 AS FLOAT)) * CAST(0.6 AS FLOAT))"
)


_CLOCK = "CASE WHEN {0} >= 3600000 THEN printf('%d:%02d:%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60) ELSE printf('%02d:%02d', {0} // 60000, {0} // 1000 % 60) END"


def _duck(sql: str) -> str:
    return sql.replace("startswith(", "starts_with(")


_B = (
    _S
    + f""",
n AS MATERIALIZED (SELECT *, lead(start_ms) OVER o AS next_start, regexp_matches(rtrim(text), '[.?!…]$') AS terminal,
  {signals.any_of("contains", "lower(text)", signals.PAYOFF_CUES)} AS payoff_here,
  trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS claim FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY sent_ord)),
nb AS MATERIALIZED (SELECT *, coalesce(lag(payoff_here) OVER (PARTITION BY doc_id ORDER BY sent_ord), false) AS payoff_before,
  len(list_filter(string_split(claim, ' '), lambda x: x <> '')) AS cw,
  len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n_words FROM n),
pe AS (SELECT a.doc_id, a.sent_ord AS s, b.sent_ord AS e, a.start_ms AS s_start, b.end_ms, b.next_start, b.terminal, b.payoff_here, b.payoff_here OR b.payoff_before AS payoff_cue
  FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.sent_ord >= a.sent_ord AND b.end_ms - a.start_ms BETWEEN 20000 AND 90000),
ps AS (SELECT *, CAST({_END_SCORE} AS FLOAT) AS end_score FROM pe),
bw AS MATERIALIZED (SELECT doc_id, s, e, s_start AS start_ms, end_ms, end_score, payoff_cue FROM ps QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY end_score DESC, e) = 1)
"""
)


@query(f"WITH {_B} SELECT doc_id, s, e, start_ms, end_ms, CAST(end_score AS DOUBLE) AS end_score, payoff_cue FROM bw")
def best_window_end(spark, sf_dir):
    w = signals.document_windows(_docs(spark, sf_dir))
    return w.select("doc_id", "s", "e", "start_ms", "end_ms", F.col("end_score").cast("double").alias("end_score"), "payoff_cue")


_FILLERS = " + ".join(
    f"len(list_filter(range(1, len(nw) + 1), lambda i: {' AND '.join(f'nw[i + {k}] = {signals.quoted(x)}' for k, x in enumerate(f.split()))}))" for f in signals.FILLERS
)
_F = (
    _B
    + f""",
wt AS (SELECT b.*, string_agg(x.text, ' ' ORDER BY x.sent_ord) AS txt, string_agg(CASE WHEN x.claim <> '' THEN x.claim END, ' ' ORDER BY x.sent_ord) AS norm, sum(x.n_words) AS words
  FROM bw b JOIN nb x ON b.doc_id = x.doc_id AND x.sent_ord BETWEEN b.s AND b.e GROUP BY ALL),
rp AS (SELECT DISTINCT b.doc_id, b.s FROM bw b JOIN nb x ON b.doc_id = x.doc_id AND x.sent_ord BETWEEN b.s AND b.e JOIN nb y ON y.doc_id = x.doc_id AND y.sent_ord > x.sent_ord AND y.sent_ord <= b.e
  WHERE CASE WHEN strlen(x.claim) <= strlen(y.claim) THEN x.cw >= 3 AND contains(y.claim, x.claim) ELSE y.cw >= 3 AND contains(x.claim, y.claim) END),
xc AS (SELECT DISTINCT b.doc_id, b.s FROM bw b JOIN nb x ON b.doc_id = x.doc_id AND x.sent_ord BETWEEN b.s AND b.e JOIN nb y ON y.doc_id = x.doc_id AND y.sent_ord = x.sent_ord + 1 AND y.sent_ord <= b.e
  WHERE contains(x.text, '?') AND y.n_words <= 12 AND y.start_ms - x.end_ms <= 1500),
f0 AS (SELECT wt.*, o.text AS opener, lower(o.text) AS o, o.n_words AS o_words, lower(txt) AS t, string_split(coalesce(norm, ''), ' ') AS nw,
  rp.s IS NOT NULL AS repeated_claim, xc.s IS NOT NULL AS exchange,
  coalesce(list_filter(string_split_regex(lower(o.text), '\\s+'), lambda x: x <> '')[1], '') AS first_word
  FROM wt JOIN nb o ON o.doc_id = wt.doc_id AND o.sent_ord = wt.s LEFT JOIN rp ON rp.doc_id = wt.doc_id AND rp.s = wt.s LEFT JOIN xc ON xc.doc_id = wt.doc_id AND xc.s = wt.s),
f1 AS (SELECT *, {_duck(signals.VAGUE)} AS vague_open,
  {_duck(signals.any_of("startswith", "o", signals.HOOK_STARTS))} OR contains(opener, '?') AS hook,
  {signals.any_of("contains", "t", signals.CONTRAST_CUES)} AS contrast, {signals.any_of("contains", "t", signals.REFERENCE_CUES)} AS reference,
  {signals.any_of("contains", "t", signals.HOUSEKEEPING_CUES)} AS housekeeping, regexp_matches(txt, '[0-9]') AS has_number,
  {_FILLERS} AS fillers, contains(opener, '?') OR first_word IN ('what', 'why', 'how', 'who', 'when') AS question_open,
  len(list_filter(string_split_regex(t, '\\s+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}'']+|[^\\p{{L}}\\p{{N}}'']+$', '', 'g') IN ('everyone', 'everybody', 'nobody', 'never', 'always'))) > 0
    OR regexp_matches(' ' || coalesce(norm, '') || ' ', ' no one | all of us ') AS absolute_claim FROM f0),
f AS MATERIALIZED (SELECT *, CAST(CAST(fillers AS FLOAT) / CAST(greatest(words, 1) AS FLOAT) AS FLOAT) AS filler_rate,
  first_word IN ({", ".join(signals.quoted(x) for x in signals.PRONOUN_OPENERS)}) OR vague_open AS pronoun_open, CAST(0 AS DOUBLE) AS boost FROM f1),
sc AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in signals.SCORES_SQL.items())} FROM f
  WHERE NOT housekeeping AND NOT (fillers >= 5 AND filler_rate >= CAST(0.08 AS FLOAT)) AND (hook OR contrast OR payoff_cue OR repeated_claim OR exchange OR absolute_claim)),
cs AS MATERIALIZED (SELECT *, {signals.PROPOSAL_SQL} AS composite FROM sc)
"""
)
_SIGNALS = ["hook", "contrast", "payoff_cue", "reference", "pronoun_open", "vague_open", "question_open", "has_number", "repeated_claim", "exchange", "absolute_claim", "housekeeping"]


@query(f"WITH {_F} SELECT doc_id, s, e, {', '.join(_SIGNALS)}, CAST(fillers AS INT) AS fillers, CAST(words AS INT) AS words FROM f")
def window_signals(spark, sf_dir):
    w = signals.document_windows(_docs(spark, sf_dir))
    return w.select("doc_id", "s", "e", *_SIGNALS, F.col("fillers").cast("int").alias("fillers"), F.col("words").cast("int").alias("words"))


@query(f"WITH {_F} SELECT doc_id, s, e, {', '.join(signals.SCORES_SQL)}, CAST(composite AS DOUBLE) AS composite FROM cs")
def rubric_scores(spark, sf_dir):
    return clips.candidates(_docs(spark, sf_dir)).select("doc_id", "s", "e", *signals.SCORES_SQL, F.col("composite").cast("double").alias("composite"))


_P = (
    _F
    + """,
dd AS (SELECT doc_id, max(end_ms) + 500 AS dur FROM w GROUP BY 1),
c1 AS MATERIALIZED (SELECT cs.doc_id, s AS ord, start_ms, cs.end_ms, least(greatest((dur + 29999) // 30000, 6), 30) AS cap, greatest(dur // 3, 1) AS third,
  row_number() OVER (PARTITION BY cs.doc_id ORDER BY composite DESC, s) AS rn FROM cs JOIN dd USING (doc_id)),
"""
    + fold_sql(
        "c1",
        "CAST(greatest(least(k.b, x.end_ms) - greatest(k.a, x.start_ms), 0) AS DOUBLE) / greatest(x.end_ms - x.start_ms, 1) > 0.25",
        "len(kept) < x.cap AND len(list_filter(kept, lambda k: least(k.a // x.third, 2) = least(x.start_ms // x.third, 2))) < greatest(x.cap // 2, 2)",
    )
)


@query(f"WITH {_P} SELECT g.doc_id, CAST(place AS INT) AS proposal, s, e, start_ms, end_ms, CAST(composite AS DOUBLE) AS composite FROM g JOIN cs ON g.doc_id = cs.doc_id AND g.ord = cs.s")
def proposals_greedy(spark, sf_dir):
    return clips.proposals(_docs(spark, sf_dir)).select("doc_id", "proposal", "s", "e", "start_ms", "end_ms", F.col("composite").cast("double").alias("composite"))


_REASONS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {r} END" for r, c in signals.REASONS_SQL) + "], lambda x: x IS NOT NULL)"
_V = (
    _P
    + f""",
v AS MATERIALIZED (SELECT g.doc_id, CAST(place AS INT) AS proposal, s, e, start_ms, end_ms, {_REASONS} AS reasons, {signals.VALIDATION_SQL} AS quality FROM g JOIN cs ON g.doc_id = cs.doc_id AND g.ord = cs.s),
v1 AS MATERIALIZED (SELECT doc_id, proposal AS ord, start_ms, end_ms, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, proposal) AS rn FROM v WHERE len(reasons) = 0),
"""
    + fold_sql(
        "v1",
        "CAST(greatest(least(k.b, x.end_ms) - greatest(k.a, x.start_ms), 0) AS DOUBLE) / greatest(x.end_ms - x.start_ms, 1) > 0.3 OR (x.start_ms <= k.a AND x.end_ms >= k.b)",
        name="gv",
    )
)


@query(
    f"""WITH {_V} SELECT v.doc_id, proposal, s, e, start_ms, end_ms, CAST(quality AS DOUBLE) AS quality, CAST(place AS INT) AS rank,
array_to_string(CASE WHEN len(reasons) = 0 AND place IS NULL THEN ['overlaps more than 30% with a higher-ranked clip'] ELSE reasons END, '; ') AS reasons FROM v LEFT JOIN gv ON v.doc_id = gv.doc_id AND v.proposal = gv.ord"""
)
def clips_validated(spark, sf_dir):
    v = clips.validated(_docs(spark, sf_dir))
    return v.select("doc_id", "proposal", "s", "e", "start_ms", "end_ms", F.col("quality").cast("double").alias("quality"), "rank", F.array_join("reasons", "; ").alias("reasons"))


def _intervals(spark, sf_dir):
    """Two odd intervals per document, to be snapped."""
    one = F.struct(F.lit(0).alias("ord"), F.lit(1_000).cast("long").alias("start_ms"), F.lit(31_111).cast("long").alias("end_ms"))
    two = F.struct(F.lit(1).alias("ord"), F.lit(40_250).cast("long").alias("start_ms"), F.lit(95_555).cast("long").alias("end_ms"))
    return _docs(spark, sf_dir).select("doc_id", F.inline(F.array(one, two)))


_IV = "iv AS (SELECT doc_id, ord, start_ms, end_ms FROM documents, (VALUES (CAST(0 AS INT), CAST(1000 AS BIGINT), CAST(31111 AS BIGINT)), (1, 40250, 95555)) v(ord, start_ms, end_ms))"


@query(
    f"""WITH {_W}, {_IV}, j AS (SELECT iv.doc_id, iv.ord, iv.start_ms, iv.end_ms, min(w.start_ms) FILTER (w.end_ms > iv.start_ms) AS a, max(w.end_ms) FILTER (w.start_ms < iv.end_ms) AS b,
  round(coalesce(avg(CAST(round(p * 100) AS BIGINT)) FILTER (w.start_ms >= iv.start_ms AND w.end_ms <= iv.end_ms) / 100, 1.0), 6) AS confidence
  FROM iv LEFT JOIN w ON iv.doc_id = w.doc_id GROUP BY ALL)
SELECT doc_id, ord, start_ms, end_ms, CASE WHEN a < b THEN a END AS snapped_start, CASE WHEN a < b THEN b END AS snapped_end, confidence FROM j"""
)
def snap_words(spark, sf_dir):
    """A fixture of two intervals for each document, snapped to its words."""
    out = snap_to_words(_intervals(spark, sf_dir), _transcripts(spark, sf_dir))
    return out.withColumn("confidence", F.round("confidence", 6))


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("ts").alias("t0"))
    sec = F.expr("cast(timestampdiff(SECOND, t0, ts) div 3600 as int)")
    return e.crossJoin(F.broadcast(first)).select("user_id", sec.alias("sec"), F.when(F.col("event_type") != "error", -F.col("value")).alias("db"))


_EP = """sm AS (SELECT user_id, CAST(date_diff('microsecond', (SELECT min(ts) FROM events), ts) // 3600000000 AS INT) AS sec, CASE WHEN event_type <> 'error' THEN -value END AS db FROM events),
sp AS (SELECT user_id, max(sec) AS last, least(coalesce(min(db), -60), -60) AS fl FROM sm GROUP BY 1),
pp AS (SELECT user_id, sec, avg(coalesce(db, fl)) AS db FROM sm JOIN sp USING (user_id) GROUP BY 1, 2),
ev AS (SELECT user_id, fl, CAST(unnest(range(0, last + 1)) AS INT) AS sec FROM sp),
ep AS (SELECT ev.user_id, ev.sec, coalesce(db, fl) AS db FROM ev LEFT JOIN pp ON pp.user_id = ev.user_id AND pp.sec = ev.sec)"""


@query(f"WITH {_EP} SELECT user_id, sec, round(db, 6) AS db FROM ep")
def energy_profile(spark, sf_dir):
    return series.energy_profile(_samples(spark, sf_dir), "user_id").select("user_id", "sec", F.round("db", 6).alias("db"))


@query(
    f"""WITH {_EP}, iv AS (SELECT DISTINCT user_id, CAST(0 AS INT) AS ord, CAST(0 AS BIGINT) AS start_ms, CAST(90000 AS BIGINT) AS end_ms FROM ep),
st AS (SELECT user_id, avg(db) AS m, stddev_pop(db) AS sd, count(*) AS n FROM ep GROUP BY 1),
lv AS (SELECT iv.user_id, ord, start_ms, end_ms, avg(db) AS lev FROM iv LEFT JOIN ep ON iv.user_id = ep.user_id AND sec >= start_ms // 1000 AND sec < (end_ms + 999) // 1000 GROUP BY ALL)
SELECT user_id, ord, start_ms, end_ms, round(CASE WHEN n >= 2 AND sd >= 1 AND lev IS NOT NULL THEN least(greatest((lev - m) / sd, 0) * 1.5, 4.0) ELSE 0 END, 6) AS boost FROM lv JOIN st USING (user_id)"""
)
def energy_boost(spark, sf_dir):
    p = series.energy_profile(_samples(spark, sf_dir), "user_id")
    iv = p.select("user_id").distinct().select("user_id", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("start_ms"), F.lit(90_000).cast("long").alias("end_ms"))
    return series.energy_boost(iv, p, "user_id").withColumn("boost", F.round("boost", 6))


def _detections(spark, sf_dir):
    from pyspark.sql import Window

    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return e.select("label", frame.alias("frame"), F.lit(0).alias("nth"), F.round(0.5 + F.col("x"), 4).alias("cx"))


@query(
    """WITH d AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, round(0.5 + CAST(embedding[1] AS DOUBLE), 4) AS cx FROM embeddings),
n AS (SELECT *, lag(cx) OVER o AS a, lead(cx) OVER o AS c FROM d WINDOW o AS (PARTITION BY label ORDER BY frame)),
m AS (SELECT label, frame, CASE WHEN a IS NULL OR c IS NULL THEN cx ELSE greatest(least(a, cx), least(greatest(a, cx), c)) END AS m FROM n)
SELECT label, frame, round(avg(m) OVER (PARTITION BY label ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS cx FROM m"""
)
def face_track_smoothed(spark, sf_dir):
    return series.smooth_track(_detections(spark, sf_dir), "label").select("label", "frame", F.round("cx", 6).alias("cx"))


@query()
def face_clusters(spark, sf_dir):
    return series.cluster_centres(_detections(spark, sf_dir), "label").withColumn("mean", F.round("mean", 6))


@query()
def caption_pages_clean(spark, sf_dir):
    return series.clean_pages(_transcripts(spark, sf_dir))


@query()
def caption_pages_impact(spark, sf_dir):
    return series.impact_pages(_transcripts(spark, sf_dir))


@query()
def accent_choice(spark, sf_dir):
    raw = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(F.abs(x) * 1000) % 256).alias("v"))
    return series.choose_accent(raw.select("label", *[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate("rgb")]), "label")


_SLUG = "regexp_replace(left(regexp_replace(regexp_replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-', ''), {n}), '-+$', '')"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, n_chars * 977 AS ms, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN {_SLUG.format(t='t', n=48)} = '' THEN 'clip' ELSE {_SLUG.format(t='t', n=48)} END AS slug,
CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%02d:%02d', ms // 60000, ms // 1000 % 60) END AS clock,
printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) AS subtitle,
array_to_string(l[1:12], ' ') AS head, array_to_string(l[greatest(len(l) - 11, 1):], ' ') AS tail,
CAST(length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS INT) AS alnum,
trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM d"""
)
def text_functions(spark, sf_dir):
    d = _docs(spark, sf_dir)
    t, ms = F.coalesce("text", F.lit("")), F.col("n_chars") * 977
    return d.select(
        "doc_id", X.slug(t, 48).alias("slug"), X.clock(ms).alias("clock"), X.subtitle_time(ms).alias("subtitle"), X.quote_head(t).alias("head"), X.quote_tail(t).alias("tail"),
        X.alnum_length(t).alias("alnum"), X.normalize(t).alias("norm"),
    )


def _sources(spark, sf_dir):
    """Documents with labels as evaluation sources; quality is acceptance, toxicity a duplicate rejection."""
    d = table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"), "doc_id")
    status = F.when(F.col("doc_id") % 7 == 0, "failed").when(F.col("doc_id") % 11 == 0, "cancelled").otherwise("complete")
    return d.select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("category"), status.alias("status"), F.col("quality").cast("long").alias("ready_clips"),
        F.col("quality").cast("long").alias("accepted"), (1 - F.col("quality")).cast("long").alias("rejected"), F.col("toxic").cast("long").alias("duplicate_rejections"),
    )


_SRC = """src AS (SELECT doc_id AS source_id, source AS category, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'cancelled' ELSE 'complete' END AS status,
 quality AS q, toxic AS x FROM labels JOIN documents USING (doc_id))"""
_OPERATIONAL = """count(*) AS source_count, count(*) FILTER (status = 'complete') AS completed_sources, count(*) FILTER (status = 'failed') AS failed_sources,
count(*) FILTER (status = 'cancelled') AS cancelled_sources, round(CAST(count(*) FILTER (status = 'complete') AS DOUBLE) / count(*), 3) AS completion_rate,
CAST(sum(q) AS BIGINT) AS ready_clips, CAST(sum(q) AS BIGINT) AS accepted_candidates, CAST(sum(1 - q) AS BIGINT) AS rejected_candidates, CAST(sum(x) AS BIGINT) AS duplicate_rejections,
round(CAST(sum(x) AS DOUBLE) / count(*), 3) AS duplicate_rate"""


@query(f"WITH {_SRC} SELECT {_OPERATIONAL} FROM src")
def eval_report(spark, sf_dir):
    return evals.operational(_sources(spark, sf_dir))


@query(f"WITH {_SRC} SELECT category, {_OPERATIONAL} FROM src GROUP BY category")
def eval_by_category(spark, sf_dir):
    return evals.operational(_sources(spark, sf_dir), "category")


@query(f"WITH {_SRC} SELECT DISTINCT source_id FROM src WHERE status = 'failed' AND source_id NOT IN (SELECT source_id FROM src WHERE status = 'failed' AND q = 1)")
def eval_new_failures(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return evals.new_failures(s, s.where("accepted = 1"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stage_latest(spark, sf_dir):
    return evals.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts").select("user_id", "event_id", "event_type", "ts")


@query(
    """WITH r AS (SELECT user_id, ts, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS f FROM events),
i AS (SELECT *, row_number() OVER o - sum(f) OVER o AS island FROM r WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, island, count(*) AS n FROM i WHERE f = 1 GROUP BY 1, 2) SELECT user_id, max(n) AS longest FROM c GROUP BY 1"""
)
def poll_streaks(spark, sf_dir):
    return evals.streaks(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "view")


@query(
    """WITH r AS (SELECT event_type, unnest(generate_series(epoch_us(ts) // 36000000000 - 1, epoch_us(ts) // 36000000000)) AS k, epoch_us(ts) AS us FROM events)
SELECT event_type, make_timestamp(k * 36000000000) AS start, count(*) AS n FROM r WHERE us >= k * 36000000000 AND us < k * 36000000000 + 43200000000 GROUP BY 1, 2"""
)
def events_hopping(spark, sf_dir):
    out = lifecycle.hopping_counts(table(spark, sf_dir, "events"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessions(spark, sf_dir):
    out = lifecycle.session_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query()
def caption_documents_clean(spark, sf_dir):
    t = _transcripts(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    last = F.coalesce(F.try_element_at("words", F.lit(-1))["end_ms"] + 500, F.lit(0).cast("long"))
    return captions.documents(captions.clean_events(t, last, F.concat(F.lit("From "), F.col("source"))), captions.clean_header())


@query()
def caption_documents_impact(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    last = F.coalesce(F.try_element_at("words", F.lit(-1))["end_ms"] + 500, F.lit(0).cast("long"))
    return captions.documents(captions.impact_events(t, last), captions.impact_header())


@query(
    """WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM documents),
c AS (SELECT doc_id, list_filter([lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) FOR x IN l[greatest(len(l) - 11, 1):]], lambda x: x <> '') AS h,
  list_filter([lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) FOR x IN l[1:14]], lambda x: x <> '') AS o FROM d)
SELECT doc_id, len(h) > 0 AND CAST(len(list_filter(h, lambda x: list_contains(o, x))) AS FLOAT) / CAST(greatest(len(h), 1) AS FLOAT) < CAST(0.7 AS FLOAT) AS shown FROM c"""
)
def headline_shown(spark, sf_dir):
    return _transcripts(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select(
        "doc_id", captions.shows_headline(X.quote_tail(F.coalesce("text", F.lit(""))), F.col("words")).alias("shown")
    )


@query(
    f"""WITH {_W}, c AS (SELECT doc_id, l, len(l) + 1 AS n, 360 * len(l) - 60 AS span FROM ws WHERE doc_id % 2 = 1 AND len(l) > 0)
SELECT doc_id, ord, 'x' || text AS text, start_ms, end_ms FROM w WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, CAST(i AS INT), CASE WHEN i = n - 1 THEN 'more' ELSE 'x' || l[i + 1] END, CAST(span * i // n AS BIGINT), CAST(span * (i + 1) // n AS BIGINT) FROM (SELECT *, unnest(range(0, n)) AS i FROM c)"""
)
def caption_edits(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    new = F.transform("words", lambda w: F.concat(F.lit("x"), w["text"]))
    text = F.array_join(F.when(F.col("doc_id") % 2 == 0, new).otherwise(F.concat(new, F.array(F.lit("more")))), "  ")
    out = t.withColumn("edit", text).withColumn("words", captions.edited_words(F.col("words"), F.col("edit")))
    return exploded_words(out).select("doc_id", "ord", "text", "start_ms", "end_ms")


_KEYS = r"""d AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame, round(0.5 + CAST(embedding[1] AS DOUBLE), 4) AS cx FROM embeddings),
n AS (SELECT *, lag(cx) OVER o AS a, lead(cx) OVER o AS c FROM d WINDOW o AS (PARTITION BY label ORDER BY frame)),
m AS (SELECT label, frame, CASE WHEN a IS NULL OR c IS NULL THEN cx ELSE greatest(least(a, cx), least(greatest(a, cx), c)) END AS m FROM n),
x AS MATERIALIZED (SELECT label, frame, frame // 2 AS i, CAST(frame * 1000 AS BIGINT) AS t, round(avg(m) OVER (PARTITION BY label ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS cx FROM m),
keys AS (
  WITH RECURSIVE r AS (
    SELECT label, i, t AS kt, cx AS kx, true AS fresh FROM x WHERE frame = 0
    UNION ALL
    SELECT label, i, CASE WHEN fresh THEN t ELSE kt END, CASE WHEN fresh THEN nx ELSE kx END, fresh
    FROM (SELECT *, abs(kx - nx) > 0.012 AS fresh FROM (
      SELECT r.label, x.i, x.t, r.kt, r.kx, least(greatest(x.cx, r.kx - (x.t - r.kt) / 1000.0::DOUBLE * 0.1::DOUBLE), r.kx + (x.t - r.kt) / 1000.0::DOUBLE * 0.1::DOUBLE) AS nx
      FROM r JOIN x ON x.label = r.label AND x.frame % 2 = 0 AND x.i = r.i + 1)))
  SELECT label, kt AS t_ms, kx AS cx, row_number() OVER (PARTITION BY label ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY label) AS many FROM r WHERE fresh),
kf AS MATERIALIZED (SELECT label, t_ms, cx FROM keys WHERE k % CAST(pow(2, ceil(log2(greatest(many / 12.0, 1.0)))) AS INT) = 0)"""


def _keyframes(spark, sf_dir):
    track = series.smooth_track(_detections(spark, sf_dir), "label").withColumn("cx", F.round("cx", 6))
    return framing.crop_keyframes(track, "label")


@query(f"WITH {_KEYS} SELECT label, t_ms, round(cx, 6) AS cx FROM kf")
def crop_keyframes(spark, sf_dir):
    return _keyframes(spark, sf_dir).select("label", F.inline("keyframes")).select("label", "t_ms", F.round("cx", 6).alias("cx"))


@query(
    f"""WITH {_KEYS}, p AS (SELECT label, t_ms, t_ms / 1000.0::DOUBLE AS t, least(greatest(cx * 3413 - 540, 0), 2333) AS x FROM kf),
q AS (SELECT *, lead(t) OVER o AS t1, lead(x) OVER o AS x1 FROM p WINDOW o AS (PARTITION BY label ORDER BY t_ms))
SELECT label, coalesce(string_agg(printf('if(lt(t\\,%.3f)\\,%.1f+(%.1f-%.1f)*(t-%.3f)/%.3f\\,', t1, x, x1, x, t, t1 - t), '' ORDER BY t_ms), '')
 || printf('%.1f', arg_max(x, t_ms)) || repeat(')', CAST(count(t1) AS INT)) AS x FROM q GROUP BY label""".replace("\\\\", "\\")
)
def crop_expressions(spark, sf_dir):
    return _keyframes(spark, sf_dir).select("label", framing.crop_x(F.col("keyframes"), F.lit(3413).cast("long")).alias("x"))


@query()
def filter_graphs(spark, sf_dir):
    sub = F.concat(F.lit("ass='"), framing.filter_quoted(F.concat(F.lit("C:\\out\\it's "), F.col("label"))), F.lit("'"))
    return _keyframes(spark, sf_dir).select(
        "label", framing.filter_graph(F.lit(1920), F.lit(1080), F.when(F.col("label") % 2 == 0, F.col("keyframes")), F.when(F.col("label") % 3 == 0, sub)).alias("graph")
    )


def _artifacts(spark, sf_dir):
    """Documents as clips of projects, and the files a run left of them."""
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("p"), F.col("doc_id") % 50).alias("project_id"), F.concat(F.lit("c"), F.col("doc_id")).alias("clip_id"))
    clip = d.select("project_id", "clip_id", F.concat("clip_id", F.lit(".mp4")).alias("filename"), F.when(F.col("doc_id") % 3 > 0, "ready").otherwise("failed").alias("status"))

    def file(folder: str, suffix: str, step: int):
        size = F.when(F.col("doc_id") % step == 0, 0).otherwise(10)
        return F.when(F.col("doc_id") % (step + 2) > 0, F.struct(F.lit(folder).alias("folder"), F.concat("clip_id", F.lit(suffix)).alias("name"), size.alias("size")))

    kinds = [("clips", ".mp4", 5), ("clips", ".ready", 7), ("base", ".mp4", 4), ("base", ".ready", 3), ("clips", ".ass", 9), ("root", ".part-1", 9), ("root", ".log", 9)]
    files = d.select("project_id", F.explode(F.array(*[file(*k) for k in kinds])).alias("f")).where("f is not null").select("project_id", "f.*")
    return files, clip


_ART = """d AS (SELECT doc_id, 'p' || (doc_id % 50) AS project_id, 'c' || doc_id AS clip_id, doc_id % 3 > 0 AS done FROM documents),
k(folder, suffix, step) AS (VALUES ('clips', '.mp4', 5), ('clips', '.ready', 7), ('base', '.mp4', 4), ('base', '.ready', 3), ('clips', '.ass', 9), ('root', '.part-1', 9), ('root', '.log', 9)),
f AS (SELECT project_id, clip_id, done, folder, suffix, clip_id || suffix AS name, doc_id % step <> 0 AS has FROM d, k WHERE doc_id % (step + 2) > 0),
s AS (SELECT project_id, clip_id, bool_or(has) FILTER (folder = 'clips' AND suffix = '.mp4') AS media, bool_or(has) FILTER (folder = 'clips' AND suffix = '.ready') AS mark,
  bool_or(has) FILTER (folder = 'base' AND suffix = '.mp4') AS base, bool_or(has) FILTER (folder = 'base' AND suffix = '.ready') AS bmark FROM f GROUP BY 1, 2),
j AS (SELECT f.*, mark, bmark, done AND coalesce(media, false) AND coalesce(mark, true) AS good, coalesce(base, false) AND coalesce(bmark, done AND coalesce(media, false) AND coalesce(mark, true)) AS bgood FROM f JOIN s USING (project_id, clip_id))"""


@query(
    f"""WITH {_ART} SELECT project_id, folder, name, CASE WHEN suffix IN ('.ass', '.part-1') THEN 'delete' WHEN folder = 'root' THEN 'keep' WHEN folder = 'clips' AND NOT good THEN 'delete'
WHEN folder = 'base' AND NOT bgood THEN 'delete' WHEN suffix = '.mp4' AND (CASE WHEN folder = 'clips' THEN mark ELSE bmark END) IS NULL THEN 'keep_and_mark' ELSE 'keep' END AS action FROM j"""
)
def artifacts_reconciled(spark, sf_dir):
    return artifacts.reconcile(*_artifacts(spark, sf_dir))


@query(
    """SELECT o_orderkey AS project_id, CASE WHEN o_orderstatus = 'O' AND l.k IS NULL THEN 'failed' WHEN o_orderstatus = 'O' THEN 'rendering' ELSE 'complete' END AS status
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber = 2) l ON l.k = o_orderkey"""
)
def runs_interrupted(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "rendering").otherwise("complete")
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), status.alias("status"))
    running = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_linenumber = 2").select(F.col("l_orderkey").alias("project_id"))
    return artifacts.interrupted(projects, running)


@query(
    f"""WITH {_V}, r AS (SELECT v.doc_id, proposal, place, array_to_string(CASE WHEN len(reasons) = 0 AND place IS NULL THEN ['overlaps more than 30% with a higher-ranked clip'] ELSE reasons END, '; ') AS why FROM v LEFT JOIN gv ON v.doc_id = gv.doc_id AND v.proposal = gv.ord)
SELECT doc_id, count(place) AS accepted, count(*) - count(place) AS rejected,
coalesce(array_to_string(list(proposal || ': ' || why ORDER BY proposal) FILTER (place IS NULL)[1:12], chr(10)), '') AS first_rejections FROM r GROUP BY doc_id"""
)
def project_views(spark, sf_dir):
    v = clips.validated(_docs(spark, sf_dir))
    why = F.when(F.col("rank").isNull(), F.struct("proposal", F.array_join("reasons", "; ").alias("why")))
    rows = v.groupBy("doc_id").agg(F.count("rank").alias("accepted"), F.count_if(F.col("rank").isNull()).alias("rejected"), F.array_sort(F.collect_list(why)).alias("out"))
    said = F.transform(F.slice("out", 1, 12), lambda x: F.concat(x["proposal"].cast("string"), F.lit(": "), x["why"]))
    return rows.select("doc_id", "accepted", "rejected", F.array_join(said, "\n").alias("first_rejections"))


@query(f"WITH {_SRC}, o AS (SELECT {_OPERATIONAL} FROM src) SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' if c in ('source_count', 'completed_sources', 'completion_rate', 'failed_sources', 'ready_clips', 'accepted_candidates', 'rejected_candidates', 'duplicate_rate') else (chr(39) * 2 + ' AS ' + c) for c in reports.CSV_FIELDS)} FROM o")
def report_csv(spark, sf_dir):
    return reports.csv_row(evals.operational(_sources(spark, sf_dir)))


@query()
def report_markdown(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return reports.markdown_lines(evals.operational(s), s.withColumnRenamed("rejected", "rejected_candidates"))


@query(
    f"""WITH {_S}, d AS (SELECT doc_id, max(end_ms) + 500 AS dur FROM w GROUP BY 1),
win AS (SELECT doc_id, dur, unnest(range(0, 1 + greatest(0, CAST(ceil((dur - 720000) / 600000.0) AS BIGINT)))) AS win FROM d),
t AS (SELECT doc_id, dur, win, win * 600000 AS a, least(win * 600000 + 720000, dur) AS b, string_agg(printf('[%s.%03d --> %s.%03d] %s', {_CLOCK.format("s.start_ms")}, s.start_ms % 1000, {_CLOCK.format("s.end_ms")}, s.end_ms % 1000, s.text) || chr(10), '' ORDER BY sent_ord) AS lines
  FROM win JOIN s USING (doc_id) WHERE NOT (s.end_ms < win * 600000 OR s.start_ms > least(win * 600000 + 720000, dur)) GROUP BY 1, 2, 3),
u AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, greatest(CAST(round(dur / 600000.0::DOUBLE) AS BIGINT), 1) AS target FROM t),
v AS (SELECT *, greatest(CAST(ceil(greatest(CAST(ceil(target * 1.5) AS BIGINT), 3) / n::DOUBLE) AS BIGINT), 2) AS each FROM u)
SELECT doc_id, win, each AS per_window, 'Source: "' || coalesce(source, '') || '" — total duration ' || {_CLOCK.format("dur")} || ' (' || dur || ' ms). Planning target for the whole source: about ' || target || ' clip(s); this is guidance, not a quota.' || chr(10) || chr(10)
  || 'Transcript window (' || {_CLOCK.format("a")} || ' → ' || {_CLOCK.format("b")} || '), one sentence per line as [start --> end] text:' || chr(10) || chr(10) || lines || chr(10) || chr(10) || 'Propose up to ' || each
  || ' strong candidates from THIS window only. Timestamps are absolute source milliseconds. Remember: return only the JSON object.' AS prompt FROM v JOIN documents USING (doc_id)"""
)
def model_prompts(spark, sf_dir):
    names = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("filename"))
    return prompts.prompts(segments.sentence_rows(_transcripts(spark, sf_dir)), names).select("doc_id", F.col("win").cast("long").alias("win"), "per_window", "prompt")


# Five candidates from outside for each document: (ord, start, end), the third reversed, the next two beyond the words.
_OUTSIDE_SCORES = {"self_contained": "doc_id % 3 + 3", "opening_strength": "3", "specificity": "3", "tension": "2", "payoff": "doc_id % 2 + 3", "clarity": "4 + doc_id % 2", "context_dependency": "doc_id % 4", "slop_risk": "doc_id % 7 % 3"}


def _outside(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    t = t.withColumn("duration_ms", F.get("words", F.size("words") - 1)["end_ms"] + 500)
    text = F.transform("words", lambda w: w["text"])

    def words(first: int, n: int):
        return F.array_join(F.slice(text, first + 1, n), " ")

    last = F.coalesce("duration_ms", F.lit(0))
    rows = [(0, F.lit(0), F.lit(30_000), words(0, 4), words(78, 6)), (1, F.lit(40_250), F.lit(95_555), words(0, 3), F.lit("...")), (2, F.lit(5_000), F.lit(4_000), words(0, 4), words(0, 4)),
            (3, F.lit(0), F.lit(9_999_999_999), words(0, 4), words(0, 4)), (4, last + 100, last + 400, words(0, 4), words(0, 4))]
    made = [
        F.struct(F.lit(i).alias("ord"), a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"), p.alias("opening_quote"), q.alias("closing_quote")) for i, a, b, p, q in rows
    ]
    c = t.select("doc_id", F.inline(F.array(*made))).select("*", *[F.expr(f"cast({x} as int)").alias(k) for k, x in _OUTSIDE_SCORES.items()])
    return c, t


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


_LOW = [("self_contained", "<", 4, "below"), ("payoff", "<", 3, "below"), ("clarity", "<", 4, "below"), ("context_dependency", ">", 2, "above"), ("slop_risk", ">", 2, "above")]
_JUDGED = f"""{_W}, dz AS (SELECT doc_id, l, len(l) AS n, CASE WHEN len(l) > 0 THEN 360 * len(l) + 440 ELSE 0 END AS dur FROM ws),
c0 AS (SELECT doc_id, l, n, dur, CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS ord, CAST(unnest([0, 40250, 5000, 0, dur + 100]) AS BIGINT) AS st, CAST(unnest([30000, 95555, 4000, 9999999999, dur + 400]) AS BIGINT) AS en,
  unnest([array_to_string(l[1:4], ' '), array_to_string(l[1:3], ' '), '', '', '']) AS oq, unnest([array_to_string(l[79:84], ' '), '...', '', '', '']) AS cq FROM dz),
c2 AS (SELECT *, greatest(0, (st + 60) // 360) AS a, least(n - 1, (en + 359) // 360 - 1) AS b, {", ".join(f"{x} AS {k}" for k, x in _OUTSIDE_SCORES.items())} FROM c0),
c3 AS (SELECT *, CASE WHEN st >= en OR en > dur + 500 THEN 'bounds' WHEN a >= n OR b < 0 OR 360 * a >= 360 * b + 300 THEN 'words' END AS gate, {_norm("array_to_string(l[a + 1:b + 1], ' ')")} AS ex, {_norm("oq")} AS o, {_norm("cq")} AS c FROM c2),
c4 AS (SELECT *, CASE WHEN gate IS NULL THEN 360 * a ELSE st END AS start_ms, CASE WHEN gate IS NULL THEN 360 * b + 300 ELSE en END AS end_ms, least(greatest(strlen(ex), 1) // 4, 160) AS zone FROM c3),
c5 AS (SELECT *, end_ms - start_ms BETWEEN 20000 AND 90000 AS usual, end_ms - start_ms BETWEEN 15000 AND 110000 AND payoff >= 4 AND self_contained >= 5 AND clarity >= 4 AS exc FROM c4),
jd AS MATERIALIZED (SELECT doc_id, ord, start_ms, end_ms, gate IS NULL AND exc AND NOT usual AS excepted,
  {" + ".join(f"CAST({k} AS FLOAT) * CAST({w} AS FLOAT)" for k, w in [("self_contained", 2.0), ("payoff", 1.6), ("opening_strength", 1.4), ("clarity", 1.2), ("tension", 1.0), ("specificity", 0.8), ("context_dependency", -1.5), ("slop_risk", -2.0)])} AS quality,
  list_filter(CASE gate WHEN 'bounds' THEN [CASE WHEN st >= en THEN 'start time is not before end time' END,
      CASE WHEN en > dur + 500 THEN 'end timestamp ' || {_CLOCK.format("en")} || ' is outside the source duration ' || {_CLOCK.format("dur")} END]
    WHEN 'words' THEN ['interval contains no transcribed words']
    ELSE [{", ".join(f"CASE WHEN {k} {op} {n} THEN '{k} ' || {k} || ' is {word} {n}' END" for k, op, n, word in _LOW)},
      CASE WHEN NOT usual AND NOT exc THEN 'duration ' || ((end_ms - start_ms) // 1000) || 's falls outside 20–90 seconds' END,
      CASE WHEN o = '' THEN 'opening quote is empty' WHEN NOT contains(ex, o) THEN 'opening quote cannot be found in the transcribed excerpt' WHEN strlen(left(ex, strpos(ex, o) - 1)) > zone THEN 'opening quote is not near the start of the excerpt' END,
      CASE WHEN c = '' THEN 'closing quote is empty' WHEN NOT contains(ex, c) THEN 'closing quote cannot be found in the transcribed excerpt' WHEN strlen(right(ex, strpos(reverse(ex), reverse(c)) - 1)) > zone THEN 'closing quote is not near the end of the excerpt' END]
    END, lambda x: x IS NOT NULL) AS reasons FROM c5),
v1 AS MATERIALIZED (SELECT doc_id, ord, start_ms, end_ms, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, ord) AS rn FROM jd WHERE len(reasons) = 0),
""" + fold_sql(
    "v1",
    "CAST(greatest(least(k.b, x.end_ms) - greatest(k.a, x.start_ms), 0) AS DOUBLE) / greatest(x.end_ms - x.start_ms, 1) > 0.3 OR (x.start_ms <= k.a AND x.end_ms >= k.b)",
    name="gv",
)


@query(
    f"""WITH {_JUDGED} SELECT jd.doc_id, jd.ord, start_ms, end_ms, array_to_string(reasons, '; ') AS reasons, excepted, CAST(quality AS DOUBLE) AS quality, CAST(place AS INT) AS place
FROM jd LEFT JOIN gv ON gv.doc_id = jd.doc_id AND gv.ord = jd.ord"""
)
def candidates_judged(spark, sf_dir):
    """Candidates from outside, through the validator's gates: bounds, words, scores, duration, quotes, overlap."""
    out = validation.validated(*_outside(spark, sf_dir))
    return out.select("doc_id", "ord", "start_ms", "end_ms", F.array_join("reasons", "; ").alias("reasons"), "excepted", F.col("quality").cast("double").alias("quality"), "place")


def _lead(t: str) -> str:
    for lead in X.HEADLINE_LEADS:
        t = f"regexp_replace({t}, '^(?i){lead} \\s*', '')"
    return f"regexp_replace({t}, '[.,]+$', '')"


@query(
    f"""WITH {_P}, pw AS (SELECT g.doc_id, place, cs.* EXCLUDE (doc_id) FROM g JOIN cs ON g.doc_id = cs.doc_id AND g.ord = cs.s),
p5 AS (SELECT pw.doc_id, pw.place, pw.s, pw.e, x.sent_ord, x.text AS opener, lower(x.text) AS o, x.claim, x.cw, x.n_words AS o_words FROM pw JOIN nb x ON x.doc_id = pw.doc_id AND x.sent_ord BETWEEN pw.s AND least(pw.e, pw.s + 4)),
el AS (SELECT DISTINCT p5.doc_id, p5.place, p5.sent_ord FROM p5 JOIN nb y ON y.doc_id = p5.doc_id AND y.sent_ord BETWEEN p5.s AND p5.e AND y.sent_ord <> p5.sent_ord WHERE p5.cw >= 3 AND contains(y.claim, p5.claim)),
pt AS (SELECT p5.*, CASE WHEN el.place IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN contains(opener, '?') THEN 2 ELSE 0 END + CASE WHEN o_words BETWEEN 3 AND 16 THEN 1 ELSE 0 END - CASE WHEN {_duck(signals.VAGUE)} THEN 3 ELSE 0 END
  + CASE WHEN len(list_filter(string_split_regex(o, '\\s+'), lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}'']+|[^\\p{{L}}\\p{{N}}'']+$', '', 'g') IN ('everyone', 'everybody', 'nobody', 'never', 'always'))) > 0
    OR regexp_matches(' ' || claim || ' ', ' no one | all of us ') THEN 3 ELSE 0 END AS points FROM p5 LEFT JOIN el USING (doc_id, place, sent_ord)),
bs AS (SELECT doc_id, place, {_lead("regexp_replace(opener, '^\\s+|\\s+$', '', 'g')")} AS h FROM pt QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY points DESC, sent_ord DESC) = 1),
hl AS (SELECT *, left(h, 90) AS h9 FROM bs),
hc AS (SELECT doc_id, place, CASE WHEN length(h) > 90 THEN rtrim(CASE WHEN contains(h9, ' ') THEN left(h9, length(h9) - strpos(reverse(h9), ' ')) ELSE left(h, 87) END) || '…' ELSE h END AS t FROM hl),
ab AS (SELECT pw.*, a.text AS first, b.text AS last FROM pw JOIN nb a ON a.doc_id = pw.doc_id AND a.sent_ord = pw.s JOIN nb b ON b.doc_id = pw.doc_id AND b.sent_ord = pw.e),
qt AS (SELECT *, list_filter(string_split_regex(first, '\\s+'), lambda x: x <> '') AS fl, list_filter(string_split_regex(last, '\\s+'), lambda x: x <> '') AS ll FROM ab)
SELECT qt.doc_id, CAST(qt.place AS INT) AS proposal, upper(left(hc.t, 1)) || substr(hc.t, 2) AS headline, array_to_string(fl[1:12], ' ') AS opening_quote, array_to_string(ll[greatest(len(ll) - 11, 1):], ' ') AS closing_quote,
'The excerpt ' || CASE WHEN question_open THEN 'opens on a direct question' WHEN hook THEN 'opens by naming its subject immediately' ELSE 'opens on a complete thought' END
|| CASE WHEN contrast THEN ', sets up a tension or misconception' ELSE '' END || CASE WHEN has_number THEN ', grounds the point in specifics' ELSE '' END || CASE WHEN exchange THEN ', contains a quick question-and-answer turn' ELSE '' END
|| CASE WHEN repeated_claim THEN ', repeats its central claim for emphasis' ELSE '' END || CASE WHEN payoff_cue THEN ', lands on a stated takeaway before it ends' ELSE ', resolves at a natural sentence boundary' END
|| '. Selected by local ranking across the full transcript.' AS selection_reason FROM qt JOIN hc ON hc.doc_id = qt.doc_id AND hc.place = qt.place"""
)
def clips_presented(spark, sf_dir):
    return clips.presented(_docs(spark, sf_dir))


@query()
def layout_tracks(spark, sf_dir):
    d = _detections(spark, sf_dir)
    sizes = d.groupBy("label").agg((F.max("frame") + 1).alias("n_frames"))
    i = F.col("label")
    made = sizes.select("label", "n_frames", F.when(i % 5 == 0, 1000).otherwise(1920).alias("width"), F.lit(1000).alias("height"), (i % 7 > 0).alias("has_model"))
    return series.layout_tracks(d, made, "label")
