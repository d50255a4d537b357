"""Cases that the generated tables don't have: cues, scans, folds, captions and streams."""

import json

from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import evals, segments, series, signals, validation
from talkweave.operators.intervals import greedy_mark
from talkweave.sources import transcripts as T
from talkweave.streaming import lifecycle


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def script(spark, lines, gap=400):
    words, t = [], 0
    for line in lines:
        t += gap
        for w in line.split():
            words.append((w, t, t + 300, 0.92))
            t += 360
    return spark.createDataFrame([(1, words)], "doc_id long, words array<struct<text:string,start_ms:bigint,end_ms:bigint,p:double>>")


def test_text_functions(spark):
    assert one(spark, X.slug(F.col("t"), 48), t="  Héllo, World!! ") == "h-llo-world"
    assert one(spark, X.slug(F.col("t"), 48), t="!!") == "clip"
    assert one(spark, X.clock(F.col("t")), t=3_725_000) == "1:02:05"
    assert one(spark, X.subtitle_time(F.col("t")), t=61_239) == "0:01:01.23"
    assert one(spark, X.hex_to_bgr(F.col("t")), t="#FFDD00") == "00DDFF"
    assert one(spark, X.rate(F.col("t")), t="30000/1001") == 30000 / 1001
    assert one(spark, X.rate(F.col("t")), t="0/0") is None
    assert one(spark, X.table_cell(F.col("t")), t="a|b") == "a\\|b"
    assert one(spark, X.headline(F.col("t")), t="so and this works.") == "This works"


def test_sentences_break_at_punctuation_pause_and_bytes(spark):
    t = script(spark, ["One two.", "three " + "é" * 130 + " " + "x" * 10, "four"], gap=1500)
    got = [r["text"] for r in segments.sentences(t).orderBy("sent_ord").collect()]
    assert got[0] == "One two." and got[-1] == "four" and len(got) == 4  # 260 bytes, not characters


def scored(spark, lines):
    return signals.scored(signals.best_windows(signals.with_features(segments.sentence_rows(script(spark, lines))))).collect()


FILL = "This part explains how the plain method works over a long and steady stretch of careful words spoken one after another here."


def test_housekeeping_and_fillers_are_blocked_and_insight_passes(spark):
    assert all(r["s"] > 0 for r in scored(spark, ["Welcome back to the show, what a day."] + [FILL] * 4))
    assert not scored(spark, ["Why um uh um uh um uh like um uh like what."] * 12)
    rows = scored(spark, ["Why do most people fail at hard problems?", "They actually stop too early.", FILL, FILL, "That's why practice beats talent."])
    assert rows and rows[0]["hook"] and rows[0]["contrast"] and rows[0]["self_contained"] == 5


def test_only_kept_rows_suppress(spark):
    # the first suppresses the second, which would suppress the third
    rows = spark.createDataFrame(
        [(1, 0, 0, 100, 3.0), (1, 1, 50, 150, 2.0), (1, 2, 110, 210, 1.0)], "doc_id int, ord int, start_ms long, end_ms long, score double"
    )
    got = greedy_mark(rows, "doc_id", -F.col("score"), 0.3).orderBy("ord").collect()
    assert [r["place"] for r in got] == [1, None, 2]
    inside = spark.createDataFrame([(1, 0, 10, 30, 2.0), (1, 1, 10, 100, 1.0)], rows.schema)
    assert [r["place"] for r in greedy_mark(inside, "doc_id", -F.col("score"), 0.3, containing=True).orderBy("ord").collect()] == [1, None]


def test_recogniser_tokens(spark):
    def tok(t, a, b, p=0.9):
        return {"text": t, "p": p, "offsets": {"from": a, "to": b}, "t_dtw": 0}

    raw = {"result": {"language": "en"}, "transcription": [{"text": "x", "offsets": {"from": 0, "to": 1}, "tokens": [
        tok("[_BEG_]", 0, 0), tok(" Fast", 180, 100), tok(" slow", 400, 700), tok("ly", 700, 900), tok(" now", 950, 1050), tok(".", 1050, 1100)]}]}
    df = spark.read.schema(T.RECOGNISER_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(raw)])).withColumn("project_id", F.lit("a"))
    got = [(r["text"], r["start_ms"], r["end_ms"]) for r in T.recognised_words(df).orderBy("start_ms").collect()]
    assert got == [("Fast", 100, 180), ("slowly", 400, 900), ("now.", 950, 1050)]


def test_probe_reply_and_loudness(spark):
    ok = {"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "0/0", "r_frame_rate": "25/1"}, {"codec_type": "audio"}]}
    df = spark.createDataFrame([(json.dumps(ok),), ('{"format": {}, "streams": []}',)], "json string")
    a, b = T.probed_source(df).collect()
    assert (a["duration_ms"], a["fps"], a["error"], b["error"]) == (12500, 25.0, None, "no video stream")
    reply = '```json\n{"candidates": [{"start_ms": 1, "end_ms": 5, "headline": " x ", "scores": {"payoff": 9}}, {"start_ms": 7, "end_ms": 2}]}\n```'
    (r,) = T.reply_candidates(spark.createDataFrame([(reply,)], "reply string")).collect()
    assert (r["start_ms"], r["headline"], r["scores"]) == (1, "x", {"payoff": 5})
    lines = [("p", 1, "frame:0 pts_time:0.5"), ("p", 2, "x RMS_level=-20.0"), ("p", 3, "frame:1 pts_time:1.2"), ("p", 4, "x RMS_level=-inf")]
    got = T.loudness_samples(spark.createDataFrame(lines, "project_id string, line int, value string")).orderBy("sec").collect()
    assert [(r["sec"], r["db"]) for r in got] == [(0, -20.0), (1, None)]


def test_pages_lose_no_words_and_accents(spark):
    t = script(spark, ["One, two three four five six seven eight nine.", "Ten eleven extraordinarily twelve"])
    n = len(t.first()["words"])
    for pages in (series.clean_pages(t), series.impact_pages(t)):
        rows = pages.orderBy("page").collect()
        assert rows[0]["word_start"] == 0 and rows[-1]["word_end"] == n
        assert all(a["word_end"] == b["word_start"] for a, b in zip(rows, rows[1:]))
    px = spark.createDataFrame([("a", 18.0, 32.0, 75.0), ("b", 210.0, 92.0, 45.0)], "k string, r double, g double, b double")
    assert {r["k"]: r["accent"] for r in series.choose_accent(px, "k").collect()} == {"a": "#FFDD00", "b": "#4FB5FF"}


def test_rubric_and_gate(spark):
    cols = ["source", *evals.RUBRIC_SCORES, "decision_error"]
    rows = [("a", "5", "4", "3", "5", "5", "5", ""), ("b", "9", "1", "1", "1", "1", "1", ""), ("c", "1", "1", "1", "1", "1", "2", " False_Accept "), ("d", "1", "", "", "", "", "", ""), ("", "", "", "", "", "", "", "")]
    got = evals.review(evals.rubric_rows(spark.createDataFrame(rows, cols))).first()
    assert (got["reviewed"], got["would_post_rate"], got["false_accepts"], got["payoff_1to5"]) == (3, 0.333, 1, 2.0)


def test_streams(spark, tmp_path):
    rows = [("a", 0, 0.0), ("a", 100, 0.5), ("a", 500, 0.505), ("a", 900, 0.9)]
    spark.createDataFrame(rows, "run string, at_ms long, fraction double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, at_ms long, fraction double").parquet(str(tmp_path / "in"))
    q = lifecycle.throttled(stream).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["at_ms"] for r in spark.table("kept").collect()) == [0, 500, 900]


def test_energy_counts_silence(spark):
    rows = [("a", 0, -20.0), ("a", 0, -40.0), ("a", 0, None), ("a", 1, -70.0), ("a", 1, -10.0), ("a", 3, None), ("b", 0, None)]
    got = series.energy_profile(spark.createDataFrame(rows, "k string, sec int, db double"), "k").collect()
    assert {(r["k"], r["sec"]): round(r["db"], 2) for r in got} == {("a", 0): -43.33, ("a", 1): -40.0, ("a", 2): -70.0, ("a", 3): -70.0, ("b", 0): -60.0}


def test_headlines_fonts_stages_and_names(spark):
    assert one(spark, X.headline(F.col("t")), t="So, this works.") == "So, this works"
    assert one(spark, X.headline(F.col("t")), t="x" * 100) == "X" + "x" * 86 + "…"
    assert one(spark, X.headline(F.col("t")), t="word " * 30) == "Word " + "word " * 16 + "word…"
    assert one(spark, X.font_name(F.col("t")), t=" arial ") == "Arial" and one(spark, X.font_name(F.col("t")), t="Anton") is None
    assert one(spark, X.display_state(F.col("t")), t="rendering") == "rendering" and one(spark, X.display_state(F.col("t")), t="render") == "created"
    assert one(spark, X.clip_filename(F.col("n"), F.col("t")), n=3, t="Hello, World!") == "03-hello-world.mp4"
    assert one(spark, X.caption_style(F.col("t")), t="Minimal") == "clean" and one(spark, X.caption_style(F.col("t"), strict=True), t="minimal") is None
    counts = [tuple(one(spark, X.plan_counts(F.col("ms")), ms=ms)) for ms in (0, 900_000, 3_600_000)]
    assert counts == [(1, 3), (2, 3), (6, 9)]


def test_byte_ranges(spark):
    cases = [(None, 10, ("whole", None, None)), ("bytes=0-4", 10, ("part", 0, 4)), ("bytes=5-", 10, ("part", 5, 9)), ("bytes=-3", 10, ("part", 7, 9)), ("bytes=-30", 10, ("part", 0, 9)), ("bytes=2-99", 10, ("part", 2, 9))]
    cases += [(s, n, ("invalid", None, None)) for s, n in (("bytes=10-", 10), ("bytes=4-2", 10), ("bytes=-0", 10), ("bytes=0-1,3-4", 10), ("items=0-1", 10), ("bytes=-", 10), ("bytes=0-1", 0))]
    rows = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(cases)], "i int, spec string, n long")
    got = {r["i"]: tuple(r["x"]) for r in rows.select("i", X.byte_range(F.col("spec"), F.col("n")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_recognised_words(spark):
    def token(text, a, b, p=0.5):
        return {"text": text, "p": p, "offsets": None if a is None else {"from": a, "to": b}}

    def scan(name, *segs):
        return (name, [{"text": t, "offsets": {"from": a, "to": b}, "tokens": toks} for t, a, b, toks in segs])

    rows = [
        scan("plain", ("", 0, 0, [token("[_BEG_]", 0, 0), token(" Fast", 100, 180), token(" slow", 400, 600), token("ly", 600, 900), token(" now", 950, 1050), token(".", 1050, 4000)])),
        scan("overlap", ("", 0, 0, [token(" one", 250, 100), token(" two", 100, 300)])),
        scan("breaks", ("", 0, 0, [token(" ,", 0, 5), token("a", 10, 90), token(" (music)", 90, 100), token("b", 100, 200), token(" c", 200, 300)]), ("", 0, 0, [token("d", 400, 500)])),
        scan("segments", (" whole line ", 5, 50, [token(" x", None, None, 0.25)]), ("[noise]", 50, 60, []), ("...", 60, 70, [])),
    ]
    got = T.recognised_words(spark.createDataFrame(rows, "project_id string, " + T.RECOGNISER_SCHEMA.split(">", 1)[1].lstrip(",\n ").replace(", t_dtw: bigint", ""))).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["project_id"], r["ord"])):
        by.setdefault(r["project_id"], []).append((r["text"], r["start_ms"], r["end_ms"]))
    assert by["plain"] == [("Fast", 100, 180), ("slowly", 400, 900), ("now.", 950, 1050)]
    assert by["overlap"] == [("one", 100, 175), ("two", 175, 300)]
    assert by["breaks"] == [("a", 10, 90), ("b", 100, 200), ("c", 200, 300), ("d", 400, 500)]
    assert by["segments"] == [("whole line", 5, 50)] and [r["p"] for r in got if r["project_id"] == "segments"] == [0.25]


def test_validator_gates(spark):
    words = [(f"word{i}", 400 * i, 400 * i + 350, 0.9) for i in range(200)]
    t = spark.createDataFrame([(1, words, 80_000)], "doc_id long, words array<struct<text:string,start_ms:bigint,end_ms:bigint,p:double>>, duration_ms long")
    good = dict(self_contained=5, opening_strength=4, specificity=4, tension=4, payoff=5, clarity=5, context_dependency=1, slop_risk=1)

    def cand(n, a, b, first, last, **change):
        return (1, n, a, b, first, last, *[{**good, **change}[k] for k in validation.SCORES])

    rows = [
        cand(0, 10, 30_010, "Word0, word1", "word74"),
        cand(1, 5, 5, "", ""),
        cand(2, 0, 80_501, "", ""),
        cand(3, 355, 395, "word0", "word0"),
        cand(4, 0, 30_000, "nothing", "word2", payoff=2, slop_risk=3),
        cand(5, 40_000, 57_000, "word100", "word142"),
        cand(6, 40_000, 50_000, " ", "word124"),
    ]
    schema = "doc_id long, ord int, start_ms long, end_ms long, opening_quote string, closing_quote string, " + ", ".join(f"{k} int" for k in validation.SCORES)
    got = {r["ord"]: r for r in validation.validated(spark.createDataFrame(rows, schema), t).collect()}
    assert {k: r["reasons"] for k, r in got.items()} == {
        0: [],
        1: ["start time is not before end time"],
        2: ["end timestamp 01:20 is outside the source duration 01:20"],
        3: ["interval contains no transcribed words"],
        4: ["payoff 2 is below 3", "slop_risk 3 is above 2", "opening quote cannot be found in the transcribed excerpt", "closing quote is not near the end of the excerpt"],
        5: [],
        6: ["duration 9s falls outside 20–90 seconds", "opening quote is empty"],
    }
    assert got[5]["excepted"] and not got[0]["excepted"] and {got[0]["place"], got[5]["place"]} == {1, 2}


def test_layouts(spark):
    seen = [("one", f, 0, 0.4) for f in (1, 2, 3)] + [("two", f, k, x) for f in range(4) for k, x in enumerate((0.3, 0.7))] + [("rare", 0, 0, 0.5)] + [("tall", f, 0, 0.5) for f in range(4)]
    d = spark.createDataFrame(seen, "k string, frame int, nth int, cx double")
    clips = spark.createDataFrame([(k, 4, 1080 if k == "tall" else 1920, 1080, True) for k in ("one", "two", "rare", "tall", "none")], "k string, n_frames int, width int, height int, has_model boolean")
    got = {r["k"]: (r["mode"], r["track"]) for r in series.layout_tracks(d, clips, "k").collect()}
    assert got["one"] == ("face_crop", [0.4] * 4) and all(got[k] == ("blur_pad", None) for k in ("two", "rare", "tall", "none"))
