"""Caption events against a plain version, framing, gate and writers."""

import re

from pyspark.sql import functions as F

from talkweave.operators import artifacts, captions, evals, framing, series
from talkweave.sources import reports

WORDS = "doc_id long, words array<struct<text:string,start_ms:bigint,end_ms:bigint,p:double>>"


def pitch(text, step=330, length=280):
    return [(t, i * step, i * step + length, 0.9) for i, t in enumerate(text.split())]


def pages_of(pages):
    return [(r["word_start"], r["word_end"]) for r in pages.orderBy("page").collect()]


def times(words, spans, clip_len, pad):
    """Expected (start, end, active word or None) of every word, in order."""
    out = []
    for k, (a, b) in enumerate(spans):
        nxt = words[b][1] if b < len(words) else 10**15
        ceiling = min(words[b - 1][2] + pad, nxt, max(clip_len, words[b - 1][2]))
        for i in range(a, b):
            until = words[i + 1][1] if i + 1 < b else ceiling
            end = min(max(words[i][2], words[i][1] + 10), until)
            if end > words[i][1]:
                out.append((words[i][1], end, i))
                if until > end:
                    out.append((end, until, None))
    return out


def test_clean_events(spark):
    words = pitch("It {was} a\\b long, slow and very quiet day. Then nothing happened at all") + [("late", 9000, 9100, 0.9)]
    t = spark.createDataFrame([(1, words), (2, []), (3, None)], WORDS)
    got = {r["doc_id"]: r["events"] for r in captions.clean_events(t, F.lit(9300).cast("long"), F.lit("What came next")).collect()}
    assert [e["style"] for e in got[2]] == ["Headline"] == [e["style"] for e in got[3]]
    top, *rest = got[1]
    assert (top["start_ms"], top["end_ms"], top["style"], top["text"]) == (0, 3500, "Headline", "What came next")
    spans = pages_of(series.clean_pages(t.where("doc_id = 1")))
    assert [(e["start_ms"], e["end_ms"]) for e in rest] == [(a, b) for a, b, _ in times(words, spans, 9300, 160)]
    assert rest[0]["text"] == "{\\c&H24B2FF&}It{\\c&HFFFFFF&} (was) a/b long,"
    assert rest[1]["text"] == "It (was) a/b long,"
    assert not captions.clean_events(t, F.lit(9300).cast("long"), F.lit("It was a day")).where("doc_id = 1 and events[0].style = 'Headline'").count()
    doc = captions.documents(captions.clean_events(t, F.lit(9300).cast("long")), captions.clean_header()).where("doc_id = 1").first()["document"]
    lines = doc.split("\n")
    assert lines[0] == "[Script Info]" and "Dialogue: 0,0:00:00.00,0:00:00.28,Caption,,0,0,0," in doc and lines[-1] == ""


def test_impact_events(spark):
    words = pitch("the quiet river because of an extraordinarily-long-unbroken-compound it is")
    t = spark.createDataFrame([(1, words)], WORDS)
    spans = pages_of(series.impact_pages(t))
    events = captions.impact_events(t, F.lit(5000).cast("long")).first()["events"]
    # every line of a page has the times of the page's words
    lines = []
    for a, b in spans:
        texts = [w[0] for w in words[a:b]]
        size = lambda x: sum(c.isalnum() for c in x)
        own = [i for n in (5, 3) for i in [max([i for i, x in enumerate(texts) if size(x) >= n and x not in captions.COMMON_WORDS], default=None)] if i is not None]
        e = own[0] if own else max(range(len(texts)), key=lambda i: (size(texts[i]), i))
        lines.append([x for x in (texts[:e], [texts[e].upper()], texts[e + 1 :]) if x])
    want = []
    page_of = {i: k for k, (a, b) in enumerate(spans) for i in range(a, b)}
    plain = times(words, spans, 5000, 200)
    k = 0
    while k < len(plain):
        s, e, i = plain[k]
        neutral = plain[k + 1] if k + 1 < len(plain) and plain[k + 1][2] is None else None
        for line in lines[page_of[i]]:
            want.append((s, e, " ".join(line)))
            if neutral:
                want.append((neutral[0], neutral[1], " ".join(line)))
        k += 2 if neutral else 1
    assert [(x["start_ms"], x["end_ms"], re.sub(r"\{[^}]*\}", "", x["text"])) for x in events] == want
    assert events[0]["text"].startswith("{\\an5\\pos(") and "\\fscx90\\fscy90\\t(0,110,\\fscx100\\fscy100)}" in events[0]["text"]
    large = next(x for x in events if "EXTRAORDINARILY" in x["text"])
    assert "\\pos(540," in large["text"] and "\\fs92" in large["text"]


def test_lockup_places(spark):
    t = spark.createDataFrame([(1, pitch("the quiet day"))], WORDS)
    (row,) = t.select(captions.lockup(F.col("words"), F.lit(0)).alias("l")).collect()
    # small, large, small: 72.8, 156 and 72.8 high around 1270
    assert [(x["emphasis"], x["fs"], round(x["x"]), round(x["y"], 1)) for x in row["l"]] == [(False, 70.0, 506, 1155.6), (True, 150.0, 540, 1270.0), (False, 70.0, 506, 1384.4)]


def test_words_without_length_and_edits(spark):
    t = spark.createDataFrame([(1, [("a", 100, 100, 0.5), ("b", 100, 100, 0.5), ("c", 300, 400, 0.5)])], WORDS)
    got = t.select(captions.relative_words(F.col("words"), F.lit(50).cast("long")).alias("w")).first()["w"]
    assert [(w["start_ms"], w["end_ms"]) for w in got] == [(50, 60), (60, 70), (250, 350)]
    edit = lambda x: [(w["text"], w["start_ms"], w["end_ms"], w["p"]) for w in t.select(captions.edited_words(F.col("words"), F.lit(x)).alias("w")).first()["w"]]
    assert [w[0] for w in edit("x y z")] == ["x", "y", "z"] and edit("x y z")[2][1:] == (300, 400, 0.5)
    assert edit("one two") == [("one", 100, 250, 1.0), ("two", 250, 400, 1.0)]
    assert edit("  ") == [] and [w[0] for w in edit(None)] == ["a", "b", "c"]
    within = t.select(captions.words_within(F.col("words"), F.lit(100), F.lit(399)).alias("w")).first()["w"]
    assert [w["text"] for w in within] == ["a", "b"]


def test_framing(spark):
    jump = spark.createDataFrame([("a", i, 0.2 if i < 4 else 0.9) for i in range(60)] + [("b", 0, 0.5)], "k string, frame int, cx double")
    got = {r["k"]: [(x["t_ms"], round(x["cx"], 6)) for x in r["keyframes"]] for r in framing.crop_keyframes(jump, "k").collect()}
    assert got["b"] == [(0, 0.5)] and got["a"][:3] == [(0, 0.2), (4000, 0.6), (6000, 0.8)] and got["a"][-1] == (8000, 0.9)
    drift = spark.createDataFrame([("a", i, i / 100) for i in range(60)], "k string, frame int, cx double")
    (r,) = framing.crop_keyframes(drift, "k").collect()
    assert len(r["keyframes"]) <= 12 and [x["t_ms"] for x in r["keyframes"]] == [8000 * i for i in range(8)]
    keys = spark.createDataFrame([([(0, 0.5), (2000, 0.6)],)], "k array<struct<t_ms:bigint,cx:double>>")
    x = keys.select(framing.crop_x(F.col("k"), F.lit(3414)), framing.filter_graph(F.lit(1080), F.lit(1920), F.lit(None).cast("array<struct<t_ms:bigint,cx:double>>"))).first()
    assert x[0] == "if(lt(t\\,2.000)\\,1167.0+(1508.4-1167.0)*(t-0.000)/2.000\\,1508.4)" and x[1].startswith("[0:v]setpts=PTS-STARTPTS,split=2")
    assert spark.range(1).select(framing.filter_quoted(F.lit("C:\\it's"))).first()[0] == "C\\:/it'\\''s"


def test_reconcile_and_interrupted(spark):
    files = [("clips", "a.mp4", 9), ("clips", "b.mp4", 0), ("clips", "b.ready", 6), ("clips", "c.mp4", 9), ("clips", "c.ready", 0), ("base", "a.mp4", 9), ("base", "z.ready", 6),
             ("base", "y.mp4", 9), ("base", "y.ready", 6), ("root", "audio.wav", 9), ("root", "project.json", 9), ("frames", "1.jpg", 9), ("clips", "a.ass", 1), ("other", "x", None)]
    f = spark.createDataFrame([("p", *x) for x in files], "project_id string, folder string, name string, size long")
    c = spark.createDataFrame([("p", x, f"{x}.mp4", "ready") for x in "abc"], "project_id string, clip_id string, filename string, status string")
    got = {(r["folder"], r["name"]): r["action"] for r in artifacts.reconcile(f, c).collect()}
    assert len(got) == len(files)
    assert {k for k, v in got.items() if v == "keep_and_mark"} == {("clips", "a.mp4"), ("base", "a.mp4")}
    assert {k for k, v in got.items() if v == "keep"} == {("base", "y.mp4"), ("base", "y.ready"), ("root", "project.json"), ("other", "x")}
    p = spark.createDataFrame([("a", "rendering"), ("b", "rendering"), ("c", "complete")], "project_id string, status string")
    out = artifacts.interrupted(p, p.where("project_id = 'b'"))
    assert {r["project_id"]: r["status"] for r in out.collect()} == {"a": "failed", "b": "rendering", "c": "complete"}


def test_gate_and_reports(spark):
    cols = "would_post_rate double, hook double, payoff double, framing double"
    cur = spark.createDataFrame([(0.4, 3.0, 4.0, None)], cols)
    base = spark.createDataFrame([(0.5, 3.2, 4.5, 3.0)], cols)
    none = spark.createDataFrame([], "source_id string")
    got = evals.gate(cur, base, spark.createDataFrame([("s2",), ("s1",)], "source_id string"), scores=["hook", "payoff", "framing"]).first()
    assert (got["status"], got["failure_reasons"]) == ("fail", ["new source failures: s1, s2", "would-post rate dropped by 0.100", "payoff average dropped by 0.500"])
    assert got["warnings"] == ["framing comparison unavailable"]
    assert evals.gate(base, base, none, scores=["hook"]).first()["status"] == "pass"
    report = spark.createDataFrame([("r|1", 3, None)], "run_id string, source_count int, completion_rate double")
    sources = spark.createDataFrame([("b", "x\ny"), ("a", None)], "source_id string, error string")
    lines = [r["line"] for r in reports.markdown_lines(report, sources).orderBy("part", "at").collect()]
    assert lines[0] == "# Evaluation — r\\|1" and "| completion_rate | — |" in lines
    assert lines[-2:] == ["| a | — | — | — | — | — | — | — |", "| b | — | — | — | — | — | — | x y |"]
    assert reports.json_row(report).first()["value"] == '{"completion_rate":null,"run_id":"r|1","source_count":3}'
    assert reports.csv_row(report).columns == reports.CSV_FIELDS
