"""Windows and their signals: against a plain reading of each window's text, and the work they take."""

import random
import re
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from talkweave import registry
from talkweave.operators import segments, windows
from talkweave.operators.signals import CUES
from talkweave.sources.transcripts import documents_as_transcripts, spread

WORDS = """but so that's why the truth is um uh like you know kind of sort as i said earlier no one all of us never “always” nobody brought to by before we begin
it that this plain steady words said again 42 É straße ΣΑΣ myth which means lesson""".split()


def made(seed, n_docs=6):
    r = random.Random(seed)
    text, start, end, first = [], [], [], [0]
    for _ in range(n_docs):
        t = 0
        for _ in range(r.choice([0, 1, 12, 40])):
            said = " ".join(r.choice(WORDS) for _ in range(r.choice([1, 2, 3, 6, 14]))) + r.choice(["", ".", "?", "!", "…"])
            text.append(r.choice(text) if text and r.random() < 0.1 else said.capitalize())
            t += r.choice([0, 300, 900, 2000])
            start.append(t)
            t += r.choice([400, 4000, 9000])
            end.append(t)
        first.append(len(text))
    return windows.Sentences(pa.array(text, pa.string()), np.array(start, dtype=np.int64), np.array(end, dtype=np.int64), np.array(first, dtype=np.int64))


def norm(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip(" ")


def plain(x, a, s, e, z):
    """A window's columns, read from its joined text; ``a`` and ``z`` bound the document."""
    f, text = np.float32, x.text.to_pylist()

    def score(j):
        pays = any(c in text[j].lower() for c in CUES["payoff"])
        pause = f(0.5) if j + 1 == z else f(0.8) if x.start[j + 1] - x.end[j] >= 700 else f(0)
        base = f(1.0 if text[j][-1] in ".?!…" else 0) + (f(1.4) if pays else f(0)) + pause
        off = min(f(float(abs(f((x.end[j] - x.start[s]) / 1000) - f(45))) / 45), f(1))
        return base + (f(1) - off * f(0.6))

    own = text[s : e + 1]
    low, claims, count = [t.lower() for t in own], [norm(t) for t in own], [len(t.split()) for t in own]
    t, said = " ".join(low), " " + " ".join(c for c in claims if c).replace(" ", "  ") + " "
    pairs = [(i, j) for j in range(len(own)) for i in range(j)]
    some = {k: any(c in t for c in CUES[k]) for k in ("contrast", "reference", "housekeeping")}
    return score, some | {
        "payoff_cue": any(c in y.lower() for c in CUES["payoff"] for y in text[max(e - 1, a) : e + 1]),
        "words": sum(count),
        "fillers": sum(len(re.findall(f"(?= {k.replace(' ', '  ')} )", said)) for k in CUES["fillers"]),
        "has_number": "42" in t,
        "repeated_claim": any((len(claims[i].split()) >= 3 and claims[i] in claims[j]) or (len(claims[j].split()) >= 3 and claims[j] in claims[i]) for i, j in pairs),
        "exchange": any("?" in own[i] and count[i + 1] <= 12 and x.start[s + i + 1] - x.end[s + i] <= 1500 for i in range(len(own) - 1)),
        "absolute_claim": bool(re.search("  no  one  |  all  of  us  ", " " + said + " ")) or any(re.sub(r"^[^\w']+|[^\w']+$", "", w) in CUES["absolute"] for w in t.split()),
        "hook": low[0].startswith(tuple(CUES["hook"])) or "?" in own[0],
    }


@pytest.mark.parametrize("seed", range(8))
def test_signals_are_those_of_the_joined_text(seed):
    x = made(seed)
    doc, got = windows.measured(x, CUES)
    seen = 0
    for k, d in enumerate(doc.tolist()):
        a, z = int(x.first[d]), int(x.first[d + 1])
        s, e = a + int(got["s"][k]), a + int(got["e"][k])
        score, want = plain(x, a, s, e, z)
        assert {c: got[c][k] for c in want} == want
        ends = [j for j in range(s, z) if 20_000 <= x.end[j] - x.start[s] <= 90_000]
        assert (-got["end_score"][k], e) == min((-score(j), j) for j in ends)
        seen += 1
    starts = [s for d in range(len(x.first) - 1) for s in range(x.first[d], x.first[d + 1]) if any(20_000 <= x.end[j] - x.start[s] <= 90_000 for j in range(s, x.first[d + 1]))]
    assert seen == len(starts) > 0


def test_slices_and_odd_texts_change_nothing(spark, monkeypatch):
    long = " ".join(["word"] * 900)  # no sentence ends but by bytes
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "One.\x0b two x. " * 200), (6, "Why? " + "no one knows. " * 150), (7, "é" * 300 + " b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t = segments.sentences(documents_as_transcripts(docs)).select("doc_id", "text", "start_ms", "end_ms").orderBy("doc_id", "start_ms").collect()
    x = windows.split_texts(pa.array([r[1] for r in rows]), 360, 300)
    assert [(rows[d][0], s, a, b) for d, s, a, b in zip(x.doc.tolist(), x.text.to_pylist(), x.start.tolist(), x.end.tolist())] == [tuple(r) for r in t]
    doc, whole = windows.measured(x, CUES)
    monkeypatch.setattr(windows, "SLICE_PAIRS", 7)
    assert all((whole[c] == v).all() for c, v in windows.measured(x, CUES)[1].items())
    by_rows = windows.windows_of_rows(segments.sentence_rows(documents_as_transcripts(docs)), CUES)
    by_text = windows.windows_of_texts(docs, CUES, 360, 300)
    assert sorted(by_rows.collect()) == sorted(by_text.collect()) and by_text.count() == len(doc)


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    """800 documents of 1500 words, so that some 100,000 windows overlap."""
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(1500)) for _ in range(800)]
    path = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


@pytest.mark.parametrize("name", ["clips_presented", "project_views", "proposals_greedy", "rubric_scores", "window_signals"])
def test_windows_take_little_longer_than_sentences(spark, talk, name):
    """Windows hold their sentences some ten times over; their signals must not be read as often."""
    plain_time = min(seconds(registry.QUERIES["sentences_full"](spark, talk)) for _ in range(2))
    assert min(seconds(registry.QUERIES[name](spark, talk)) for _ in range(2)) < 2.5 * plain_time


def calls_made(f):
    """How many functions are called from Python, those written in C included."""
    made = [0]

    def count(frame, event, arg):
        made[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return made[0]


def prose(said, n_docs=300, n_sentences=60):
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(4, 9)))
    return pa.array([" ".join(" ".join([word(), word(), *said, *(word() for _ in range(12))]) + "." for _ in range(n_sentences)) for _ in range(n_docs)], pa.string())


def test_proposals_greedy_reads_no_sentence_alone():
    """Texts are gone through as arrays: Python isn't called once a sentence (it was some ten times)."""
    x = windows.split_texts(prose([]), 360, 300)
    assert calls_made(lambda: windows.measured(x, CUES)) < len(x.start)


def test_rubric_scores_call_nothing_for_each_cue():
    """Places of cues and of absolute words are found at once: Python isn't called for each of them."""
    x = windows.split_texts(prose("so um like wrong never nobody actually lie but you know".split()), 360, 300)
    assert calls_made(lambda: windows.measured(x, CUES)) < len(x.start)


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of one row group has many partitions, of which one has all rows."""
    texts = prose([], 50)
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        held = lambda df: df.select(F.spark_partition_id()).distinct().count()
        cores = spark.sparkContext.defaultParallelism
        assert docs.rdd.getNumPartitions() >= cores > held(docs)
        assert held(spread(docs)) == cores
        assert sorted(spread(docs).collect()) == sorted(docs.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
