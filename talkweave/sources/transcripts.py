"""Scans: recogniser and probe JSON, loudness logs, model replies, rubric tables, and documents as words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from talkweave.functions.text import once, rate

WORD_PITCH_MS, WORD_MS = 360, 300

RECOGNISER_SCHEMA = """
result struct<language: string>,
transcription array<struct<text: string, offsets: struct<`from`: bigint, `to`: bigint>,
  tokens: array<struct<text: string, p: double, offsets: struct<`from`: bigint, `to`: bigint>, t_dtw: bigint>>>>
"""
PROBE_SCHEMA = """
format struct<duration: string, size: string>,
streams array<struct<codec_type: string, codec_name: string, width: int, height: int,
  avg_frame_rate: string, r_frame_rate: string, duration: string>>
"""
REPLY_SCHEMA = """
candidates array<struct<start_ms: double, end_ms: double, headline: string, opening_quote: string,
  closing_quote: string, selection_reason: string, scores: map<string, double>>>
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores where its files give fewer partitions with rows; else as it is, without a
    shuffle. A row group is read by one task, however many partitions its file is cut into."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores or df.select(F.spark_partition_id()).distinct().count() < cores:
        return df.repartition(cores)
    return df


def timed_words(text: Column, doc: Column) -> Column:
    """A text as an array of (text, start_ms, end_ms, p): words at a fixed pitch, in one expression."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(
        words,
        lambda w, i: F.struct(
            w.alias("text"),
            (i * WORD_PITCH_MS).cast("long").alias("start_ms"),
            (i * WORD_PITCH_MS + WORD_MS).cast("long").alias("end_ms"),
            ((60 + F.pmod(7 * doc + 13 * i, F.lit(40))) / 100).alias("p"),
        ),
    )


def documents_as_transcripts(docs: DataFrame) -> DataFrame:
    """(doc_id, words): one row per document, so that per-document work needs no shuffle."""
    return spread(docs.select("doc_id", "text")).select("doc_id", once(timed_words(F.col("text"), F.col("doc_id"))).alias("words"))


def exploded_words(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("doc_id", F.posexplode("words").alias("ord", "w")).select("doc_id", "ord", "w.*")


def read_recogniser(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECOGNISER_SCHEMA).option("multiLine", True).json(path).withColumn("project_id", F.col("_metadata.file_path"))


_LEXICAL = r"[\p{L}\p{N}]"
_ANNOTATION = r"(?s)^\[.*\]$|^\(.*\)$"


def _token_words(scans: DataFrame) -> DataFrame:
    """(project_id, seg, word, text, start_ms, end_ms, p) of the words that tokens make up."""
    tokens = (
        scans.select("project_id", F.posexplode("transcription").alias("seg", "s"))
        .select("project_id", "seg", F.posexplode("s.tokens").alias("tok", "t"))
        .withColumn("text", F.regexp_replace("t.text", r"^\s+|\s+$", ""))
        .where((F.col("text") != "") & ~F.col("text").startswith("[_"))
    )
    # breaks count before anything else is left out, and no word goes on in the next segment
    order = Window.partitionBy("project_id", "seg").orderBy("tok")
    tokens = tokens.withColumn("word", F.sum(F.col("t.text").rlike(r"^\s").cast("int")).over(order)).withColumn("lexical", F.col("text").rlike(_LEXICAL))
    timed = tokens.where(~F.col("text").rlike(_ANNOTATION) & F.col("t.offsets.from").isNotNull() & F.col("t.offsets.to").isNotNull())
    a, b = F.least("t.offsets.from", "t.offsets.to"), F.greatest("t.offsets.from", "t.offsets.to")
    piece = F.struct("tok", "text", a.alias("a"), b.alias("b"), F.coalesce("t.p", F.lit(0.5)).alias("p"), "lexical")
    words = timed.groupBy("project_id", "seg", "word").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    # marks before the first lexical token belong to no word; later ones extend the text, not the time
    first = F.array_min(F.transform(F.filter("all", lambda x: x["lexical"]), lambda x: x["tok"]))
    words = words.withColumn("all", F.filter("all", lambda x: x["tok"] >= first)).withColumn("said", F.filter("all", lambda x: x["lexical"]))
    start, n = F.get("said", F.lit(0))["a"], F.size("said")
    return words.where(n > 0).select(
        "project_id",
        "seg",
        "word",
        F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text"),
        start.alias("start_ms"),
        F.greatest(F.array_max(F.transform("said", lambda x: x["b"])), start + 10).alias("end_ms"),
        (F.aggregate("said", F.lit(0.0), lambda s, x: s + x["p"]) / n).alias("p"),
    )


def _segment_words(scans: DataFrame) -> DataFrame:
    """Segments as words, for scans without timed tokens; annotations and segments without a letter or digit are left out."""
    s = scans.select("project_id", F.posexplode("transcription").alias("seg", "s"))
    text = F.regexp_replace(F.coalesce("s.text", F.lit("")), r"^\s+|\s+$", "")
    known = F.filter("s.tokens", lambda t: ~F.coalesce(t["text"].startswith("[_"), F.lit(False)) & t["p"].isNotNull())
    start = F.coalesce("s.offsets.from", F.lit(0).cast("long"))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, t: a + t["p"]), F.size(known))
    rows = s.select("project_id", "seg", F.lit(0).cast("long").alias("word"), text.alias("text"), start.alias("start_ms"), F.greatest(F.coalesce("s.offsets.to", start), start).alias("end_ms"), F.coalesce(mean, F.lit(0.5)).alias("p"))
    return rows.where(F.col("text").rlike(_LEXICAL) & ~F.col("text").rlike(_ANNOTATION))


def _apart(words: Column) -> Column:
    """Words in order, overlaps of neighbours split half-way, each word keeping 10 ms; the later word's new
    times hold when the one after it is looked at."""

    def step(out: Column, w: Column) -> Column:
        before = F.try_element_at(out, F.lit(-1))
        low, high = before["start_ms"] + 10, w["end_ms"] - 10
        half = w["start_ms"] + F.floor((before["end_ms"] - w["start_ms"]) / 2)
        cut = F.when(low <= high, F.least(F.greatest(half, low), high)).otherwise(low).cast("long")
        split = F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1),
            F.array(before.withField("end_ms", cut), w.withField("start_ms", cut).withField("end_ms", F.greatest(w["end_ms"], cut + 10))),
        )
        return F.when(before["end_ms"] > w["start_ms"], split).otherwise(F.concat(out, F.array(w)))

    return F.aggregate(words, F.filter(words, lambda w: F.lit(False)), step)


def recognised_words(scans: DataFrame) -> DataFrame:
    """Recogniser output as words: (project_id, ord, text, start_ms, end_ms, p).

    A token that begins with white space begins a word, as does a segment. Special and bracketed
    tokens, those without times and marks before a word are skipped, reversed times swapped;
    punctuation extends the text but not the time; p is the mean over lexical tokens, unknown ones
    0.5; overlapping neighbours are split. A scan without a timed word is read by segments instead.
    """
    made = _token_words(scans)
    rest = scans.join(made.select("project_id").distinct(), "project_id", "left_anti")

    def listed(words: DataFrame) -> DataFrame:
        return words.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seg", "word", "text", "start_ms", "end_ms", "p"))).alias("words"))

    whole = listed(made).select("project_id", _apart(F.col("words")).alias("words")).union(listed(_segment_words(rest)))
    return whole.select("project_id", F.posexplode("words").alias("ord", "w")).select("project_id", "ord", "w.text", "w.start_ms", "w.end_ms", "w.p")


def probed_source(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Probe JSON as source columns and ``error`` (null when the source can be used)."""
    j = F.from_json(F.col(json_col), PROBE_SCHEMA)

    def first(kind: str) -> Column:
        return F.try_element_at(F.filter(j["streams"], lambda s: s["codec_type"] == kind), F.lit(1))

    v, a = first("video"), first("audio")
    ms = F.floor(F.coalesce(j["format"]["duration"].try_cast("double"), v["duration"].try_cast("double")) * 1000).cast("long")
    error = (
        F.when(v.isNull(), "no video stream")
        .when(a.isNull(), "no audio stream")
        .when(F.coalesce(ms, F.lit(0)) <= 0, "no duration")
        .when(ms > 4 * 3600 * 1000, "longer than four hours")
        .when((F.coalesce(v["width"], F.lit(0)) <= 0) | (F.coalesce(v["height"], F.lit(0)) <= 0), "no picture size")
    )
    return raw.select(
        "*",
        ms.alias("duration_ms"),
        v["width"].alias("width"),
        v["height"].alias("height"),
        F.coalesce(rate(v["avg_frame_rate"]), rate(v["r_frame_rate"]), F.lit(30.0)).alias("fps"),
        F.coalesce(v["codec_name"], F.lit("unknown")).alias("video_codec"),
        F.coalesce(a["codec_name"], F.lit("unknown")).alias("audio_codec"),
        F.coalesce(j["format"]["size"].try_cast("long"), F.lit(0).cast("long")).alias("size_bytes"),
        error.alias("error"),
    )


def loudness_samples(lines: DataFrame) -> DataFrame:
    """Log lines (project_id, line, value) as (project_id, sec, db); silence (-inf) is null."""
    order = Window.partitionBy("project_id").orderBy("line")
    seen = lines.withColumn("pts", F.nullif(F.regexp_extract("value", r"pts_time:\s*([0-9.]+)", 1), F.lit("")).try_cast("double"))
    seen = seen.withColumn("at", F.last("pts", ignorenulls=True).over(order))
    level = F.coalesce(
        F.nullif(F.regexp_extract("value", r"RMS_level=(-?[0-9.]+|-?inf|nan)", 1), F.lit("")),
        F.nullif(F.regexp_extract("value", r"frame:\d+\|.*\|value:(-?[0-9.]+|-?inf)", 1), F.lit("")),
    )
    hits = seen.withColumn("level", level).where("level is not null").withColumn("nth", F.row_number().over(order) - 1)
    return hits.select(
        "project_id",
        F.floor(F.coalesce("at", F.col("nth").cast("double"))).cast("int").alias("sec"),
        F.when(~F.col("level").contains("inf"), F.col("level").try_cast("double")).alias("db"),
    )


def reply_candidates(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """Candidates in model replies: fences dropped, first brace to last, bad times left out."""
    body = F.regexp_extract(F.regexp_replace(F.col(text_col), "```(json)?", ""), r"(?s)(\{.*\})", 1)
    rows = replies.select("*", F.posexplode_outer(F.from_json(body, REPLY_SCHEMA)["candidates"]).alias("cand_ord", "c"))
    return rows.where("c.start_ms is not null and c.end_ms is not null and c.start_ms >= 0 and c.start_ms < c.end_ms").select(
        *replies.columns,
        "cand_ord",
        F.col("c.start_ms").cast("long").alias("start_ms"),
        F.col("c.end_ms").cast("long").alias("end_ms"),
        *[F.trim(f"c.{x}").alias(x) for x in ("headline", "opening_quote", "closing_quote", "selection_reason")],
        F.transform_values("c.scores", lambda k, v: F.least(F.greatest(F.round(v), F.lit(1.0)), F.lit(5.0)).cast("int")).alias("scores"),
    )


def provider_error(status: Column, body: Column) -> Column:
    """What an HTTP status of a model provider means, with the body's first 240 characters."""
    return (
        F.when(status.isin(401, 403), "the key was rejected")
        .when(status == 429, "the provider's rate limit was reached")
        .when(status == 404, "no such model")
        .when(status == 400, F.concat(F.lit("the request was refused: "), F.substring(body, 1, 240)))
        .when(status >= 500, "the provider failed")
        .otherwise(F.format_string("status %d: %s", status, F.substring(body, 1, 240)))
    )


def progress_fraction(line: Column, duration_ms: Column) -> Column:
    out = F.nullif(F.regexp_extract(line, r"out_time_ms=(\d+)", 1), F.lit("")).try_cast("double") / 1000
    return F.least(F.greatest(F.try_divide(out, duration_ms), F.lit(0.0)), F.lit(1.0))


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """The rubric table, all strings; row numbers count from 2, after the header."""
    one = spark.read.csv(path, header=True, multiLine=True)  # a file is one task's, so its rows are numbered in order
    return one.withColumn("row", F.monotonically_increasing_id() % (1 << 33) + 2)


def read_runs(spark: SparkSession, run_dir: str) -> DataFrame:
    """Result documents of an evaluation run, one per source folder."""
    return spark.read.option("multiLine", True).json(f"{run_dir}/sources/*/result.json").withColumn("dir", F.col("_metadata.file_path"))
