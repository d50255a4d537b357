"""Runs, requests and reviews: cases that the registered fixtures don't have."""

import json

from pyspark.sql import functions as F

from talkweave.functions import text as X
from talkweave.operators import evals, requests, reviews, runs
from talkweave.sources import health
from talkweave.sources import transcripts as T
from talkweave.streaming import lifecycle


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


REQUESTS = [(1, "start", None), (2, "start", None), (3, "cancel", None), (4, "cancel", None), (5, "finish", 9), (6, "finish", 1), (7, "cancel", None), (8, "start", None), (9, "finish", 1)]


def test_leases_refuse_a_second_start_and_ignore_a_stale_finish(spark):
    rows = spark.createDataFrame([("p", *r) for r in REQUESTS], "project_id string, seq long, kind string, generation long")
    got = {r["seq"]: (r["generation"], r["granted"]) for r in runs.leases(rows).collect()}
    assert got == {1: (1, True), 2: (None, False), 3: (1, True), 4: (1, True), 5: (9, False), 6: (1, True), 7: (None, False), 8: (2, True), 9: (1, False)}


def test_lease_stream_equals_the_batch(spark, tmp_path):
    schema = "project_id string, seq long, kind string, generation long"
    for i, part in enumerate((REQUESTS[:4], REQUESTS[4:])):
        spark.createDataFrame([("p", *r) for r in part], schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = lifecycle.lease_stream(rows).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["seq"], r["generation"], r["granted"]) for r in spark.table("leases").collect()}
    batch = spark.createDataFrame([("p", *r) for r in REQUESTS], schema)
    assert got == {(r["seq"], r["generation"], r["granted"]) for r in runs.leases(batch).collect()}


def test_a_cancellation_waits_five_seconds(spark):
    log = [("a", 1, "start", None, 0), ("a", 2, "cancel", None, 100), ("a", 3, "finish", 1, 5_100), ("b", 1, "start", None, 0), ("b", 2, "cancel", None, 0), ("b", 3, "finish", 1, 5_001), ("c", 1, "start", None, 0), ("c", 2, "cancel", None, 0)]
    rows = spark.createDataFrame(log, "project_id string, seq long, kind string, generation long, at_ms long")
    got = {r["project_id"]: (r["waited_ms"], r["acknowledged"]) for r in runs.cancellations(rows).collect()}
    assert got == {"a": (5_000, True), "b": (5_001, False), "c": (None, False)}


def test_retry_blanks_only_what_failed(spark):
    log = [(1, "begin", "inspecting", 1, None), (2, "complete", "inspecting", 2, "ok"), (3, "begin", "transcribing", 3, None), (4, "fail", "transcribing", 4, "boom"), (5, "retry", None, 5, None)]
    rows = spark.createDataFrame([("p", *r) for r in log], "project_id string, seq long, kind string, stage string, at_ms long, detail string")
    before = runs.stage_records(rows.where("seq < 5")).first()
    assert (before["status"], before["error"]) == ("failed", "boom")
    after = runs.stage_records(rows).first()
    by = {s["name"]: s for s in after["stages"]}
    assert after["status"] == "created" and after["error"] is None and list(by) == X.STAGES
    assert by["inspecting"]["detail"] == "ok" and by["transcribing"]["error"] is None and by["transcribing"]["started_at"] is None


def test_upload_counts_all_files_and_takes_the_first_error(spark):
    schema = "request_id long, free_gb double, best_accent string, fields array<struct<name:string,value:string,file_name:string,chunks:array<bigint>>>"
    gib = 1 << 30
    rows = [
        (1, 3.0, None, [("file", None, "A.MP4", [gib, gib]), ("accent_color", "ff0000", None, None)]),
        (2, 3.0, None, [("file", None, "a.mp4", [gib, gib + 1])]),
        (3, None, None, [("file", None, "a.m4v", [1 << 40]), ("accent_mode", "OPTIMIZED ", None, None)]),
        (4, 3.0, None, [("accent_mode", "x", None, None), ("file", None, "a.mov", [1])]),
        (5, 3.0, None, []),
    ]
    got = {r["request_id"]: r for r in requests.uploads(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["error"] is None and got[1]["accent_color"] == "#ff0000" and got[1]["size"] == 2 * gib
    assert got[2]["error"] == requests.NO_SPACE and got[2]["size"] is None
    assert got[3]["error"] is None and got[3]["accent_color"] == "#FFDD00"
    assert got[4]["error"] == requests.BAD_MODE and got[5]["error"] == requests.NO_FILE


def test_colours_with_and_without_hash(spark):
    assert one(spark, X.hex_to_bgr(F.col("t")), t=" ffdd00 ") == "00DDFF"
    assert one(spark, X.hex_to_bgr(F.col("t")), t="ffdd0") == "FFFFFF"
    assert one(spark, requests.accent(F.col("t")), t="#ff00") is None


def test_temp_names_keep_the_last_ending(spark):
    assert one(spark, requests.temp_name(F.col("t"), F.lit(1)), t="a.b.mp4") == f".a.b.part-{one(spark, requests.short_id(F.col('k')), k=1)}.mp4"
    assert one(spark, requests.temp_name(F.col("t"), F.lit(1)), t="clip").startswith(".clip.part-")


def test_evidence_of_a_folder_without_view_and_of_no_json(spark):
    r = spark.createDataFrame([("a", json.dumps({"error": "x"})), ("b", "not json")], "folder string, json string")
    none = spark.createDataFrame([], "folder string, json string")
    got = {x["source_id"]: x for x in reviews.evidence(r, none, none).collect()}
    assert got["a"]["error"] == "x" and got["a"]["accepted"] == 0 and got["a"]["selector"] == "unknown" and got["b"]["status"] == "unknown"


def test_rubric_rows_are_numbered_as_in_the_file(spark, tmp_path):
    path = tmp_path / "rubric.csv"
    path.write_text("clip," + ",".join(evals.RUBRIC_SCORES) + ",decision_error\na,5,,,,,4,\nb,,,,,,,\nc,6,,,,,,\nd,x,,,,,,\n")
    rows = evals.rubric_rows(T.read_rubric(spark, str(path)))
    assert sorted(r["row"] for r in evals.invalid_rows(rows).collect()) == [4, 5]
    assert evals.review(rows).first()["would_post_count"] == 1


def test_first_found_takes_the_first_file(spark):
    wanted = spark.createDataFrame([("m", 0, "/a"), ("m", 1, "/b"), ("m", 2, "/c"), ("n", 0, "/z")], "name string, nth int, path string")
    files = spark.createDataFrame([("/c",), ("/b",)], "path string")
    assert {r["name"]: r["path"] for r in health.first_found(wanted, files).collect()} == {"m": "/b", "n": None}


def test_projects_and_frames_are_read_by_folder(spark, tmp_path):
    for p, n in (("p1", 2), ("p2", 1)):
        (tmp_path / p).mkdir()
        (tmp_path / p / "project.json").write_text(json.dumps({"status": p + "!"}))
        for i in range(n):
            (tmp_path / p / f"f{i}.jpg").write_bytes(b"x")
        (tmp_path / p / "notes.txt").write_text("x")
    rows = health.read_projects(spark, str(tmp_path), "project", "status string").collect()
    assert {(r["project_id"], r["status"]) for r in rows} == {("p1", "p1!"), ("p2", "p2!")}
    assert [r["path"].rsplit("/", 1)[1] for r in health.read_frames(spark, str(tmp_path / "p1")).orderBy("frame").collect()] == ["f0.jpg", "f1.jpg"]
