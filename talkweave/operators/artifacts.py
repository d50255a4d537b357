"""Which files of a run are proven complete, which go before a retry, and which runs were interrupted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in which nothing works on a project.
IDLE_STATES = ["created", "complete", "cancelled", "failed"]


def _stem(name: Column, suffix: str) -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix)))


def reconcile(files: DataFrame, clips: DataFrame) -> DataFrame:
    """(project_id, folder, name, action) for files (project_id, folder, name, size) and clips
    (project_id, clip_id, filename, status): ``keep``, ``keep_and_mark`` (complete, but its ready
    marker is missing) or ``delete``. Folders are ``root``, ``clips``, ``base`` and ``frames``; files
    of other folders are kept.

    A ready clip is proven by non-empty media and a marker that isn't empty; media older than markers
    count as marked. A base is proven by its own marker or, without one, by its clip. Null sizes count
    as empty. Only equi-joins on project and name; every row of ``files`` gives one row.
    """
    has = F.coalesce("size", F.lit(0)) > 0
    held = files.groupBy("project_id", "folder", "name").agg(F.max(has).alias("full"))
    markers = held.where(F.col("name").endswith(".ready")).select("project_id", "folder", _stem(F.col("name"), ".ready").alias("clip_id"), F.col("full").alias("marked"))
    media = held.where("folder = 'clips' and full").select("project_id", F.col("name").alias("filename"))
    proven = (
        clips.where("status = 'ready'").select("project_id", "clip_id", "filename").distinct().join(media, ["project_id", "filename"])
        .join(markers.where("folder = 'clips'").drop("folder"), ["project_id", "clip_id"], "left")
        .where("coalesce(marked, true)")
    )
    by_name = proven.groupBy("project_id", F.col("filename").alias("name")).agg(F.bool_or(F.col("marked").isNull()).alias("unmarked")).withColumn("folder", F.lit("clips"))
    ids = proven.select("project_id", "clip_id").distinct().withColumn("clip_ready", F.lit(True))
    bases = held.where("folder = 'base' and name like '%.mp4'").select("project_id", "folder", _stem(F.col("name"), ".mp4").alias("clip_id"), F.col("full").alias("base_full"))
    stem = F.coalesce(_stem(F.col("name"), ".ready"), _stem(F.col("name"), ".mp4"))
    rows = (
        files.withColumn("clip_id", stem)
        .join(by_name, ["project_id", "folder", "name"], "left")
        .join(ids, ["project_id", "clip_id"], "left")
        .join(markers, ["project_id", "folder", "clip_id"], "left")
        .join(bases, ["project_id", "folder", "clip_id"], "left")
    )
    name = F.col("name")
    part = name.contains(".part-")
    is_marker, is_media = name.endswith(".ready"), name.endswith(".mp4")
    base_ok = F.coalesce("base_full", F.lit(False)) & F.coalesce("marked", "clip_ready", F.lit(False))
    gone = (
        F.when(F.col("folder") == "frames", True)
        .when(F.col("folder") == "root", part | (name == "audio.wav") | name.startswith(".whisper-") | name.startswith("audio.whisper"))
        .when(F.col("folder") == "clips", part | name.endswith(".ass") | (is_media & F.col("unmarked").isNull()) | (is_marker & F.col("clip_ready").isNull()))
        .when(F.col("folder") == "base", part | ((is_media | is_marker) & ~base_ok))
        .otherwise(False)
    )
    mark = F.when(F.col("folder") == "clips", F.coalesce("unmarked", F.lit(False))).when(F.col("folder") == "base", is_media & base_ok & F.col("marked").isNull()).otherwise(False)
    return rows.select("project_id", "folder", "name", F.when(gone, "delete").when(mark, "keep_and_mark").otherwise("keep").alias("action"))


def interrupted(projects: DataFrame, running: DataFrame) -> DataFrame:
    """``projects`` (project_id, status, ...) with ``status`` failed where it is active but no run holds it."""
    held = running.select("project_id").distinct().withColumn("_held", F.lit(True))
    lost = ~F.col("status").isin(IDLE_STATES) & F.col("_held").isNull()
    return projects.join(held, "project_id", "left").withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).drop("_held")
