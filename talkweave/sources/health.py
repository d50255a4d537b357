"""What tools and folders say of themselves: disk space, filters, error lines, frames, projects and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lines of errors that are kept, least size of a rendered file, and how sure and large a face is.
TAIL_LINES, LEAST_BYTES, FACE_SCORE, FACE_SIZE = 8, 10_000, 2.0, 24
# Where in a video its colours are sampled.
SAMPLED_AT = [0.1, 0.35, 0.65, 0.9]
PROJECT_FILES = ["project", "transcript", "raw-candidates", "selection", "manifest", "energy"]


def _fields(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")


def free_gb(output: Column) -> Column:
    """Free GiB by a portable disk listing in KiB: the fourth field of its second line; null without it."""
    line = F.try_element_at(F.split(output, "\n"), F.lit(2))
    return F.try_element_at(_fields(line), F.lit(4)).try_cast("double") / 1024 / 1024


def filter_listed(output: Column, name: str) -> Column:
    """Whether a listing of filters has one of that name as a line's second field."""
    return F.exists(F.split(output, "\n"), lambda line: F.coalesce(F.try_element_at(_fields(line), F.lit(2)) == name, F.lit(False)))


def setup_status(checks: DataFrame) -> DataFrame:
    """(machine, ...) whether a machine can work: from (machine, encoder_code, filters, probe_code, recogniser,
    model, model_bytes, face_model, disk), codes being exit codes and null where a tool is missing."""
    return checks.select(
        "machine",
        F.coalesce(F.col("encoder_code") == 0, F.lit(False)).alias("encoder_ok"),
        F.coalesce(filter_listed(F.col("filters"), "ass"), F.lit(False)).alias("subtitles_ok"),
        F.coalesce(F.col("probe_code") == 0, F.lit(False)).alias("probe_ok"),
        F.col("recogniser").isNotNull().alias("recogniser_ok"),
        F.col("model").isNotNull().alias("model_ok"),
        F.when(F.col("model").isNotNull(), F.expr("model_bytes div 1000000")).alias("model_mb"),
        F.col("face_model").isNotNull().alias("face_model_ok"),
        free_gb(F.col("disk")).alias("disk_free_gb"),
    )


def error_tails(lines: DataFrame, key: str = "process") -> DataFrame:
    """(key, tail): the last 8 error lines of each process that aren't blank, from (key, seq, is_err, line)."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    last = lines.where("is_err and trim(line) <> ''").withColumn("_back", back).where(F.col("_back") <= TAIL_LINES)
    tail = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return last.groupBy(key).agg(F.array_join(F.transform(tail, lambda x: x["line"]), "\n").alias("tail"))


def first_found(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): of each setting's paths (name, nth, path) the first that is a file (path); null without one."""
    there = files.select("path").distinct().withColumn("_there", F.lit(True))
    rows = wanted.join(there, "path", "left")
    return rows.groupBy("name").agg(F.min_by(F.when(F.col("_there"), F.col("path")), F.when(F.col("_there"), F.col("nth"))).alias("path"))


def rendered(files: DataFrame) -> DataFrame:
    """Files (..., size) that are more than a header."""
    return files.where(F.col("size") >= LEAST_BYTES)


def faces(detections: DataFrame) -> DataFrame:
    """Detections (..., score, size) that are sure and large enough."""
    return detections.where((F.col("score") > FACE_SCORE) & (F.col("size") >= FACE_SIZE))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame, path): the sampled frames of a folder, by name; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path")
    return files.select((F.row_number().over(Window.orderBy("path")) - 1).alias("frame"), "path")


def read_projects(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One kind of document (``PROJECT_FILES``) of all projects under ``root``, with their project_id; what is
    no JSON gives nulls."""
    if name not in PROJECT_FILES:
        raise ValueError(f"no such document: {name}")
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}.json")
    return rows.withColumn("project_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def pixels(raw: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, r, g, b): every whole triple of bytes of ``data``."""

    def byte(i: Column, k: int) -> Column:
        return F.conv(F.hex(F.substring(F.col(data), i * 3 + k + 1, F.lit(1))), 16, 10).cast("int")

    n = F.floor(F.octet_length(data) / 3).cast("int")
    rows = raw.where(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(key, *[byte(F.col("_i"), k).alias(c) for k, c in enumerate("rgb")])
