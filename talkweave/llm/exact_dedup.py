"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch

# One run of ASCII white space counts as one space. Single spaces are left alone, so that the
# pattern matches only where something changes.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text whose bytes are compared: null is empty, each run of ASCII white space one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def content_hash(norm: Column) -> Column:
    """SHA-256 as 32 bytes; its first 16 bytes are the 128-bit group key."""
    return F.unhex(F.sha2(norm, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 16) -> DataFrame:
    """One row per row of ``docs``: (id, content_sha256 binary, keep_id, group_size, kept).

    Rows are grouped by the first ``key_bytes`` bytes of the content hash: a count and a smallest id
    for each key, combined before the shuffle, so that a hot text costs one row for each task. Texts
    of groups with more than one row are then compared, byte by byte, with the text of the group's
    smallest id; rows that differ (hash collisions) form groups of their own by the text itself.

    Defined results: null texts are empty texts; very long texts are hashed and compared whole; a null
    id never beats another id, and a group of null ids only keeps all its rows (keep_id null); rows
    that repeat id and text are the same document, tie for the smallest id and share one verdict;
    other columns, whatever their names, are neither read nor
    returned; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    key = F.substring(F.col("sha"), 1, key_bytes)
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.save(rows.select("id", content_hash(F.col("norm")).alias("sha")), "prints")
        groups = scratch.save(
            prints.groupBy(key.alias("key")).agg(F.min("id").alias("keep"), F.count("*").alias("n")).where("n > 1"),
            "groups",
        )
        # texts of repeated keys only; the row that a group is compared with is one row for each key
        members = scratch.save(
            rows.withColumn("key", F.substring(content_hash(F.col("norm")), 1, key_bytes))
            .join(groups.select("key", "keep").hint("merge"), "key"),  # the same plan at every size
            "members",
        )
        leaders = scratch.save(
            members.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy("key").agg(F.min("norm").alias("led")),
            "leaders",
        )
        strays = scratch.save(
            members.join(leaders, "key").where("norm <> led").select("key", "id", "norm"), "strays"
        )
        marked = prints.withColumn("key", key).join(groups, "key", "left")
        keep, n = F.coalesce("keep", "id"), F.coalesce("n", F.lit(1).cast("long"))
        if not strays.isEmpty():
            own = strays.groupBy("key", "norm").agg(F.min("id").alias("own_keep"), F.count("*").alias("own_n"))
            own = strays.join(own, ["key", "norm"]).select(
                F.col("key"), F.col("id").alias("stray_id"), content_hash(F.col("norm")).alias("stray_sha"), "own_keep", "own_n"
            ).distinct()
            gone = strays.groupBy("key").agg(F.count("*").alias("gone"))
            marked = marked.join(gone, "key", "left").join(
                own.withColumnRenamed("key", "stray_key"),
                F.col("id").eqNullSafe(F.col("stray_id")) & (F.col("key") == F.col("stray_key")) & (F.col("sha") == F.col("stray_sha")),
                "left",
            )
            keep = F.when(F.col("own_n").isNotNull(), F.coalesce("own_keep", "id")).otherwise(keep)
            n = F.coalesce(F.col("own_n"), n - F.coalesce("gone", F.lit(0)))
        return scratch.keep(
            marked.select("id", F.col("sha").alias("content_sha256"), keep.alias("keep_id"), n.alias("group_size"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
            .withColumnRenamed("id", id_col)
        )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Defined results: those of ``exact_dedup``; rows that repeat id and text are all kept or all
    dropped; rows kept hold nulls and all columns, whatever their names; an empty table gives no rows.
    """
    kept = (
        exact_dedup(docs, id_col, text_col)
        .where("kept")
        .select(F.col(id_col).alias("kept_id"), F.col("content_sha256").alias("kept_sha"))
        .distinct()
    )
    d = docs.alias("d")
    return d.join(
        kept.alias("k"),
        F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.kept_id"))
        & (content_hash(normalised(F.col(f"d.`{text_col}`"))) == F.col("k.kept_sha")),
        "left_semi",
    )
