"""What several operators of this subpackage share: shared-folder tables, names and components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` if it is set.

    Only where the session names none and runs on one machine (tests) a temporary folder is set
    instead; on a cluster that is an error, as executors could not read what the driver wrote there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc()
        held = jsc.getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="talkweave-checkpoints-"))
            held = jsc.getCheckpointDir()
        named = held.get()
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder while an operator works; gone when the block ends.

    A table cuts the lineage: a lost executor costs no more than the tasks that read or write it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/talkweave/{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        delete(self.spark, self.base)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        delete(self.spark, table._scratch_path)

    def keep(self, df: DataFrame) -> DataFrame:
        """The operator's result, checkpointed so that it outlives the tables of this block.

        Its files are the one thing left behind: they are read when the caller uses the result, and
        ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes them once it is let go.
        """
        shared_dir(self.spark)
        return df.checkpoint(eager=True)


def spare_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = "_" + wish
    return wish


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): (node, component), component the smallest node reached.

    Alternating large-star and small-star steps: each step keeps the components, needs only
    grouped minima (combined before the shuffle) and joins on the node, and a logarithmic number of
    steps ends in stars. Links of a hub are never gathered into one row.
    """
    links = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    first = links
    before = None
    while True:
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(small_low, "u")
        after = scratch.save(
            pointed.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "stars",
        )
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if links is not first:
            scratch.drop(links)
        links = after
        if state == before:
            break
        before = state
    return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
