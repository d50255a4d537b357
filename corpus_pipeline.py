"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

1. ``toxicity`` drops documents that score as toxic.
2. ``exact_dedup`` keeps one of each group of equal texts.
3. ``minhash_dedup`` keeps one of each component of near copies.
4. ``mix_sources`` repeats and leaves out documents so that sources meet their target weights.
5. ``sentencepiece`` encodes what is left and decodes the ids; rows are (doc_id, source, n_tokens,
   ids_sha256, ids, decoded_sha256), ids as little-endian uint32 bytes, begin and end included.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import sentencepiece_codec
from talkweave.llm._shared import delete, shared_dir
from talkweave.llm.exact_dedup import drop_exact_copies
from talkweave.llm.minhash_dedup import drop_near_copies
from talkweave.llm.mixing import mixed_documents
from talkweave.llm.toxicity import drop_toxic

TOKENIZER = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic. Null and empty texts have no evidence and stay; rows of equal
    texts stay or go together; a very long text is scored whole; an empty table stays empty."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of equal texts, null and empty texts being one group. Rows
    that repeat that id and text all stay, as do rows without an id that equal no row with one."""
    return drop_exact_copies(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of near copies. Rows without words or without an id
    are near nothing and stay."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in the order of its shards. A source without words is left out;
    a null source is a source; rows that repeat an id share a verdict."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every row: the library's ids of the whole text (null: empty) and digests of them and of
    what they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    ids = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), path).drop("text")
    return sentencepiece_codec.decode(ids, path).select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The toxicity model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written to the shared folder and read again.

    A stage's table goes when the next one is written; the last one stays, as the result reads it.
    """
    base = f"{shared_dir(spark)}/talkweave/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
