"""License scans: an exact set-similarity join of text blocks with license templates.

Tokens of all templates are put in order of their frequency over the whole corpus, rarest first. A
block that shares ``need`` of a template's ``n`` distinct tokens shares one of the template's first
``n - need + 1``; these prefixes are the join's keys. Length and position bounds then drop blocks
that cannot reach ``need``, and the rest is counted in full.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch

# Base phrases by label.
BASE_PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}
# Short notices of public licenses, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under creative commons attribution sharealike",
    "copyright-notice": "this work is protected by copyright law and may not be reproduced without permission",
    "gpl-notice": "this work is licensed under the gnu general public license version",
    "mit": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "public-domain": "dedicated to the public domain under cc0",
}
THRESHOLD = (4, 5)  # share of a template's tokens that a block must hold
BLOCK_WORDS = 24
INSERTED = 3  # words that a passage may have between a template's
# the longest template, so many words longer, lies whole in some block wherever it begins
STRIDE = BLOCK_WORDS - max(len(t.split()) for t in TEMPLATES.values()) - INSERTED + 1

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are put in lower case


def _known_words(text: Column, vocabulary: Sequence[str]) -> tuple[Column, Column]:
    """How many words the text has, and those of the vocabulary as an array of (at, word).

    Only A-Z are put in lower case: a word whose bytes change otherwise isn't in the vocabulary.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.lower(w).alias("word"), F.octet_length(w).alias("bytes")))
    known = F.filter(placed, lambda x: x["word"].isin(*vocabulary) & (F.octet_length(x["word"]) == x["bytes"]))
    return F.size(words).cast("long"), F.transform(known, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word")))


def _phrase_hits(known: Column, phrases: Mapping[str, str]) -> Column:
    """All places where a phrase's words stand one after the other, as an array of (label, start)."""

    def places(label: str, first: str, *rest: str) -> Column:
        def here(x: Column, i: Column) -> Column:
            fits = x["word"] == first
            for k, word in enumerate(rest, 1):
                then = F.get(known, i + k)
                fits = fits & (then["word"] == word) & (then["at"] == x["at"] + k)
            return F.coalesce(fits, F.lit(False))

        return F.transform(
            F.filter(known, here), lambda x: F.struct(F.lit(label).alias("label"), x["at"].cast("long").alias("start"))
        )

    return F.concat(*[places(label, *phrase.split()) for label, phrase in phrases.items()])


def need(size: int, share: tuple[int, int]) -> int:
    """The fewest words of ``size`` that make up the share."""
    return max(1, -(-size * share[0] // share[1]))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = BASE_PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    share: tuple[int, int] = THRESHOLD,
    block_words: int = BLOCK_WORDS,
    stride: int = STRIDE,
) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, phrase_hits, template_hits).

    ``phrase_hits``: array of (label, start) for every place where a phrase's words stand in
    succession. ``template_hits``: array of (label, block_start, shared, size), one for each block and
    template that has at least the ``share`` of the template's distinct words (null without hits). A
    text's blocks are ``block_words`` words from every ``stride``-th word on, so a passage of
    ``block_words - stride`` words lies whole in some block.

    One pass over the texts keeps the words that templates or phrases have; words that none has can't
    be shared, so dropping them changes no overlap. Corpus frequencies of these words (no more rows
    than the vocabulary has) give the order. Blocks are joined to templates on the template prefixes,
    filtered by length and position, and counted. Blocks never meet each other, and equal texts
    share their blocks.

    Defined results: null and empty texts have no words and no hits; a text shorter than a block is
    one block; a very long one is read whole, and costs a row for each of its words that a template
    has; null ids and repeated rows stay as they are; a block that meets several templates, or one
    several times over, has a hit for each; other columns, whatever their names, are neither read nor
    returned; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    vocabulary = sorted({w for s in sets.values() for w in s} | {w for p in phrases.values() for w in p.split()})
    n_words, known = _known_words(F.col(text_col), vocabulary)
    with Scratch(spark) as scratch:
        rows = scratch.save(
            docs.select(
                F.col(id_col).alias("id"),
                F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("text_key"),
                n_words.alias("n_words"),
                known.alias("known"),
            ).withColumn("phrase_hits", _phrase_hits(F.col("known"), phrases)),
            "rows",
        )
        # at most one row for each word of the vocabulary
        seen = rows.select(F.explode("known.word").alias("word")).groupBy("word").count()
        often = {r["word"]: r["count"] for r in seen.collect()}
        rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
        ranked = {label: sorted(rank[w] for w in s) for label, s in sets.items()}
        ranks = spark.createDataFrame(list(rank.items()), "word string, rank int")
        prefixes = spark.createDataFrame(
            [
                (r, label, i, len(s), need(len(s), share))
                for label, s in ranked.items()
                for i, r in enumerate(s[: len(s) - need(len(s), share) + 1])
            ],
            "rank int, label string, i int, n int, need int",
        )
        whole = spark.createDataFrame([(label, s) for label, s in ranked.items()], "label string, template array<int>")
        keys = sorted({r for s in ranked.values() for r in s[: len(s) - need(len(s), share) + 1]})
        rare = {w for w, r in rank.items() if r in set(keys)}

        last_block = F.greatest(F.lit(0), F.expr(f"cast(ceil((n_words - {block_words}) / {stride}D) as int)"))
        at = F.col("x.at")
        holding = F.sequence(
            F.greatest(F.lit(0), F.expr(f"cast(ceil((x.at - {block_words - 1}) / {stride}D) as int)")),
            F.least(F.col("last_block"), F.floor(at / stride).cast("int")),
        )
        blocks = (
            rows.where(F.exists("known", lambda x: x["word"].isin(*rare)) if rare else F.lit(False))
            .select("text_key", last_block.alias("last_block"), F.explode("known").alias("x"))
            .select("text_key", F.explode(holding).alias("block"), F.col("x.word").alias("word"))
            .join(ranks, "word")
            .groupBy("text_key", "block")
            .agg(F.array_sort(F.collect_set("rank")).alias("held"))
        )
        near = (
            blocks.select("text_key", "block", "held", F.posexplode("held").alias("j", "rank"))
            .join(prefixes, "rank")
            .withColumn("size", F.size("held"))
            .where("size >= need and j <= size - need")  # length; place in the block
            .groupBy("text_key", "block", "label", "n", "need", "held")
            .agg(F.min(F.struct("i", "j")).alias("first"))
            .where("1 + least(n - first.i - 1, size(held) - first.j - 1) >= need")
        )
        hits = (
            near.join(whole, "label")
            .withColumn("shared", F.size(F.array_intersect("held", "template")))
            .where("shared >= need")
            .groupBy(F.col("text_key").alias("hit_key"))
            .agg(
                F.array_sort(
                    F.collect_set(
                        F.struct("label", (F.col("block") * stride).cast("long").alias("block_start"), "shared", F.col("n").alias("size"))
                    )
                ).alias("template_hits")
            )
        )
        hits = scratch.save(hits, "hits")
        return scratch.keep(
            rows.join(hits, F.col("text_key") == F.col("hit_key"), "left").select(
                F.col("id").alias(id_col), "n_words", "phrase_hits", "template_hits"
            )
        )
