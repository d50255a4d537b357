"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch

# The rules (verdict, host, path) that every run of the query applies.
BASE_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
PREFIX_HEX = 8  # digits of the SHA-256 digest in the join key: 32 bits
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _lower(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with the digest of their expression.

    Hosts are taken in lower case (A-Z); rules with a null in any column are left out; where several
    have one expression, the first in a list holds, and of a table's, whose rows have no order, ``allow``.
    """
    if not isinstance(rules, DataFrame):
        first: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            first.setdefault((host.translate(_LOWER), path), verdict)
        rules = spark.createDataFrame([(v, h, p) for (h, p), v in first.items()], "verdict string, host string, path string")
    rows = rules.where("verdict is not null and host is not null and path is not null")
    return (
        rows.groupBy(_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.min("verdict").alias("rule_verdict"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = tuple(BASE_RULES),
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_hex: int = PREFIX_HEX,
) -> DataFrame:
    """One row per row of ``pages``: (id, host, path, rule, verdict).

    ``rules`` is a short list or, for a list of any length, a table (verdict, host, path). A verdict
    depends on host and path alone. Each distinct (host, path) becomes one expression for each host
    suffix that starts at a label and each path prefix that ends at a slash, as far as the rules go:
    no more labels than the longest rule host has, no more slashes than the rule path with most, so a
    url of any length gives a bounded number of expressions. Where rule paths end elsewhere than at
    a slash, prefixes of their lengths are tried as well; the driver holds those two limits and these
    lengths (distinct ones, so no more than the longest such path has characters). The expressions are
    joined to the rules on the first ``prefix_hex`` digits of their digests, full digests and the
    expressions themselves are then compared, and of the rules that fit, the longest (host and path
    together; then the longer host; then by code point) holds. Spark broadcasts the rules while they
    are below its size threshold and shuffles beyond.

    Defined results: null urls and urls without ``://`` have empty host and path, no rule and the
    default verdict, and are spread by id and never meet the rules; a very long url is read whole; null
    ids and repeated rows stay as they are; other columns, whatever their names, are neither read nor
    returned; an empty table gives no rows; without rules all is default.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        table = scratch.save(rule_table(spark, rules).withColumn("prefix", F.substring("digest", 1, prefix_hex)), "rules")
        slashes = F.char_length("rule_path") - F.char_length(F.replace("rule_path", F.lit("/"), F.lit("")))
        limits = table.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(slashes).alias("slashes")).first()
        odd = table.where(~F.col("rule_path").endswith("/")).select(F.char_length("rule_path").alias("n")).distinct().collect()

        p = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
        p = scratch.save(p, "pages")
        parts = F.split("host", r"\.")
        hosts = F.transform(
            F.sequence(F.lit(1), F.least(F.size(parts), F.lit(limits["labels"] or 1))), lambda k: F.array_join(F.slice(parts, -k, k), ".")
        )
        steps = F.split("path", "/")
        deep = F.least(F.size(steps) - 1, F.lit(limits["slashes"] or 0))
        paths = F.transform(
            F.filter(F.sequence(F.lit(0), deep), lambda k: k > 0), lambda k: F.concat(F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/"))
        )
        if odd:
            lengths = F.filter(F.array(*[F.lit(n) for n in sorted(r["n"] for r in odd)]), lambda n: n <= F.char_length("path"))
            paths = F.array_union(paths, F.transform(lengths, lambda n: F.col("path").substr(F.lit(1), n)))
        tried = (
            p.where("host <> ''")
            .select("host", "path")
            .distinct()
            .select("host", "path", F.explode(hosts).alias("expr_host"), paths.alias("paths"))
            .select("host", "path", "expr_host", F.explode("paths").alias("expr_path"))
            .withColumn("expr_digest", F.sha2(F.concat_ws("\n", "expr_host", "expr_path"), 256))
            .withColumn("prefix", F.substring("expr_digest", 1, prefix_hex))
        )
        fit = tried.join(table, "prefix").where("expr_digest = digest and expr_host = rule_host and expr_path = rule_path")
        longest = F.struct(F.char_length(F.concat("rule_host", "rule_path")), F.char_length("rule_host"), "rule_host", "rule_path")
        said = F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
        best = fit.groupBy("host", "path").agg(F.max_by(said, longest).alias("best"))
        # rows without a host have no rule; a salt that no rule has keeps them from meeting in one task
        best = scratch.save(
            best.select(F.col("host").alias("best_host"), F.col("path").alias("best_path"), F.lit(0).cast("long").alias("best_salt"), "best"), "best"
        )
        salt = F.when(F.col("host") == "", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 20)) + 1).otherwise(0).cast("long")
        same = (F.col("host") == F.col("best_host")) & (F.col("path") == F.col("best_path")) & (F.col("salt") == F.col("best_salt"))
        return scratch.keep(
            p.withColumn("salt", salt)
            .join(best.hint("merge"), same, "left")  # as many rows as distinct pages that a rule fits: never broadcast
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
        )
