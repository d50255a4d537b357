"""Report writers: one-row totals and source rows as JSON, CSV and Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import table_cell

# The columns of the CSV report and of the Markdown tables.
CSV_FIELDS = [
    "run_id", "git_commit", "source_count", "completed_sources", "completion_rate", "failed_sources", "ready_clips", "failed_clips",
    "accepted_candidates", "rejected_candidates", "duplicate_rate", "clips_reviewed", "would_post_rate", "gate_status",
]
SOURCE_FIELDS = ["source_id", "category", "status", "ready_clips", "failed_clips", "rejected_candidates", "selector", "error"]


def _cell(df: DataFrame, name: str) -> Column:
    text = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return table_cell(text)


def csv_row(report: DataFrame) -> DataFrame:
    """The report's fixed columns as text, in order; what it lacks is empty."""
    return report.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in report.columns else F.lit("")).alias(c) for c in CSV_FIELDS])


def json_row(report: DataFrame) -> DataFrame:
    """(value): each row as JSON with sorted keys; nulls are written."""
    return report.select(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("value"))


def markdown_lines(report: DataFrame, sources: DataFrame) -> DataFrame:
    """(part, at, line): the Markdown report by lines. Totals come first, then one table row per source,
    by source_id; sort by part and at when writing. Source rows stay distributed."""
    totals = [c for c in report.columns if c not in ("run_id", "git_commit")]
    head = [F.concat(F.lit("# Evaluation — "), _cell(report, "run_id")), F.lit(""), F.concat(F.lit("- Commit: `"), _cell(report, "git_commit"), F.lit("`")), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---:|")]
    head += [F.concat(F.lit(f"| {c} | "), _cell(report, c), F.lit(" |")) for c in totals]
    head += [F.lit(""), F.lit("## Source results"), F.lit(""), F.lit(f"| {' | '.join(SOURCE_FIELDS)} |"), F.lit(f"|{'---|' * len(SOURCE_FIELDS)}")]
    top = report.select(F.posexplode(F.array(*head)).alias("n", "line")).select(F.lit(0).alias("part"), F.format_string("%04d", "n").alias("at"), "line")
    joined = reduce(lambda a, b: F.concat(a, F.lit(" | "), b), [_cell(sources, c) for c in SOURCE_FIELDS])
    rows = sources.select(F.lit(1).alias("part"), F.col("source_id").cast("string").alias("at"), F.concat(F.lit("| "), joined, F.lit(" |")).alias("line"))
    return top.unionByName(rows)


def write_report(report: DataFrame, sources: DataFrame, path: str) -> None:
    """Writes report.json, report.csv and report.md under ``path`` by Spark's committed writes."""
    json_row(report).coalesce(1).write.mode("overwrite").text(f"{path}/report.json")
    csv_row(report).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/report.csv")
    markdown_lines(report, sources).orderBy("part", "at").select("line").write.mode("overwrite").text(f"{path}/report.md")
