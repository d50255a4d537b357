"""Review of results: decisions of viewers, and the evidence that a run leaves of each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.operators.evals import rejection_is_duplicate

DECISIONS = ["keep", "maybe", "skip"]


def tallies(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, keep, maybe, skip): decisions (project_id, item, decision) of the items (project_id, item,
    nth) now listed. Other items' decisions and unknown words count nowhere."""
    made = decisions.groupBy("project_id", "item").agg(F.max("decision").alias("decision"))
    rows = items.select("project_id", "item").distinct().join(made, ["project_id", "item"], "left")
    return rows.groupBy("project_id").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS])


def next_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project_id, item): the first item without a decision, else the first one."""
    made = decisions.where("coalesce(decision, '') <> ''").select("project_id", "item").distinct().withColumn("made", F.lit(True))
    rows = items.join(made, ["project_id", "item"], "left")
    order = F.struct(F.coalesce("made", F.lit(False)).alias("made"), F.col("nth"))
    return rows.groupBy("project_id").agg(F.min_by("item", order).alias("item"))


def _at(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def _kind(doc: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(doc, path, "variant")), F.lit("VOID"))


def _count(doc: Column, path: str, otherwise: Column) -> Column:
    """A number as it stands, but no less than 0; a list by its length; else ``otherwise``."""
    kind = _kind(doc, path)
    return (
        F.when(kind.isin("BIGINT", "BOOLEAN"), F.greatest(_at(doc, path, "bigint"), F.lit(0).cast("long")))
        .when(kind.startswith("ARRAY"), F.size(_at(doc, path, "array<variant>")).cast("long"))
        .otherwise(otherwise)
    )


def _list(doc: Column, path: str) -> Column:
    return F.coalesce(_at(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def _said(entry: Column) -> Column:
    """What one rejection says: a text itself, or the texts and lists among an object's fields."""
    kind = F.schema_of_variant(entry)

    def texts(name: str) -> Column:
        own = F.schema_of_variant(F.try_variant_get(entry, f"$.{name}", "variant"))
        one = F.array(F.try_variant_get(entry, f"$.{name}", "string"))
        return F.when(own == "STRING", one).when(own.startswith("ARRAY"), F.try_variant_get(entry, f"$.{name}", "array<string>"))

    fields = F.concat(*[F.coalesce(texts(n), F.array().cast("array<string>")) for n in ("reason", "reasons", "rule", "message", "detail")])
    return F.when(kind.startswith("OBJECT"), F.array_join(fields, " ")).otherwise(F.coalesce(F.try_variant_get(entry, "$", "string"), F.lit("")))


def evidence(results: DataFrame, views: DataFrame, selections: DataFrame) -> DataFrame:
    """A source row for every row of ``results``, each table being (folder, json): (source_id, category, status,
    ready_clips, failed_clips, accepted, rejected, duplicate_rejections, selector, duration_seconds, error).

    What was accepted and rejected is read from the selection, or from the view where there is no
    selection or an empty one; both may be a number or a list. A document that is no JSON counts as absent.
    """
    one = lambda df, name: df.groupBy("folder").agg(F.max("json").alias(name))
    rows = results.join(one(views, "view"), "folder", "left").join(one(selections, "selection"), "folder", "left")
    r, v, s = (F.try_parse_json(F.col(c)) for c in ("json", "view", "selection"))
    full = F.coalesce(~F.schema_of_variant(s).isin("OBJECT<>", "VOID"), F.lit(False))
    rows = rows.select("folder", r.alias("r"), v.alias("v"), s.alias("s"), F.when(full, s).otherwise(v).alias("e"))
    r, v, s, e = (F.col(c) for c in "rvse")

    def clips(wanted: str) -> Column:
        hit = F.filter(_list(v, "$.clips"), lambda c: F.coalesce(F.try_variant_get(c, "$.status", "string") == wanted, F.lit(False)))
        return F.size(hit).cast("long")

    rejects = F.when(_kind(e, "$.rejected").startswith("ARRAY"), _list(e, "$.rejected")).otherwise(_list(e, "$.selection_report.rejected"))
    doubled = F.size(F.filter(F.transform(rejects, _said), lambda t: rejection_is_duplicate(F.array(t)))).cast("long")
    text = lambda d, path: F.nullif(_at(d, path, "string"), F.lit(""))
    return rows.select(
        F.coalesce(text(r, "$.source_id"), "folder").alias("source_id"),
        F.coalesce(text(r, "$.category"), F.lit("unspecified")).alias("category"),
        F.coalesce(text(r, "$.status"), text(v, "$.project.status"), F.lit("unknown")).alias("status"),
        clips("ready").alias("ready_clips"),
        clips("failed").alias("failed_clips"),
        _count(e, "$.accepted", F.size(_list(e, "$.clips")).cast("long")).alias("accepted"),
        _count(e, "$.rejected", F.size(rejects).cast("long")).alias("rejected"),
        doubled.alias("duplicate_rejections"),
        F.coalesce(text(s, "$.selector"), text(v, "$.selector"), F.lit("unknown")).alias("selector"),
        F.when(_kind(r, "$.duration_seconds").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _at(r, "$.duration_seconds", "double")).alias("duration_seconds"),
        _at(r, "$.error", "string").alias("error"),
    )


def manifest_errors(sources: DataFrame) -> DataFrame:
    """(nth, error) of a manifest's sources (nth, id, path) that can't be run: ids of other letters or too
    long, ids that stood before, and empty paths; each source has its first error only."""
    from pyspark.sql import Window

    bad = ~F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$"), F.lit(False))
    again = F.row_number().over(Window.partitionBy("id").orderBy("nth")) > 1
    error = (
        F.when(bad, F.concat(F.lit("invalid source id: "), F.coalesce("id", F.lit("null"))))
        .when(again, F.concat(F.lit("duplicate source id: "), F.col("id")))
        .when(F.coalesce("path", F.lit("")) == "", F.concat(F.lit("missing path for "), F.col("id")))
    )
    return sources.select("nth", error.alias("error")).where("error is not null")
