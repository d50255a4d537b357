"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fold_sql(rows: str, hit: str, cap: str = "true", name: str = "g") -> str:
    """Recursive greedy fold over (doc_id, rn, ord, start_ms, end_ms): the rows that are kept."""
    return f"""{name} AS (
  WITH RECURSIVE r AS (
    SELECT doc_id, 0 AS rn, CAST([] AS STRUCT(ord INT, a BIGINT, b BIGINT)[]) AS kept FROM (SELECT DISTINCT doc_id FROM {rows})
    UNION ALL
    SELECT r.doc_id, x.rn, CASE WHEN ({cap}) AND len(list_filter(kept, lambda k: {hit})) = 0
      THEN list_append(kept, {{'ord': x.ord, 'a': x.start_ms, 'b': x.end_ms}}) ELSE kept END
    FROM r JOIN {rows} x ON x.doc_id = r.doc_id AND x.rn = r.rn + 1)
  SELECT doc_id, unnest(kept).ord AS ord, generate_subscripts(kept, 1) AS place FROM (SELECT doc_id, arg_max(kept, rn) AS kept FROM r GROUP BY 1))"""
