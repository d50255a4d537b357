"""The queries of this subpackage, ``opN_name`` for each operator, and SQL for those that SQL can say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import license_scan, mixing, sentencepiece_codec, toxicity
from talkweave.llm.chat_format import format_chats, read_back
from talkweave.llm.embedding_dedup import near_vectors
from talkweave.llm.exact_dedup import exact_dedup
from talkweave.llm.minhash_dedup import near_dedup
from talkweave.llm.sharding import assign_shards
from talkweave.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("phrase_hits.label")))
    own = F.coalesce(F.col("template_hits.label"), F.array().cast("array<string>"))
    starts = F.col("phrase_hits.start")
    best = F.array_max(F.transform("template_hits", lambda h: h["shared"].cast("double") / h["size"].cast("double")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrase_hits").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("phrase_hits") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    path = public_tokenizers.path(model)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = sentencepiece_codec.encode(docs, path).select("doc_id", "ids")
    return sentencepiece_codec.decode(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(turns.union(probe)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("content_sha256")).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("shards")).alias("taken"),
        F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"),
        F.array_join(F.col("places").cast("array<string>"), ",").alias("places"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_sentencepiece,
        op3_chat_format,
        op4_embedding_near_dedup,
        op5_exact_dedup,
        op6_toxicity,
        op7_shard,
        op8_mix_sources,
        op9_url_filter,
        op10_minhash_near_dedup,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op1_sql() -> str:
    templates = ", ".join(
        f"('{label}', string_split('{t}', ' '))" for label, t in license_scan.TEMPLATES.items()
    )
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for label, p in license_scan.BASE_PHRASES.items())
    num, den = license_scan.THRESHOLD
    width, stride = license_scan.BLOCK_WORDS, license_scan.STRIDE
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) v(label, words)),
t AS (SELECT label, list_distinct(words) AS words FROM (VALUES {templates}) v(label, words)),
ph AS (
  SELECT doc_id, label, i - 1 AS start
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p
  WHERE w[i] = words[1] AND w[i:i + len(words) - 1] = words),
bl AS (
  SELECT doc_id, list_distinct(w[b * {stride} + 1:b * {stride} + {width}]) AS held
  FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, cast(ceil((len(w) - {width}) / {stride}.0) AS BIGINT)))) AS b FROM d)),
th AS (
  SELECT doc_id, label, max(cast(len(list_intersect(held, words)) AS DOUBLE) / cast(len(words) AS DOUBLE)) AS share
  FROM bl, t WHERE len(list_intersect(held, words)) * {den} >= {num} * len(words) GROUP BY 1, 2),
pa AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ph GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT doc_id, label FROM ph UNION ALL SELECT doc_id, label FROM th) GROUP BY 1),
ts AS (SELECT doc_id, max(share) AS share FROM th GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_base, 0) AS BIGINT) AS n_base,
       cast(first_word AS BIGINT) AS first_word, cast(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN cast(1.0 AS DOUBLE) ELSE coalesce(share, cast(0.0 AS DOUBLE)) END AS score
FROM d LEFT JOIN pa USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN ts USING (doc_id)
"""


_OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, row_number() OVER o AS seq, coalesce(lag(role) OVER o, '') AS before,
         replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'),
           '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'),
           '<s>', '<\\s>'), '</s>', '<\\/s>'), '<role>', '<\\role>'), '</role>', '<\\/role>'), '</turn>', '<\\/turn>') AS safe
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
       cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY seq), '')) AS loss_sha256,
       cast(sum(length(safe) + CASE role WHEN 'system' THEN 7 + 9 WHEN 'user' THEN 6 + 8 WHEN 'assistant' THEN 3 + 5
                                         ELSE 6 + length(role) + 7 + 8 END) AS BIGINT) AS formatted_chars,
       true AS well_formed,
       bool_and(CASE WHEN seq = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user'
                     ELSE false END) AS in_order
FROM s GROUP BY conv_id
"""

_OP5_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

# The tree is drawn here from the distribution's closed form, not by the recurrence that mixing.py uses.
_OP8_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         cast('0x' || substr(md5('mix:0:' || coalesce(cast(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
f AS (
  SELECT *, rank % 3 + 1 AS weight, source_size * 3 AS cap, cast(sum(source_size) OVER () AS BIGINT) AS total FROM s),
p AS (
  SELECT *, cast(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_caps,
         cast(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM f),
l AS (
  SELECT *, cast(total - full_caps AS DOUBLE) / cast(open_weight AS DOUBLE) AS level,
         cast(cap AS DOUBLE) <= cast(weight AS DOUBLE) * (cast(total - full_caps AS DOUBLE) / cast(open_weight AS DOUBLE)) AS stopped
  FROM p),
t AS (
  SELECT source, source_size, rank,
         CASE WHEN stopped THEN cast(cap AS DOUBLE)
              ELSE cast(weight AS DOUBLE) * (SELECT arg_min(level, place) FROM l WHERE NOT stopped) END AS target
  FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.*, source_size, rank, target, passes, target - cast(passes * source_size AS DOUBLE) AS rest,
         cast(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS reached
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS MATERIALIZED (
  SELECT *, max(CASE WHEN reached <= rest THEN h ELSE -1 END) OVER (PARTITION BY source) AS cut,
         min(CASE WHEN reached > rest THEN h END) OVER (PARTITION BY source) AS past,
         rest - max(CASE WHEN reached <= rest THEN reached ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM c),
x AS (
  SELECT rank, arg_min(h, (abs(gap - size), h)) AS extra FROM g WHERE h > cut AND abs(gap - size) < gap GROUP BY rank),
q AS MATERIALIZED (
  SELECT rank, CASE WHEN any_value(source_size) = 0 THEN 0 ELSE any_value(passes) * 4096 END + coalesce(any_value(past) // 281474976710656 + 1, 0) AS draws
  FROM g GROUP BY rank),
tree(shard, width, q, i, population, drawn, l) AS (
  SELECT 0, 16, list(draws ORDER BY rank), 0, cast(sum(draws) AS BIGINT), cast(sum(draws) * 8 // 16 AS BIGINT), cast([] AS BIGINT[]) FROM q
  UNION ALL
  SELECT n.shard, n.width, n.q, n.i, n.population, n.drawn, n.l FROM (
    SELECT unnest(CASE WHEN i < len(q)
      THEN [{'shard': shard, 'width': width, 'q': q, 'i': i + 1, 'population': population - marked, 'drawn': drawn - k, 'l': list_append(l, k)}]
      ELSE [{'shard': shard, 'width': width // 2, 'q': l, 'i': 0, 'population': cast(list_sum(l) AS BIGINT),
             'drawn': cast(list_sum(l) * (width // 2 // 2) // greatest(width // 2, 1) AS BIGINT), 'l': cast([] AS BIGINT[])},
            {'shard': shard + width // 2, 'width': width - width // 2, 'q': rest, 'i': 0, 'population': cast(list_sum(rest) AS BIGINT),
             'drawn': cast(list_sum(rest) * ((width - width // 2) // 2) // (width - width // 2) AS BIGINT), 'l': cast([] AS BIGINT[])}] END) AS n
    FROM (
      SELECT *, low + len(list_filter(range(1, len(w)), lambda j: list_sum(w[1:j]) <= goal)) AS k FROM (
        SELECT *, u * list_sum(w) AS goal FROM (
          SELECT *, list_transform(lw, lambda y: exp(y - list_max(lw))) AS w FROM (
            SELECT *, list_transform(range(low, high + 1), lambda y: cast(0 AS DOUBLE) - lgamma(y + 1) - lgamma(marked - y + 1) - lgamma(drawn - y + 1)
                                     - lgamma(population - marked - drawn + y + 1)) AS lw FROM (
              SELECT *, greatest(least_, cast(floor(mean) AS BIGINT) - reach) AS low, least(drawn, marked, cast(floor(mean) AS BIGINT) + reach) AS high FROM (
                SELECT *, cast(ceil(12 * sqrt(greatest(mean * (1 - marked / greatest(population, 1.0)) * (population - drawn) / greatest(population - 1, 1.0), 0))) AS BIGINT) + 20 AS reach FROM (
                  SELECT *, greatest(0, drawn - (population - marked)) AS least_, cast(drawn AS DOUBLE) * marked / greatest(population, 1.0) AS mean,
                         cast('0x' || substr(md5('draw:0:' || shard || ':' || width || ':0:' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
                  FROM (SELECT *, coalesce(q[i + 1], 0) AS marked, list_transform(range(1, len(q) + 1), lambda y: q[y] - coalesce(l[y], 0)) AS rest FROM tree WHERE width > 1)))))))))),
e AS (
  SELECT rank, list(ending ORDER BY shard) AS ends FROM (
    SELECT shard, rank, sum(quota) OVER (PARTITION BY rank ORDER BY shard) AS ending
    FROM (SELECT shard, unnest(q) AS quota, generate_subscripts(q, 1) - 1 AS rank FROM tree WHERE width = 1)) GROUP BY rank),
b AS (
  SELECT g.*, h // 281474976710656 AS block, past // 281474976710656 AS cut_block, extra, ends
  FROM g JOIN e ON e.rank = g.rank LEFT JOIN x ON x.rank = g.rank),
y AS (
  SELECT *, list_filter([{'turn': z, 'draw': z * 4096 + CASE WHEN z < passes
      THEN (block * (4 * (cast('0x' || substr(md5('turn:0:' || z), 1, 6) AS BIGINT) % 1024) + 1) + z) % 4096
      WHEN h = coalesce(extra, -1) THEN least(block, cut_block) ELSE block END} FOR z IN range(0, passes + 1)
      IF z < passes OR coalesce(block < cut_block, false) OR h <= cut OR h = coalesce(extra, -1)],
    lambda v: v.draw < ends[-1]) AS turns
  FROM b)
SELECT doc_id, size, source_size, target, cast(size * len(turns) AS BIGINT) AS taken,
       array_to_string(list_transform(turns, lambda v: len(list_filter(ends, lambda z: z <= v.draw))), ',') AS shards,
       array_to_string(list_transform(turns, lambda v: cast('0x' || substr(md5('place:0:' || h || ':' || v.turn), 1, 15) AS BIGINT)), ',') AS places
FROM y
"""

_OP9_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
       (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM r
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule_host || rule_path)) FROM r
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM u
"""

SQL = {
    "op1_license_scan": _op1_sql(),
    "op3_chat_format": _OP3_SQL,
    "op5_exact_dedup": _OP5_SQL,
    "op8_mix_sources": _OP8_SQL,
    "op9_url_filter": _OP9_SQL,
}
