"""MinHash near-dedup with tensored banding; every link is confirmed on full shingle sets.

A document's set holds the hashes of its distinct shingles. Instead of one band of minhashes for each
table, two small collections of SUBKEYS half-keys are made, each from ROWS minhashes; every pair of
one half-key from either collection is a table's key. SUBKEYS squared tables thus cost
2 * SUBKEYS * ROWS minhashes, the square root of what they would cost one by one.

Links are found in steps, each linear in the rows of a bucket:
1. Documents with equal sets are one node. Nodes of a bucket are compared with a few of its members.
2. Nodes of buckets that still hold several components are compared with the members that came out
   most central.
3. What then remains in mixed buckets goes through an exact prefix-filter join between components:
   with shingles in one global order, rarest first, sets of the wanted similarity share one of their
   first shingles. This loses nothing however large a bucket is, and forms no pairs inside a
   component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch, components

SHINGLE = 5
PERCENT = 75
ROWS = 2  # minhashes in a half-key
SUBKEYS = 10  # half-keys in either collection: 100 tables, 4 minhashes to a table's key
LEADERS = 4  # members that a bucket's nodes are compared with, in each of the first two steps
ORDER_BITS = 18  # counters of the shingle order
MEMO_WORDS = 300_000  # words whose hash a task keeps
PIECE_BYTES = 4 << 20  # of sets in a result batch
STRIP = 1024  # shingles whose minhashes are computed at a time

_MASK = (1 << 64) - 1


def _odd(seed: str) -> int:
    return xxhash.xxh64_intdigest(seed) | 1


_PLACE = np.array([_odd(f"place{i}") for i in range(SHINGLE)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


class Shingler:
    """Shingle sets as sorted distinct 64-bit hashes."""

    def __init__(self) -> None:
        self.memo = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower changes A-Z only and bytes.split parts at \x20 and \x09-\x0D only
        words = (text or "").encode().lower().split()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        if len(h) == 0:
            return h
        n = min(len(h), SHINGLE)
        sums = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            sums += h[i : len(h) - n + 1 + i] * _PLACE[i]
        found = _mixed(sums)
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]


_KEY, _MASKS, _FACTORS = (
    np.array([_odd(name) for name in names], np.uint64)
    for names in (
        [f"half{k}" for k in range(2 * SUBKEYS)],
        [f"mask{k}.{r}" for k in range(2 * SUBKEYS) for r in range(ROWS)],
        [f"min{k}.{r}" for k in range(2 * SUBKEYS) for r in range(ROWS)],
    )
)


def _half_keys(found: np.ndarray) -> np.ndarray:
    """2 * SUBKEYS half-keys of a set that isn't empty."""
    low = np.full(len(_MASKS), _MASK, np.uint64)
    for at in range(0, len(found), STRIP):
        # members are mixed already: an odd factor after a mask permutes them anew
        strip = found[None, at : at + STRIP] ^ _MASKS[:, None]
        strip *= _FACTORS[:, None]
        np.minimum(low, strip.min(axis=1), out=low)
    keys, low = _KEY, low.reshape(2 * SUBKEYS, ROWS)
    for r in range(ROWS):
        keys = _mixed(keys + low[:, r])
    return keys


def _prints(rows: DataFrame) -> DataFrame:
    """(id, text_md5, n, set_key, halves) of (id, text_md5, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        np.seterr(over="ignore")
        for b in batches:
            n, keys, halves = [], [], []
            for t in b.column(2):
                s = shingle(t.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                halves.append(_half_keys(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64()))],
                names=["id", "text_md5", "n", "set_key", "halves"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_md5 binary, n long, set_key binary, halves array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """(node, set) of (node, set_key, text); rows whose text isn't the node's are dropped, and rows of
    one node that follow each other count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last = Shingler(), None
        np.seterr(over="ignore")
        for b in batches:
            nodes, sets, held = [], [], 0
            for node, key, t in zip(b.column(0), b.column(1), b.column(2)):
                if node.as_py() == last:
                    continue
                s = shingle(t.as_py()).tobytes()
                if xxhash.xxh128_digest(s) == key.as_py():
                    last = node.as_py()
                    nodes.append(last)
                    sets.append(s)
                    held += len(s)
                if held >= PIECE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union, counted on the full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, union = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                t = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(t, s)
                at[at == len(t)] = len(t) - 1
                shared.append(int((t[at] == s).sum()))
                union.append(len(s) + len(t) - shared[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())],
                names=["a", "b", "both", "either"],
            )

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, both long, either long")


def _linked() -> Column:
    return F.col("both") * 100 >= F.col("either") * PERCENT


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    Two documents are linked if 100 times the size of their sets' intersection is at least 75 times
    that of the union; ``component_id`` is the smallest id reachable by links. Pairs of documents at
    the threshold share one of the 100 tables with probability 0.9995, closer ones more surely; from
    there on nothing is left out.

    Defined results: null texts and texts without words have no shingles and link with nothing; with
    fewer than five words the whole sequence is the one shingle; a very long text is shingled whole;
    rows that repeat id and text are one document; different texts under one id are different
    documents, each with a component of its own, named by the smallest id in it; a null id is linked
    with nothing (component null, kept); documents with equal sets tie, and the smallest id names them;
    other columns, whatever their names, are neither read nor returned; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_components(scratch, docs, id_col, text_col).drop("text_md5").withColumnRenamed("id", id_col))


def _text_md5(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _components(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_md5, n_shingles, component_id, kept) as :func:`near_dedup` says."""
    rows = docs.select(F.col(id_col).alias("id"), _text_md5(F.col(text_col)).alias("text_md5"), F.col(text_col).alias("text"))
    prints = scratch.save(_prints(rows), "prints")
    # a node: one distinct set, held by the row with the smallest id. Its number is made once, when the table is written
    nodes = prints.where("n > 0 and id is not null").groupBy("set_key")
    nodes = nodes.agg(F.min(F.struct("id", "text_md5")).alias("held"), F.min("n").alias("n"), F.min("halves").alias("halves"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = _buckets(scratch, nodes)
    wanted = buckets.select("node").distinct().join(nodes.select("node", "set_key", "held.*"), "node")
    texts = rows.join(wanted, ["id", "text_md5"]).select("node", "set_key", "text")
    sets = scratch.save(_sets(texts), "sets")
    times = sets.groupBy("node").count().agg(F.max("count")).first()[0] or 0
    if times > 1:  # rows that repeat id and text and met in several tasks
        sets = scratch.save(sets.dropDuplicates(["node"]), "sets")
    links = _find_links(scratch, buckets, sets)
    labels = scratch.save(components(scratch, links), "labels")
    named = nodes.join(labels, "node", "left").select("set_key", "held.id", F.coalesce("component", "node").alias("component"))
    named = scratch.save(named, "named")
    least = named.groupBy("component").agg(F.min("id").alias("name"))
    named = scratch.save(named.join(least, "component").select("set_key", "name"), "names")
    comp = F.when(F.col("id").isNotNull(), F.coalesce(F.col("name"), F.col("id")))
    return (
        prints.select("id", "text_md5", "n", "set_key")
        .join(named, "set_key", "left")
        .select("id", "text_md5", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
    )


def _buckets(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(key, node, n) of all table keys that more than one node has."""
    a, b = F.posexplode(F.slice("halves", 1, SUBKEYS)).alias("i", "first"), F.slice("halves", SUBKEYS + 1, SUBKEYS)
    keys = nodes.select("node", "n", a, b.alias("seconds")).select(
        "node", "n", "i", "first", F.posexplode("seconds").alias("j", "second")
    ).select(F.xxhash64("i", "j", "first", "second").alias("key"), "node", "n")
    shared = scratch.save(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "shared")
    return scratch.save(keys.join(shared, "key"), "buckets")


def _find_links(scratch: Scratch, buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes that candidates' links connect."""

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The distinct pairs a < b, compared."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return scratch.save(_compared(pairs, sets), name)

    def with_leader(rows: DataFrame) -> DataFrame:
        """Pairs of a bucket's node and one of its leaders, where sizes allow a link."""
        near = F.least("led.n", "n") * 100 >= F.greatest("led.n", "n") * PERCENT
        return rows.where(near).select(F.col("led.node").alias("a"), F.col("node").alias("b"))

    # 1: a few members of each bucket, the same ones in every table as far as possible
    picks = [F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node", "n")).alias(f"l{k}") for k in range(LEADERS)]
    picked = F.array_distinct(F.array(*[F.struct(f"l{k}.node", f"l{k}.n") for k in range(LEADERS)]))
    leaders = scratch.save(buckets.groupBy("key").agg(*picks).select("key", picked.alias("leaders")), "leaders")
    first = confirmed(with_leader(buckets.join(leaders, "key").select("node", "n", F.explode("leaders").alias("led"))), "first")
    links = first.where(_linked()).select("a", "b")

    def mixed(links: DataFrame) -> DataFrame:
        """(key, node, n, component) of the buckets that hold several components."""
        labels = scratch.save(components(scratch, links), "labels")
        named = scratch.save(
            buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component")), "named"
        )
        several = scratch.save(
            named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "several"
        )
        return scratch.save(named.join(several, "key"), "mixed")

    # 2: the members with the most in common with what they were compared with
    left = mixed(links)
    share = first.select("a", "b", (F.col("both") / F.col("either")).alias("j"))
    central = share.select(F.col("a").alias("node"), "j").union(share.select("b", "j")).groupBy("node").agg(F.avg("j").alias("mean"))
    ranked = left.join(central, "node", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    chosen = ranked.groupBy("key").agg(
        F.max(F.struct("mean", "node", "n", "component")).alias("best"),
        F.min(F.struct(F.xxhash64(F.lit(-1), "node"), "node", "n", "component")).alias("other"),
    )
    led = [F.struct(f"{x}.node", f"{x}.n", f"{x}.component") for x in ("best", "other")]
    chosen = scratch.save(chosen.select("key", F.explode(F.array(*led)).alias("led")), "chosen")
    second = confirmed(with_leader(left.join(chosen, "key").where("component <> led.component")), "second")
    more = second.where(_linked()).select("a", "b")
    if not more.isEmpty():
        links = scratch.save(links.union(more), "links")
        left = mixed(links)

    # 3: an exact join between components
    members = scratch.save(left.select("node", "component").distinct(), "members")
    third = confirmed(_prefix_pairs(scratch, members, sets), "third").where(_linked()).select("a", "b")
    return scratch.save(links.union(third), "links")


def _prefix_pairs(scratch: Scratch, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share one of their first shingles.

    Shingles are ordered by how often their counter, one of 2 ** ORDER_BITS, is hit by all members'
    sets, then by hash. Any fixed order gives the same links; this one keeps common shingles out of
    the prefixes. A set of n has n - ceil(0.75 n) + 1 first shingles. Of a pair's shared shingles the
    first one has all the others in what is left of either set from there on; a shingle after which
    too little is left to reach the threshold needs no pair.
    """
    own = scratch.save(members.join(sets, "node"), "own")
    mask = (1 << ORDER_BITS) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(mask + 1, np.int64)
        for b in batches:
            for s in b.column(0):
                held += np.bincount((np.frombuffer(s.as_buffer(), np.uint64) & np.uint64(mask)).astype(np.int64), minlength=mask + 1)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65536]), pa.array(held[at[i : i + 65536]])], names=["counter", "n"])

    hits = own.select("set").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    often = np.zeros(mask + 1, np.int64)  # 2 MB, whatever the input
    found = hits.toArrow()
    often[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    held = members.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        for b in batches:
            for node, component, s in zip(b.column(0), b.column(1), b.column(2)):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(x)
                first = n - -(-n * PERCENT // 100) + 1
                order = np.lexsort((x, counts[(x & np.uint64(mask)).astype(np.int64)]))[:first]
                keys = x[order].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        pa.array(np.full(first, node.as_py(), np.int64)),
                        pa.array(np.full(first, component.as_py(), np.int64)),
                        pa.array(np.full(first, n, np.int64)),
                        pa.array(n - np.arange(first, dtype=np.int64)),
                    ],
                    names=["shingle", "node", "component", "n", "rest"],
                )

    rows = scratch.save(
        own.select("node", "component", "set").mapInArrow(prefixes, "shingle long, node long, component long, n long, rest long"), "prefixes"
    )
    several = scratch.save(
        rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle"), "shingles"
    )
    rows = scratch.save(rows.join(several, "shingle"), "crossing")
    left, right = rows.alias("l"), rows.alias("r")
    return left.join(
        right,
        (F.col("l.shingle") == F.col("r.shingle"))
        & (F.col("l.component") < F.col("r.component"))
        & (F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * PERCENT)
        & (F.least("l.rest", "r.rest") * (100 + PERCENT) >= (F.col("l.n") + F.col("r.n")) * PERCENT),
    ).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_dedup` keeps, with all their columns.

    Defined results: those of ``near_dedup``; rows that repeat id and text are all kept or all
    dropped; rows kept hold nulls and all columns, whatever their names; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        kept = _components(scratch, docs, id_col, text_col).where("kept")
        kept = scratch.keep(kept.select(F.col("id").alias("kept_id"), F.col("text_md5").alias("kept_md5")).distinct())
    d = docs.alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.kept_id")) & (_text_md5(F.col(f"d.`{text_col}`")) == F.col("k.kept_md5"))
    return d.join(kept.alias("k"), same, "left_semi")
