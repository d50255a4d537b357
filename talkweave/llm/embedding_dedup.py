"""Embedding near-dedup by NN-descent over cosine similarity in double precision.

Nodes are distinct vectors. Every node keeps a list of its nearest neighbours known so far. Lists
start from random-hyperplane leaves; then neighbours of neighbours are compared, in groups of a node
with its neighbours and some of those that have it as a neighbour, until hardly a link is new. A list
full of links is saturated: such lists double and their groups are joined again, up to a stated length.
Every group compared on the way also hands on bridges, a spanning forest of the links among its members,
whatever the lists' length. List entries at or above the threshold and bridges give the components;
links are then counted exactly among all members of a component, compared block by block.

Leaves deepen as the table grows, so the number of trees grows too: two vectors at the threshold share
a leaf with a stated probability. A sample of nodes, linked and unlinked ones apart, is compared with
all others to audit recall by a node's number of links; if any class falls short, further leaves and
rounds follow, and at last all nodes are compared, block by block.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch, components

THRESHOLD = 0.95
NEIGHBOURS = 12  # length of a list
LEAF = 64  # nodes in a leaf, about
TREES = 4  # at least, and in one step
SHARED = 0.999  # probability that two vectors at the threshold share a leaf of a pass
ROUNDS = 6  # of neighbours' neighbours, at most, in each pass
SETTLED = 0.01  # share of the lists' links that are new in a round when descent ends
LONGEST = 96  # length up to which saturated lists double
BLOCK = 2048  # nodes in a block of a component
STRIP = 256  # of them, rows of similarities held at a time
ALL_BLOCK = 2048  # nodes in a block where all nodes are compared
AUDITED = 1024  # nodes with few links found, and as many with many, counted against all nodes
AUDITED_ALONE = 4096  # nodes without a link found, counted against all nodes
RECALL = 0.98  # wanted of the audit
LEAST_RECALL = 0.9  # below that there is no result
PASSES = 3  # sets of trees and rounds until that is met; then all nodes are compared

_log = logging.getLogger(__name__)


def _units(rows: DataFrame, dim: int) -> DataFrame:
    """(id, unit): the vector over its length as float64 bytes; null unless it can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                unit = None
                if v.is_valid and len(v.values) == dim and dim and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top  # so that squares neither overflow nor vanish
                        unit = (x / math.sqrt(float(x @ x)) + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "unit"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, unit binary")


def _bits(n: int) -> int:
    """Levels of a tree over n nodes."""
    return min(40, max(0, math.ceil(math.log2(max(n, 1) / LEAF))))


def _trees(n: int, threshold: float) -> int:
    """Trees so that two vectors at the threshold share a leaf with probability SHARED."""
    one = (1 - math.acos(min(1.0, max(0.0, threshold))) / math.pi) ** _bits(n)
    return TREES if one >= SHARED else max(TREES, math.ceil(math.log(1 - SHARED) / math.log(1 - one)))


def _leaves(scratch: Scratch, nodes: DataFrame, dim: int, n: int, seed: int) -> DataFrame:
    """(group, node): TREES trees' leaves by the signs of the node's products with random vectors."""
    bits = _bits(n)
    planes = np.random.default_rng(seed).standard_normal((TREES, bits, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.frombuffer(u.as_buffer(), np.float64) for u in b.column(1)])
            for t in range(TREES):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code * TREES + t)], names=["node", "leaf"])

    leaves = scratch.save(nodes.select("node", "unit").mapInArrow(run, "node long, leaf long"), "leaves")
    # written, so that the join below reads two plain shuffles, which adaptive execution can split
    sizes = scratch.save(leaves.groupBy("leaf").agg(F.count("*").alias("members")), "sizes")
    part = F.expr(f"pmod(xxhash64(node, leaf), cast(ceil(members / {2 * LEAF}D) as bigint))")  # of a leaf that is too large
    return leaves.join(sizes, "leaf").select(F.xxhash64(F.lit(seed), "leaf", part).alias("group"), "node")


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ends of the links of a spanning forest of ``hit``, a symmetric table of links."""
    left = hit.any(axis=1)
    froms, tos = [], []
    for root in np.flatnonzero(left):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            i = front.pop()
            new = np.flatnonzero(hit[i] & left)
            left[new] = False
            froms.append(np.full(len(new), i))
            tos.append(new)
            front.extend(new)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *froms]), np.concatenate([none, *tos])


def _local_join(groups: DataFrame, nodes: DataFrame, lists: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """(node, other, sim, bridge): in every group each node's k nearest that are nearer than its list's end, and bridges."""
    rows = groups.join(nodes.select("node", "unit"), "node")
    if lists is None:
        rows = rows.withColumn("far", F.lit(-2.0))
    else:
        ends = lists.groupBy("node").agg(F.when(F.count("*") < k, F.lit(-2.0)).otherwise(F.min("sim")).alias("far"))
        rows = rows.join(ends, "node", "left").withColumn("far", F.coalesce("far", F.lit(-2.0)))
    rows = rows.select("group", "node", "far", "unit").repartition("group").sortWithinPartitions("group", "node")

    def compared(nodes_: list, far: list, units: list) -> pa.RecordBatch | None:
        at = [i for i in range(len(nodes_)) if i == 0 or nodes_[i] != nodes_[i - 1]]
        ids, ends = np.array([nodes_[i] for i in at], np.int64), np.array([far[i] for i in at])
        x = np.stack([np.frombuffer(units[i], np.float64) for i in at])
        sims = x @ x.T
        np.fill_diagonal(sims, -3.0)
        take = min(k, len(ids) - 1)
        if take <= 0:
            return None
        best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        s = np.take_along_axis(sims, best, 1)
        ok = s > ends[:, None]
        who = np.broadcast_to(ids[:, None], s.shape)[ok]
        a, b = _forest(sims >= threshold)
        bridge = np.repeat([False, True], [len(who), len(a)])
        columns = [np.concatenate(c) for c in ((who, ids[a]), (ids[best][ok], ids[b]), (s[ok], sims[a, b]))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, bridge)], names=["node", "other", "sim", "bridge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, ([], [], [])
        for b in batches:
            for group, *row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if group != of and held[0]:
                    if (out := compared(*held)) is not None:
                        yield out
                    held = ([], [], [])
                of = group
                for to, value in zip(held, row):
                    to.append(value)
        if held[0] and (out := compared(*held)) is not None:
            yield out

    return rows.mapInArrow(run, "node long, other long, sim double, bridge boolean")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """(node, other, sim): each node's k nearest. The limit on the row number also holds before the
    shuffle, so a node named very often costs k rows for each task, and none are gathered."""
    # one similarity for a pair, whichever group it came from
    found = found.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def _around(nodes: DataFrame, lists: DataFrame, k: int, seed: int, centres: DataFrame | None = None) -> DataFrame:
    """(group, node): a node, its neighbours and about k of those that have it as a neighbour, for all
    nodes or for ``centres``."""
    reverse = lists.select(F.col("other").alias("group"), "node")
    named = reverse.groupBy("group").agg(F.count("*").alias("times"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "group", "node"), F.lit(1 << 20)) * F.col("times") < F.lit(k << 20)
    groups = (
        lists.select(F.col("node").alias("group"), F.col("other").alias("node"))
        .union(reverse.join(named, "group").where(draw).select("group", "node"))
        .union(nodes.select(F.col("node").alias("group"), "node"))
    )
    return (groups if centres is None else groups.join(centres, "group", "left_semi")).distinct()


class _Descent:
    """Neighbour lists of all nodes, and tables (node, other) of the bridges met on the way."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, dim: int, n: int, k: int, threshold: float):
        self.scratch, self.nodes, self.dim, self.n, self.k, self.threshold = scratch, nodes, dim, n, k, threshold
        self.lists: DataFrame | None = None
        self.bridges: list[DataFrame] = []

    def _join(self, groups: DataFrame, lists: DataFrame | None, k: int, linked: bool = False) -> DataFrame:
        """The lists after one local join; ``linked``: of links only."""
        found = self.scratch.save(_local_join(groups, self.nodes, lists, k, self.threshold), "found")
        near = found.where("not bridge").drop("bridge")
        if linked:
            near = near.where(F.col("sim") >= self.threshold)
        after = self.scratch.save(_nearest(near if lists is None else near.union(lists), k), "lists")
        self.bridges.append(self.scratch.save(found.where("bridge").select("node", "other").distinct(), "bridges"))
        self.scratch.drop(found)
        return after

    def descend(self, seed: int) -> None:
        """Trees, then rounds of neighbours' neighbours until hardly a link is new."""
        for t in range(0, _trees(self.n, self.threshold), TREES):
            before = self.lists
            leaves = _leaves(self.scratch, self.nodes, self.dim, self.n, seed + t)
            self.lists = self._join(leaves, before, self.k)
            if before is not None:
                self.scratch.drop(before)
        for r in range(ROUNDS):
            before = self.lists
            self.lists = self._join(_around(self.nodes, before, self.k, seed + r), before, self.k)
            # links are what is kept; whether far neighbours still change places matters to none of them
            links = self.lists.where(F.col("sim") >= self.threshold).join(before.select("node", "other", F.lit(True).alias("old")), ["node", "other"], "left")
            held, fresh = links.agg(F.count("*"), F.count_if(F.col("old").isNull())).first()
            self.scratch.drop(before)
            if fresh <= SETTLED * held:
                break

    def links(self, seed: int) -> DataFrame:
        """(node, other) of list entries at or above the threshold, lists enlarged where saturated.

        A list is saturated when it is full of links. Its node's list doubles, and groups around such
        nodes are joined again; as groups grow like lists, fewer centres are drawn, so that a node
        still meets about as many groups and every doubling costs about one round. Lists that are
        still saturated at ``LONGEST`` are not needed in full: their groups' bridges connect what
        they hold, and links are counted among all members of their components.
        """
        k, held = self.k, self.scratch.save(self.lists.where(F.col("sim") >= self.threshold), "links")
        while k < LONGEST:
            full = held.groupBy(F.col("node").alias("group")).agg(F.count("*").alias("m")).where(F.col("m") >= k).select("group")
            share = self.k / k
            centres = self.scratch.save(full.where(F.pmod(F.xxhash64(F.lit(seed + k), "group"), F.lit(1 << 20)) < share * (1 << 20)), "centres")
            if centres.isEmpty():
                break
            k *= 2
            before = held
            held = self._join(_around(self.nodes, before, k, seed + k, centres), before, k, linked=True)
            self.scratch.drop(before)
        return held.select("node", "other")


def _paired(members: DataFrame, size: int, made: Callable[[list[tuple], list[tuple], bool], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``made`` gives for every two blocks, of ``size`` nodes about, of a component, one task each.

    members: (component, node, copies, unit). ``made`` gets both blocks' rows (node, copies, unit) and
    whether they are one block.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.expr(f"cast(ceil(m / {size}D) as int)"))
    rows = members.join(sizes.select("component", "blocks"), "component").withColumn(
        "block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")),
    )
    rows = (
        rows.withColumn("pair", F.explode(pairs))
        .select("component", "pair.low", "pair.high", "block", "node", "copies", "unit")
        .repartition("component", "low", "high")
        .sortWithinPartitions("component", "low", "high", "block")
    )

    def of(held: list[tuple]) -> pa.RecordBatch | None:
        low, high = held[0][1], held[0][2]
        first, second = ([r[4:] for r in held if r[3] == block] for block in (low, high))
        return made(first, second, low == high) if first and second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and held[0][:3] != row[:3]:
                    if (out := of(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := of(held)) is not None:
            yield out

    return rows.mapInArrow(run, schema)


def _hits(first: list[tuple], second: list[tuple], same: bool, threshold: float) -> np.ndarray:
    """Which of the first block's nodes are linked with which of the second's."""
    a, b = (np.stack([np.frombuffer(r[2], np.float64) for r in part]) for part in (first, second))
    hit = np.concatenate([a[i : i + STRIP] @ b.T >= threshold for i in range(0, len(a), STRIP)])
    if same:
        np.fill_diagonal(hit, False)
    return hit


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): links of every member with all members of its component, copies counted."""

    def counted(first: list[tuple], second: list[tuple], same: bool) -> pa.RecordBatch:
        hit = _hits(first, second, same, threshold)
        ids, links = [r[0] for r in first], hit @ np.array([r[1] for r in second], np.int64)
        if not same:
            ids = ids + [r[0] for r in second]
            links = np.concatenate([links, hit.T @ np.array([r[1] for r in first], np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["node", "links"])

    return _paired(members, BLOCK, counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _all_bridges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, other): a spanning forest of the links of every two blocks of all nodes; misses none."""

    def bridged(first: list[tuple], second: list[tuple], same: bool) -> pa.RecordBatch:
        hit = _hits(first, second, same, threshold)
        ids = np.array([r[0] for r in (first if same else first + second)], np.int64)
        if not same:
            both = np.zeros((len(ids), len(ids)), bool)
            both[: len(first), len(first) :], both[len(first) :, : len(first)] = hit, hit.T
            hit = both
        a, b = _forest(hit)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["node", "other"])

    rows = nodes.select(F.lit(0).cast("long").alias("component"), "node", "copies", "unit")
    return _paired(rows, ALL_BLOCK, bridged, "node long, other long")


def _links(scratch: Scratch, nodes: DataFrame, linked: DataFrame, bridges: list[DataFrame], threshold: float) -> DataFrame:
    """(node, component, links) for all nodes; links count other nodes' copies."""
    for table in bridges:
        linked = linked.union(table)
    labels = scratch.save(components(scratch, linked.select(F.col("node").alias("a"), F.col("other").alias("b"))), "labels")
    named = scratch.save(
        nodes.join(labels, "node", "left").select("node", "copies", "unit", F.coalesce("component", "node").alias("component")), "named"
    )
    inside = named.join(labels.select("component").distinct(), "component").select("component", "node", "copies", "unit")
    counts = scratch.save(_link_counts(inside, threshold), "counts")
    return scratch.save(
        named.join(counts, "node", "left").select("node", "component", F.coalesce("links", F.lit(0).cast("long")).alias("links")),
        "counted",
    )


def _audit(nodes: DataFrame, counted: DataFrame, threshold: float, k: int) -> dict[int, float]:
    """Mean share of a node's true links that were found, by class: 1 link, up to k (2), more (3).

    Nodes are drawn apart by the links found, as nodes whose links were all missed are among the many
    without any, and weigh as many nodes as they stand for. Only classes seen are given.
    """
    found = nodes.join(counted, "node").withColumn("drawn", F.expr(f"case when links = 0 then 0 when links <= {k} then 1 else 2 end"))
    sizes = {r["drawn"]: r["count"] for r in found.groupBy("drawn").count().collect()}
    share = F.lit(0.0)
    for drawn, size in sizes.items():
        share = F.when(F.col("drawn") == drawn, (AUDITED if drawn else AUDITED_ALONE) / size).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 40)) < share * float(1 << 40)
    asked = found.where(draw).select("node", "unit", "links", "drawn").collect()
    if not asked:
        return {}
    x = np.stack([np.frombuffer(r["unit"], np.float64) for r in asked])
    ids = np.array([r["node"] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for whole in batches:
            for b in (whole.slice(i, STRIP) for i in range(0, whole.num_rows, STRIP)):
                y = np.stack([np.frombuffer(u.as_buffer(), np.float64) for u in b.column(2)])
                at, other = np.nonzero(x @ y.T >= threshold)
                apart = ids[at] != b.column(0).to_numpy()[other]
                np.add.at(total, at[apart], b.column(1).to_numpy()[other[apart]])
        yield pa.RecordBatch.from_arrays([pa.array(ids[total > 0]), pa.array(total[total > 0])], names=["node", "true"])

    true = nodes.select("node", "copies", "unit").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    of = {r["node"]: r["true"] for r in true.collect()}
    drawn = {d: sum(r["drawn"] == d for r in asked) for d in sizes}
    got, all_ = {}, {}
    for r in asked:
        if links := of.get(r["node"]):
            size, weight = 1 if links == 1 else 2 if links <= k else 3, sizes[r["drawn"]] / drawn[r["drawn"]]
            got[size] = got.get(size, 0.0) + weight * min(r["links"], links) / links
            all_[size] = all_.get(size, 0.0) + weight
    return {size: got[size] / all_[size] for size in sorted(all_)}


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS
) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept, audited_recall).

    ``n_links`` counts the other vectors found with a cosine of at least ``threshold``, copies
    included; ``component_id`` is the smallest id reachable by links. ``audited_recall`` is one number
    for the run: the share of audited nodes' true links that was found, of the class of nodes where it
    is lowest (1 where no audited node has a link). Below ``LEAST_RECALL`` there is no result but an error.

    Defined results: a vector that is null, zero, holds a null or a non-finite component, or is not of
    the table's most common length links with nothing (component its own id, kept), as does a null
    id (component null); rows that repeat id and vector are one vector; different vectors under one id
    are different vectors, each with links and a component of its own, named by the smallest id in it;
    of ties among neighbours the smaller node comes first in a list, which no count depends on; a
    vector of any length is one value of a row; other columns, whatever their names, are neither read
    nor returned; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    common = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    with Scratch(vectors.sparkSession) as scratch:
        units = scratch.save(_units(rows, dim), "units")
        # a node is a distinct vector. Its number is made once, when the table is written
        own = units.where("unit is not null and id is not null").distinct().groupBy("unit")
        own = own.agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
        nodes = scratch.save(own.select("node", "unit", "copies", "least"), "nodes")
        n, plain = nodes.count(), nodes.select("node", "unit", "copies")
        descent = _Descent(scratch, plain, dim, n, neighbours, threshold)
        for p in range(PASSES):
            descent.descend(1000 * p)
            counted = _links(scratch, plain, descent.links(1000 * p), descent.bridges, threshold)
            recall = _audit(plain, counted, threshold, neighbours)
            _log.info("pass %d: audited recall by class %s", p + 1, recall)
            if min(recall.values(), default=1.0) >= RECALL:
                break
        else:
            _log.warning("audited recall is below %.2f: comparing all nodes", RECALL)
            bridges = scratch.save(_all_bridges(plain, threshold), "bridges")
            counted = _links(scratch, plain, bridges, [], threshold)
            recall = _audit(plain, counted, threshold, neighbours)
        lowest = min(recall.values(), default=1.0)
        if lowest < LEAST_RECALL:
            raise RuntimeError(f"audited recall {recall} is below {LEAST_RECALL}")
        found = nodes.join(counted, "node")
        names = found.groupBy("component").agg(F.min("least").alias("name"))
        result = scratch.save(found.join(names, "component").select("unit", "copies", "links", "name"), "result")
        links = F.col("id").isNotNull() & F.col("name").isNotNull()
        comp = F.when(links, F.col("name")).otherwise(F.col("id"))
        return scratch.keep(
            units.join(result, "unit", "left").select(
                F.col("id").alias(id_col),
                F.when(links, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
                comp.alias("component_id"),
                F.col("id").eqNullSafe(comp).alias("kept"),
                F.lit(float(lowest)).alias("audited_recall"),
            )
        )
