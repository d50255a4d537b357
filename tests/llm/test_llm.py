"""The ten operators against brute force and on edge cases: nulls, empty texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from talkweave.llm import chat_format, embedding_dedup, license_scan, mixing, sentencepiece_codec, sharding, toxicity, url_filter
from talkweave.llm import queries as registered
from talkweave.llm._shared import Scratch, shared_dir
from talkweave.llm.embedding_dedup import near_vectors
from talkweave.llm.exact_dedup import drop_exact_copies, exact_dedup
from talkweave.llm.minhash_dedup import drop_near_copies, near_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, key string, id long, component string, set string"


def docs(spark, rows):
    """Documents with nulls and with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, 1, "k", None, "c", "s") for i, t, s in rows], SCHEMA)


RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(3000))
ROWS = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, "  x \n\n y", "b"), (5, " x y", "b"), (None, "x y", None), (7, "one two three", "c"), (7, "one two three", "c"), (8, "é ﬁ▁ 😀\u200b \x00", "c")]
EDGE = {"edge": ROWS, "empty": []}


@pytest.mark.parametrize("case", EDGE)
@pytest.mark.parametrize(
    "op",
    [
        license_scan.scan_licenses,
        exact_dedup,
        drop_exact_copies,
        near_dedup,
        drop_near_copies,
        mixing.mix,
        mixing.mixed_documents,
        sharding.assign_shards,
        lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d, MODEL), MODEL),
    ],
)
def test_edge_rows(spark, op, case):
    d = docs(spark, EDGE[case])
    out = op(d).collect()
    if op in (drop_exact_copies, drop_near_copies, mixing.mixed_documents):
        assert op(d).columns == d.columns and len(out) <= max(len(EDGE[case]) * 3, 0)
    else:
        assert len(out) == len(EDGE[case])


def test_license_scan_places(spark):
    d = docs(spark, [(1, "CC-BY x cc by. General Public License, released under the MIT license", "a"), (2, LONG + " licensed under the apache license version 2.0", "a")])
    a, b = license_scan.scan_licenses(d).orderBy("doc_id").collect()
    assert sorted((h["label"], h["start"]) for h in a["phrase_hits"]) == [("cc-by", 0), ("cc-by", 3), ("gpl", 5)]
    assert {h["label"] for h in a["template_hits"]} >= {"mit"} and {h["label"] for h in b["template_hits"]} == {"apache-2.0"}


def test_sentencepiece_equals_library(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "a", " a  b ", "▁▁x ▁", "x\n\ty", "</s> <0x0A>", "ﬁ½é😀", LONG, "z" * 3000]
    table = sentencepiece_codec.WordTable(m, limit=3)
    for t in texts:
        assert table.encode(t).tolist() == m.encode(t, add_bos=True, add_eos=True)
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), MODEL), MODEL).collect()
    for r in rows:
        ids = m.encode(r["text"], add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == m.decode(ids)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\</s>\\\\", "<<SYS>", "<", None, "[/INST", "</role></turn>\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "tool</s>", "user", "assistant", None, "system"], said))]
    rows += [(None, 0, "assistant", "x"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(t)).collect()}
    whole = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in rows[:7])
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[1]["well_formed"] and not got[1]["in_order"]
    assert got[1]["loss_sha256"] == hashlib.sha256(b"\\</s>\\\\").hexdigest()
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert chat_format.read_back(chat_format.format_chats(t.limit(0))).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    rows = [(i, (base[i % 40] + rng.standard_normal(8) * (0.02 if i >= 40 else 0)).tolist()) for i in range(200)]
    rows += [(200, rows[0][1]), (201, None), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] * 8), (205, [1.0]), (None, rows[0][1])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), neighbours=4).collect()
    good = [(i, np.array(v)) for i, v in rows[:201]]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= 0.95
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert len(got) == len(rows) and all(by[i]["n_links"] == hit[k].sum() - 1 for k, (i, _) in enumerate(good))
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in range(201, 206))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def vector_links(v, threshold=0.95):
    """Links and the smallest reachable place of each vector, by brute force."""
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = unit @ unit.T >= threshold
    label = np.arange(len(v))
    while (low := np.where(hit, label[None, :], len(v)).min(axis=1)).tolist() != label.tolist():
        label = low
    return [(int(a), int(b)) for a, b in zip(hit.sum(axis=1) - 1, label)]


def vector_rows(spark, v):
    return spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")


def test_vectors_in_nested_groups(spark):
    rng = np.random.default_rng(11)
    near = lambda of, by: of / np.linalg.norm(of) + by * rng.standard_normal(64) / 8
    top = rng.standard_normal(64)
    groups = [near(top, 0.17) for _ in range(20)]
    v = np.array([near(g, 0.03) for g in groups for _ in range(40)] + list(rng.standard_normal((100, 64))))
    want = vector_links(v)
    assert {(n, c) for n, c in want[:800]} == {(799, 0)}
    got = near_vectors(vector_rows(spark, v)).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == want


def pairs_and_a_group(pairs, group, alone):
    """Isolated pairs at a cosine of 0.955, one group of near copies and vectors without a link."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.standard_normal((pairs, 64)))
    w = rng.standard_normal((pairs, 64))
    w = unit(w - (w * a).sum(axis=1, keepdims=True) * a)
    near = unit(rng.standard_normal(64)) + 0.01 * rng.standard_normal((group, 64)) / 8
    return np.concatenate([a, 0.955 * a + (1 - 0.955**2) ** 0.5 * w, near, rng.standard_normal((alone, 64))])


def test_vectors_in_isolated_pairs(spark):
    v = pairs_and_a_group(400, 400, 18000)
    got = near_vectors(vector_rows(spark, v)).orderBy("vec_id").collect()
    missed = sum((r["n_links"], r["component_id"]) != (1, i % 400) for i, r in enumerate(got[:800]))
    assert missed <= 2 and all(r["n_links"] == 399 for r in got[800:1200]) and all(r["n_links"] == 0 for r in got[1200:])


def test_audit_sees_missed_pairs(spark, monkeypatch):
    v = pairs_and_a_group(40, 400, 500)
    want = vector_links(v)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, x.tobytes(), 1) for i, x in enumerate(u)], "node long, unit binary, copies long")
    rows = [(i, c, 0 if i < 80 and i % 40 < 10 else n) for i, (n, c) in enumerate(want)]  # a quarter of the pairs missed
    counted = spark.createDataFrame(rows, "node long, component long, links long")
    assert embedding_dedup._audit(nodes, counted, 0.95, 12) == {1: 0.75, 3: 1.0}
    # where passes do not reach the recall wanted, all nodes are compared
    monkeypatch.setattr(embedding_dedup._Descent, "descend", lambda self, _: setattr(self, "lists", self.nodes.selectExpr("node", "node as other", "0D as sim").limit(0)))
    monkeypatch.setattr(embedding_dedup, "ALL_BLOCK", 100)
    got = near_vectors(vector_rows(spark, v)).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == want and {r["audited_recall"] for r in got} == {1.0}
    # and where even that falls short there is no result
    monkeypatch.setattr(embedding_dedup, "_audit", lambda *_: {1: 0.5})
    with pytest.raises(RuntimeError):
        near_vectors(vector_rows(spark, v[:20]))


def test_vectors_under_repeated_and_text_ids(spark):
    u, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("5", u), ("5", w), ("9", u), ("9", u), ("7", [1.0, 0.1, 0.0]), (None, u), ("8", None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or "", r["n_links"], r["component_id"] or "", r["kept"]) for r in got) == [
        ("", 0, "", True), ("5", 0, "5", True), ("5", 2, "5", True), ("7", 2, "5", False), ("8", 0, "8", True), ("9", 2, "5", False), ("9", 2, "5", False)
    ]


def test_saturated_lists_grow(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.standard_normal(16) + 0.02 * rng.standard_normal((70, 16)), rng.standard_normal((60, 16))])
    v = np.concatenate([v, v[:5], v[:5]])  # hot copies of some
    n, found = len(v) - 10, {}
    with Scratch(spark) as scratch:
        unit = v[:n] / np.linalg.norm(v[:n], axis=1)[:, None]
        nodes = scratch.save(spark.createDataFrame([(i, x.tobytes(), 1) for i, x in enumerate(unit)], "node long, unit binary, copies long"), "nodes")
        d = embedding_dedup._Descent(scratch, nodes, 16, n, 4, 0.95)
        d.descend(0)
        assert d.lists.groupBy("node").count().agg(F.max("count")).first()[0] == 4
        found = {r["node"]: r["count"] for r in d.links(0).groupBy("node").count().collect()}
    true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert max(true) >= 60 and sum(found.values()) > 0.9 * true.sum() and all(found.get(i, 0) <= true[i] for i in range(n))
    got = near_vectors(vector_rows(spark, v), neighbours=4).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == vector_links(v)


def test_exact_dedup_with_collisions(spark):
    texts = [RNG.choice(["a b", "a  b", "c", "d\te", "d e", "", None, "f"]) for _ in range(60)]
    for size in (16, 0):  # 0: every text in one group
        got = exact_dedup(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), key_bytes=size).collect()
        groups = collections.defaultdict(list)
        for i, t in enumerate(texts):
            groups[" ".join((t or "").replace("\t", " ").split(" ")).replace("  ", " ")].append(i)
        want = {i: (g[0], len(g)) for g in groups.values() for i in g}
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want


def all_maximal(scores, at=0):
    """By definition: the best segment, and the same on either side of it."""
    sums = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    if not sums or max(sums)[0] <= 0:
        return []
    best, a, b = max(sums, key=lambda x: x[0])
    return all_maximal(scores[:a], at) + [(at + a, at + b, best)] + all_maximal(scores[b:], at + b)


def test_maximal_segments_equal_brute_force():
    for seed in range(300):
        r = random.Random(seed)
        runs = [(i, i + 1, r.uniform(-2, 2)) for i in range(r.randint(0, 16))]
        want = all_maximal([x for *_, x in runs])
        got = toxicity.maximal_segments(runs)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_toxicity_held_out(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words, toxic = [r.choice(WORDS) for _ in range(80)], int(r.random() < 0.2)
        for _ in range(4 * toxic):
            words[r.randrange(80)] = r.choice(["vile", "scum"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, toxic))
    d, lab = docs(spark, [*rows, (9999, None, None)]), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    scores = {x["doc_id"]: x for x in toxicity.score_toxicity(d, toxicity.fit(d, lab)).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    out = [(scores[i]["score"] >= 0.7, bool(t)) for i, t in labels if scores[i]["out"]]
    assert len(out) > 100 and sum(a == b for a, b in out) / len(out) > 0.97 and scores[9999]["score"] < 0.7
    none = toxicity.fit(d, lab.limit(0))
    assert toxicity.score_toxicity(d, none).where("score >= 0.7").count() == 0
    assert toxicity.drop_toxic(d.limit(0), lab).count() == 0
    # clashing names, repeated rows, a very long text
    long = " ".join(r.choice(WORDS) for _ in range(20_000))
    odd = d.selectExpr("doc_id", "text", "'x' as score", "2 as passages", "null as kept")
    odd = odd.union(odd.where("doc_id < 3")).union(spark.createDataFrame([(10_000, long), (10_001, long + " vile scum vile scum vile")], "doc_id long, text string").selectExpr("doc_id", "text", "'x'", "2", "null"))
    kept = toxicity.drop_toxic(odd, lab)
    assert kept.columns == odd.columns
    ids = collections.Counter(x["doc_id"] for x in kept.collect())
    toxic = {i for i, t in labels if t}
    assert len(toxic & set(ids)) < 0.05 * len(toxic) and sum(i in ids for i, t in labels if not t) > 0.97 * (600 - len(toxic))
    assert all(ids[i] in (0, 2) for i in range(3)) and ids[10_000] == 1
    again = toxicity.score_toxicity(odd.where("doc_id = 10001"), toxicity.fit(d, lab), ["doc_id", "score", "passages"])
    assert again.columns == ["doc_id", "score", "passages", "_score", "_passages"]
    found = again.first()["_passages"]
    assert any(20_000 <= p["first_word"] and p["end_word"] <= 20_005 for p in found)


def test_toxicity_reads_marks_alike(spark):
    assert toxicity.words_of("Ab_c d\u0301e हिन्दी x1 كِتاب") == ["ab", "c", "d\u0301e", "हिन्दी", "x1", "كِتاب"]
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words, toxic = [r.choice(WORDS) for _ in range(80)], i % 5 == 0
        if toxic:
            for _ in range(6):
                words[r.randrange(80)] = "हिन्दी"
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.token("हिन्दी") > 0


def test_shards(spark):
    rows = [(i, RNG.choice(["hot text"] * 3 + [f"{i} " * RNG.randint(1, 40)]), "a") for i in range(3000)]
    got = sharding.assign_shards(docs(spark, rows), shards=4).collect()
    held = collections.defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in h) for h in held.values()]
    assert len(held) == 4 and max(sizes) < 1.05 * sum(sizes) / 4
    assert all(sorted(r["slot"] for r in h) == list(range(len(h))) for h in held.values())


def test_shards_equal_what_brute_force_says(spark):
    r = random.Random(8)
    rows = [(i, r.choice([None, "", "é😀", "hot text"] + [f"{i} " * r.randint(1, 40)] * 4), "a") for i in range(2000)] + [(None, "hot text", "a")] * 300
    got = sharding.assign_shards(docs(spark, rows), shards=4, ranges=16).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert collections.Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == want
    part = sum(size(t) for _, t, _ in rows) / 4
    group, held = collections.Counter(), collections.defaultdict(set)
    for x in got:
        group[x["text_crc32"]] += x["size"]
        held[x["text_crc32"]].add(x["shard"])
    assert all(len(held[c]) == 1 for c in group if group[c] <= part)
    loads = [sum(x["size"] for x in got if x["shard"] == k) for k in range(4)]
    assert max(loads) < 1.2 * part


def test_shards_never_split_a_group_below_a_part(spark):
    rows = [(100 * g + i, f"group {g:02d} " + "x" * 90, "a") for g in range(17) for i in range(9)]
    got = sharding.assign_shards(docs(spark, rows), shards=16).collect()
    held = collections.defaultdict(set)
    for x in got:
        held[x["text_crc32"]].add(x["shard"])
    assert len(held) == 17 and all(len(s) == 1 for s in held.values()) and len({x["shard"] for x in got}) == 16


def test_mix(spark):
    rows = [(i, "w " * RNG.randint(1, 30), RNG.choice(["a"] * 12 + ["b", "c"])) for i in range(3000)]
    got = mixing.mix(docs(spark, rows), shards=5).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["size"] * len(r["shards"])
        target[r["source"]] = r["target"]
        assert len(r["shards"]) <= 3 and all(0 <= s < 5 for s in r["shards"])
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1e-6
    for shards in (5, 8):
        tree = mixing._tree(spark.createDataFrame([(i, q) for i, q in enumerate([900, 5, 0, 300])], "rank int, draws long"), shards, 1).collect()
        by = {(t["shard"], t["rank"]): t["quota"] for t in tree}
        assert len(by) == len(tree) == 4 * shards
        assert [sum(by[s, i] for s in range(shards)) for i in range(4)] == [900, 5, 0, 300]
        assert {sum(by[s, i] for i in range(4)) for s in range(shards)} <= {1205 // shards, 1205 // shards + 1}


def test_mix_tree_in_bundles(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    draws = [7, 0, 41, 12, 3, 90, 8, 8, 8, 1, 22]
    tree = mixing._tree(spark.createDataFrame(list(enumerate(draws)), "rank int, draws long"), 4, 1).collect()
    by = {(t["shard"], t["rank"]): t["quota"] for t in tree}
    assert len(by) == len(tree) == 44 and all(q >= 0 for q in by.values())
    assert [sum(by[s, i] for s in range(4)) for i in range(11)] == draws and {sum(by[s, i] for i in range(11)) for s in range(4)} == {50}


def test_mix_equals_sql(spark, tmp_path):
    """The tree of the SQL comes from the distribution's closed form."""
    r = random.Random(6)
    rows = [(i, r.choice([None, "", "w " * r.randint(1, 60)]), r.choice(["a"] * 9 + ["b", None, "é"])) for i in range(1500)]
    rows += [(None, "same words", "a")] * 40 + [(None, None, None)] * 40 + [(7, "w w w", "a")] * 5
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registered.SQL["op8_mix_sources"])
    at = [c[0] for c in want.description]
    want = sorted(want.fetchall(), key=str)
    got = registered.QUERIES["op8_mix_sources"](spark, str(tmp_path))
    assert sorted((tuple(x) for x in got.select(*at).collect()), key=str) == want
    # disjoint: every copy of a row is another draw; each leaf's rows stand in the order of their places
    d = docs(spark, rows)
    mixing.write_mix(d, str(tmp_path / "mix"), shards=4)
    out = spark.read.parquet(str(tmp_path / "mix"))
    taken = mixing.mix(d, shards=4).select(F.sum(F.size("shards"))).first()[0]
    assert out.count() == taken == mixing.mixed_documents(d, shards=4).count()


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.NET/x", "http://a.net", "https://x.example.net/en/1?q", "http://net.example.com/de/", "http://b.org/fr/x#y", "http://evilnet/", "x://" + "a." * 5000 + "net/" + "y" * 9000]
    p = spark.createDataFrame([(i, u, "b") for i, u in enumerate(urls)], "page_id long, url string, best string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(p).orderBy("page_id").collect()]
    want = [(None, "allow")] * 3 + [("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), ("net/", "block")]
    assert got == want
    assert url_filter.judge_urls(p, rules=[]).where("verdict <> 'allow'").count() == 0 and url_filter.judge_urls(p.limit(0)).count() == 0


def test_url_filter_with_a_table_of_rules(spark):
    r = random.Random(4)
    labels, steps = ["a", "b", "net", "com", "x-y"], ["", "en", "de", "p.html", "long" * 30]
    host = lambda n: ".".join(r.choice(labels) for _ in range(r.randint(1, n)))
    path = lambda n: "/" + "/".join(r.choice(steps) for _ in range(r.randint(0, n)))
    rules = {(host(3), path(3)): r.choice(["allow", "block"]) for _ in range(3000)}
    urls = [f"http://{host(5)}{path(6)}" + r.choice(["", "?q=/a/", "#f"]) for _ in range(600)] + ["http://net"] * 5 + [None, "", "net/en/"] * 60
    p = spark.createDataFrame([(i % 500, u, 1) for i, u in enumerate(urls)], "page_id long, url string, salt int")
    table = spark.createDataFrame([(v, h.upper(), q) for (h, q), v in rules.items()] + [(None, "a", "/")], "verdict string, host string, path string")

    def judged(u):
        if not u or "://" not in u:
            return None, "allow"
        rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
        h, q = (rest[: rest.index("/")], rest[rest.index("/") :]) if "/" in rest else (rest, "")
        fit = [(len(a + b), len(a), a, b) for a, b in rules if (h == a or h.endswith("." + a)) and q.startswith(b)]
        return (max(fit)[2] + max(fit)[3], rules[max(fit)[2:]]) if fit else (None, "allow")

    want = collections.Counter((i % 500, *judged(u)) for i, u in enumerate(urls))
    assert sum(n for (_, rule, _), n in want.items() if rule) > 100
    assert collections.Counter((x["page_id"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(p, table).collect()) == want


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(n):
    rows, r = [], random.Random(9)
    for k in range(n):
        base = [r.choice(WORDS) for _ in range(r.randint(3, 150))]
        for j in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(j):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w), "a"))
    return rows


def test_near_dedup_equals_brute_force(spark):
    rows = near_copies(60)
    got = near_dedup(docs(spark, rows)).collect()
    want = brute_components([(i, t) for i, t, _ in rows])
    assert sum((r["n_shingles"], r["component_id"]) != want[r["doc_id"]] for r in got) == 0


def test_near_dedup_with_repeated_and_text_ids(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[60:100])
    near = a.replace(WORDS[3], "zz")
    rows = [("3", a), ("7", a), ("7", b), ("7", b), ("9", near), (None, a), ("8", LONG * 7), ("6", LONG * 7 + " end")]
    d = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as component", "2 as kept", "3 as n", "4 as node")
    got = near_dedup(d).collect()
    assert sorted((r["doc_id"] or "", r["component_id"] or "", r["kept"]) for r in got) == [
        ("", "", True), ("3", "3", True), ("6", "6", True), ("7", "3", False), ("7", "7", True), ("7", "7", True), ("8", "6", False), ("9", "3", False)
    ]
    assert sorted(((r["doc_id"] or "", r["text"]) for r in drop_near_copies(d).collect())) == [("", a), ("3", a), ("6", LONG * 7 + " end"), ("7", b), ("7", b)]


def test_registered_near_dedup_equals_brute_force(spark, tmp_path):
    rows = near_copies(30) + [(1000, None, "a"), (1001, "", "a"), (1002, " a  b ", "a"), (1003, "A B", "a")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = registered.QUERIES["op10_minhash_near_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components([(i, t) for i, t, _ in rows])


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Named:
        conf, master = {}, "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    held = Named()
    held.sparkContext = held
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(RuntimeError):
            shared_dir(held)
    assert shared_dir(spark)


def test_edge_values(spark):
    """What the docstrings say of nulls, empty texts, repeats and clashing names, by value."""
    d = docs(spark, ROWS)
    by = lambda rows, *c: sorted((tuple(r[x] for x in ("doc_id", *c)) for r in rows.collect()), key=str)
    lic = {r["doc_id"]: (r["n_words"], r["phrase_hits"], r["template_hits"]) for r in license_scan.scan_licenses(d).collect()}
    assert lic[1] == lic[2] == (0, [], None) and lic[3][0] == 3000 and lic[8][0] == 3
    exact = by(exact_dedup(d), "keep_id", "group_size", "kept")
    assert exact.count((7, 7, 2, True)) == 2 and (1, 1, 2, True) in exact and (2, 1, 2, False) in exact and (None, None, 1, True) in exact
    assert (4, 4, 2, True) in exact and (5, 4, 2, False) in exact
    near = by(near_dedup(d), "n_shingles", "component_id", "kept")
    assert (1, 0, 1, True) in near and (5, 1, 4, False) in near and (None, 1, None, True) in near and near.count((7, 1, 7, True)) == 2
    chat = spark.createDataFrame([(1, None, None, None, 5), (1, 0, "user", "x" * 60_000, 5), (1, 0, "user", "x" * 60_000, 5)], "conv_id long, turn long, role string, text string, seq int")
    got = chat_format.read_back(chat_format.format_chats(chat)).first()
    assert got["n_turns"] == 3 and got["well_formed"] and got["loss_chars"] == 0 and got["turns_sha256"] == hashlib.sha256(("\n\n" + ("user\n" + "x" * 60_000 + "\n") * 2).encode()).hexdigest()
    long = sentencepiece_codec.encode(spark.createDataFrame([(LONG * 7, 1)], "text string, row int"), MODEL).first()
    assert np.frombuffer(long["ids"], "<u4").tolist() == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(LONG * 7, add_bos=True, add_eos=True)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = near_copies(25)
    rows += [(len(rows) + i, t, "b") for i, (_, t, _) in enumerate(rows[:5])]
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first = {}
    for i, t, s in rows:
        first.setdefault(" ".join(t.split()), (i, t, s))
    kept = [x for x in first.values()]
    part = brute_components([(i, t) for i, t, _ in kept])
    kept = [(i, t, s) for i, t, s in kept if part[i][1] == i]
    mixed = {r["doc_id"]: len(r["shards"]) for r in mixing.mix(docs(spark, kept)).collect()}
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = collections.Counter()
    for i, t, _ in kept:
        ids = np.array(m.encode(t, add_bos=True, add_eos=True), "<u4")
        if mixed[i]:
            want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())] = mixed[i]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_keeps_and_decodes_ids(spark):
    import corpus_pipeline

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = corpus_pipeline.sentencepiece(spark, docs(spark, ROWS), "").collect()
    want = []
    for i, t, s in ROWS:
        ids = m.encode(t or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, s, len(ids), hashlib.sha256(packed).hexdigest(), packed, hashlib.sha256(m.decode(ids).encode()).hexdigest()))
    assert collections.Counter((*r[:4], bytes(r[4]), r[5]) for r in got) == collections.Counter(want)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Toxic documents go, nulls, empty texts and repeats pass as the stages say, and an empty table stays empty."""
    import corpus_pipeline

    r = random.Random(1)
    rows = []
    for i in range(300):
        words = [r.choice(WORDS) for _ in range(150)]
        for _ in range(8 * (i % 5 == 0)):
            words[r.randrange(150)] = r.choice(["vile", "scum"])
        rows.append((i, " ".join(words), "a"))
    rows += [(900, None, "a"), (901, "", None), (None, None, None), (902, LONG * 7, "b"), (902, LONG * 7, "b")]
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    left = corpus_pipeline.toxicity(spark, table, str(tmp_path))
    ids = collections.Counter(x["doc_id"] for x in left.collect())
    assert left.columns == table.columns and sum(i in ids for i in range(0, 300, 5)) <= 3 and sum(i in ids for i in range(300) if i % 5) >= 237
    assert ids[900] == ids[901] == ids[None] == 1 and ids[902] == 2
    left = corpus_pipeline.exact_dedup(spark, left, "")
    ids = collections.Counter(x["doc_id"] for x in left.collect())
    assert ids[900] == 1 and ids[901] == 0 and ids[902] == 2 and left.columns == table.columns
    assert corpus_pipeline.minhash_dedup(spark, left, "").count() == left.count()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in whole} <= set(ids) and all(x["n_tokens"] == len(x["ids"]) // 4 for x in whole)
    empty = tmp_path / "none"
    table.limit(0).write.parquet(str(empty / "documents.parquet"))
    labels.write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
