"""Toxicity by maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Tokens get log-odds between toxic and other labelled texts, with an informative Dirichlet prior, and
only as far as the evidence is sure; every feature that is sure enough stays. One tokenizer reads the
texts that a model is fitted on and those it scores. A token counts once after each different word, so that copies
of one text, which repeat its neighbours too, add nothing. A scan of a text, linear in its tokens, finds every
maximal-scoring segment. For texts of the other class the best segment of n tokens follows an extreme
value law with parameters lambda and K; a segment's excess over that law, summed over the significant
ones, is a document's evidence, which a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm._shared import Scratch, spare_name

SAMPLE_ROWS = 10_000  # labelled rows that a model is fitted on, at most (as an expected number)
PRIOR = 10_000.0  # pseudo-counts of the Dirichlet prior, spread as the counts of both classes
SURE = 2.0  # standard deviations taken off a log-odds
LEAST_ODDS = 1.0  # of a feature, after that: weaker ones say nothing of a single passage
DRIFT = 0.1  # loss of every token without positive odds
STEMS = (5, 4)  # first characters that stand for a word too rare to have odds of its own
MEMO_WORDS = 300_000  # words whose score a task keeps
PIECE = 20_000  # rows of a result batch


def _marks() -> str:
    """Ranges of all combining marks, for a character class."""
    out, last = [], -2
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "M":
            if c != last + 1:
                out.append([c, c])
            out[-1][1] = last = c
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_WORD = re.compile(f"[\\w{_marks()}]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, combining marks and digits, in lower case."""
    return _WORD.findall(text.lower().replace("_", " "))


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]  # of features with positive odds: "=word" or "^stem"
    drift: float
    lam: float
    k: float
    slope: float
    intercept: float

    def token(self, word: str) -> float:
        """The word's own odds, else those of its longest stem that has any, else the drift."""
        odds = self.odds.get("=" + word)
        for n in STEMS:
            if odds is None and len(word) >= n:
                odds = self.odds.get("^" + word[:n])
        return self.drift if odds is None else odds

    def excess(self, score: float, n: int) -> float:
        """By how much a segment's normalised score exceeds what n tokens of clean text reach once."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def evidence(self, n: int, segments: Sequence[tuple[int, int, float]]) -> float:
        return sum(max(0.0, self.excess(score, n)) for *_, score in segments)

    def probability(self, evidence: float) -> float:
        """Evidence enters by its logarithm: the first significant passage decides most."""
        x = self.intercept + self.slope * math.log1p(evidence)
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))


def maximal_segments(runs: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of consecutive runs (start, end, score), in one linear scan.

    Each candidate keeps the running sum before and after it; a new positive run is joined to
    earlier candidates as long as that makes both better.
    """
    found: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for start, end, score in runs:
        before, total = total, total + score
        if score <= 0:
            continue
        new = [start, end, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(s), int(e), after - before) for s, e, before, after in found]


class Reader:
    """Finds a text's scored segments; keeps the scores of words it has met, up to MEMO_WORDS."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        memo, model = self.memo, self.model
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = model.token(w)
        hits = [(i, s) for i, s in enumerate(map(memo.__getitem__, words)) if s > 0]
        runs, at = [], 0
        for i, s in hits:  # what lies between two hits is one losing run
            if i > at:
                runs.append((at, i, model.drift * (i - at)))
            runs.append((i, i + 1, s))
            at = i + 1
        return len(words), maximal_segments(runs)

    def judge(self, text: str) -> tuple[float, list[dict]]:
        """The score, and every segment that clean text reaches less than once in a hundred times."""
        n, segments = self.segments(text)
        rated = [(s, e, score, self.model.excess(score, n)) for s, e, score in segments]
        return self.model.probability(self.model.evidence(n, segments)), [
            {"first_word": s, "end_word": e, "odds": score, "e_value": math.exp(-x)} for s, e, score, x in rated if x > math.log(100)
        ]


def held_out(id_: Column) -> Column:
    """Whether the id falls into the fold that no model learns from (a null id doesn't)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small penalty, so that separated classes converge."""
    a, b, penalty = 0.0, 0.0, 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -700, 700)))
        w = p * (1 - p) + 1e-9
        g = np.array([(x * (p - y)).sum() + penalty * a, (p - y).sum() + penalty * b])
        h = np.array([[(w * x * x).sum() + penalty, (w * x).sum()], [(w * x).sum(), w.sum() + penalty]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """A model from labelled rows outside the held-out fold, ``sample_rows`` of them at most.

    Texts, ids and labels only are read. Every word of the sample's whole texts counts; what reaches
    the driver is bounded by the sample (sure features, and four numbers for each text). Defined
    results: a label row without a document, and a null label or id, are not used; of several labels
    of one id the largest counts, of several texts of one id the first in byte order; without labels of both kinds the model has no features and gives the labels' mean.
    """
    with Scratch(docs.sparkSession) as scratch:
        known = scratch.save(
            labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
            .where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
            .groupBy("id")
            .agg(F.max("toxic").alias("toxic")),
            "known",
        )
        rows = known.count()
        share = min(1.0, sample_rows / max(rows, 1))
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), F.col("id")), 11).cast("double") / F.lit(float(1 << 53))
        drawn = scratch.save(known.where(draw < share), "drawn")
        texts = scratch.save(
            docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(drawn), "id")  # no more rows than the sample's bound
            .groupBy("id", "toxic")
            .agg(F.min("text").alias("text"))  # one text for each id, so texts keep that bound
            .select("text", "toxic"),
            "texts",
        )

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                    words = words_of(text.as_py())
                    pairs = list({*zip(words, ["", *words])})
                    for at in range(0, len(pairs), PIECE):
                        w, before = zip(*pairs[at : at + PIECE])
                        yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(w), pa.int32()), pa.array(w), pa.array(before)], names=["toxic", "w", "before"])

        contexts = texts.mapInArrow(read, "toxic int, w string, before string").select("toxic", "w", F.xxhash64("before").alias("before")).distinct()
        counted = scratch.save(
            contexts.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")),
            "counted",
        )
        totals = counted.agg(F.sum("t"), F.sum("c")).first()
        n_toxic, n_clean = (float(x or 0) for x in totals)
        feature = F.array(
            F.concat(F.lit("="), "w"),
            *[F.when(F.char_length("w") >= n, F.concat(F.lit("^"), F.substring("w", 1, n))) for n in STEMS],
        )
        sums = (
            counted.select(F.explode(feature).alias("f"), "t", "c")
            .where("f is not null")
            .groupBy("f")
            .agg(F.sum("t").cast("double").alias("t"), F.sum("c").cast("double").alias("c"))
        )
        prior = PRIOR * (F.col("t") + F.col("c")) / F.lit(max(n_toxic + n_clean, 1.0))

        def logit(x: Column, n: float) -> Column:
            return F.log((x + prior) / (F.lit(n + PRIOR) - x - prior))

        delta = logit(F.col("t"), n_toxic) - logit(F.col("c"), n_clean)
        doubt = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
        odds: dict[str, float] = {}
        if n_toxic and n_clean:
            # no more than the sample's words, and few of them are sure
            best = sums.select("f", (delta - SURE * doubt).alias("s")).where(F.col("s") > LEAST_ODDS)
            odds = {r["f"]: r["s"] for r in best.collect()}
        bare = Model(odds, -DRIFT, 1.0, 1.0, 0.0, 0.0)

        def measured(model: Model) -> np.ndarray:
            """(words, best segment, evidence, toxic) of every text of the sample."""

            def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                reader = Reader(model)
                for b in batches:
                    found = [reader.segments(t) for t in b.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([float(n) for n, _ in found], pa.float64()),
                            pa.array([max((s for *_, s in x), default=0.0) for _, x in found], pa.float64()),
                            pa.array([model.evidence(n, x) for n, x in found], pa.float64()),
                            b.column(1).cast(pa.float64()),
                        ],
                        names=["n", "best", "evidence", "toxic"],
                    )

            rows = texts.mapInArrow(measure, "n double, best double, evidence double, toxic double")
            return np.array([tuple(r) for r in rows.collect()], np.float64).reshape(-1, 4)

        per_word = (
            counted.where("c > 0")
            .select("c", *[F.concat(F.lit("="), "w").alias("f0")])
            .join(F.broadcast(docs.sparkSession.createDataFrame([(f, s) for f, s in odds.items()], "f0 string, s double")), "f0")
            .groupBy(F.round("s", 1).alias("s"))
            .agg(F.sum("c").alias("c"))
            .collect()
        )
        return _calibrated(bare, measured, {r["s"]: r["c"] for r in per_word}, n_clean)


def _calibrated(bare: Model, measured: Callable[[Model], np.ndarray], hits: dict[float, int], n_clean: float) -> Model:
    """lambda and K of clean text, and the curve from evidence to score, from the sampled rows."""
    n, best, _, label = measured(bare).T
    toxic = label == 1
    if not toxic.any() or toxic.all():
        mean = float(toxic.mean()) if len(toxic) else 0.0
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return Model({}, bare.drift, 1.0, 1.0, 0.0, math.log(mean / (1 - mean)))
    # lambda: the positive root of sum p(s) exp(lambda s) = 1 over clean tokens, half a token added
    typical = float(np.median(list(bare.odds.values()))) if bare.odds else 1.0
    p = {**hits, typical: hits.get(typical, 0) + 0.5}
    tokens = max(n_clean, 1.0)
    rest = 1.0 - sum(p.values()) / tokens
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        total = rest * math.exp(mid * bare.drift) + sum(c / tokens * math.exp(min(700.0, mid * s)) for s, c in p.items())
        low, high = (mid, high) if total < 1 else (low, mid)
    lam = low
    # K: so many clean texts reach the lowest positive score as the law says
    floor = min(bare.odds.values(), default=1.0)
    reached = (best[~toxic] >= floor).sum() + 0.5
    k = float(reached / max(1.0, n[~toxic].sum() * math.exp(-lam * floor)))
    half = Model(bare.odds, bare.drift, lam, k, 0.0, 0.0)
    _, _, evidence, label = measured(half).T  # rows may come in another order
    slope, intercept = _logistic(np.log1p(evidence), (label == 1).astype(float))
    return Model(bare.odds, bare.drift, lam, k, slope, intercept)


_PASSAGES = pa.list_(
    pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("odds", pa.float64()), ("e_value", pa.float64())])
)
_RESULT = "score double, passages array<struct<first_word: bigint, end_word: bigint, odds: double, e_value: double>>"


def _judged(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str) -> DataFrame:
    """(kept, score, passages), ``kept`` a struct of the columns ``keep``."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"))
    kept = rows.schema["kept"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [reader.judge(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], _PASSAGES)],
                    names=["kept", "score", "passages"],
                )

    return rows.mapInArrow(judge, f"kept {kept}, {_RESULT}")


def score_toxicity(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, score (0 to 1) and the toxic passages.

    ``passages`` lists the significant segments (first_word, end_word, odds, e_value) of the whole
    text. The score reads the text alone. Defined results: null and empty texts have no passages and
    the score of no evidence; a very long text is scanned whole, in time linear in its words; equal
    texts, so all repeated rows, have equal scores, and of segments of equal score the first stands
    first; nulls in kept columns and repeated rows stay; where a kept column is named score or
    passages, the new column's name gets an underscore in front; other columns, whatever their
    names, are neither read nor returned; an empty table gives no rows.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    new = [F.col(c).alias(spare_name(kept, c)) for c in ("score", "passages")]
    return _judged(docs, model, keep, text_col).select("kept.*", *new)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Defined results: those of ``fit`` and ``score_toxicity``; a null or empty text has no evidence
    and stays unless most labelled texts are toxic; rows that stay keep nulls and all columns, whatever
    their names; rows with equal texts stay or go together; without labels all rows stay; an empty
    table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    return _judged(docs, model, docs.columns, text_col).where(F.col("score") < threshold).select("kept.*")
