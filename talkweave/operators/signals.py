"""Editorial signals of transcript windows, rubric scores and composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.operators import windows
from talkweave.sources.transcripts import WORD_MS, WORD_PITCH_MS, spread

# How a hook begins.
HOOK_STARTS = [
    "what", "why", "how", "here's", "heres", "the biggest", "the problem", "the thing", "most people", "nobody",
    "everyone", "everybody", "if you", "let me tell", "the truth", "people think", "you know what", "the mistake",
    "one thing", "my favorite", "the best", "the worst", "i learned", "i realized", "the secret", "stop", "never",
    "always",
]
# Substrings that signal contrast.
CONTRAST_CUES = [
    "but ", "actually", "the truth is", "turns out", "instead", "wrong", "mistake", "nobody talks", "don't realize",
    "dont realize", "counterintuitive", "surprised", "the opposite", "not what you think", "myth", "lie",
]
# Substrings that signal a payoff.
PAYOFF_CUES = [
    "so ", "that's why", "thats why", "which means", "the lesson", "at the end of the day", "that is what",
    "and that's", "and thats", "the point is", "that changed", "ever since", "now i", "the answer",
    "it works because", "that's how", "thats how",
]
# Substrings that refer back.
REFERENCE_CUES = [
    "as i said", "like i said", "as i mentioned", "like i mentioned", "we talked about", "going back to", "earlier i",
    "mentioned earlier", "said earlier", "as we discussed",
]
# First words that lean on what came before.
PRONOUN_OPENERS = ["that", "this", "it", "he", "she", "they", "which", "those", "and", "so"]
# Fillers, counted as whole words.
FILLERS = ["um", "uh", "like", "you know", "kind of", "sort of"]
# Substrings of housekeeping and sponsor reads.
HOUSEKEEPING_CUES = [
    "welcome back to the show", "today we are going to talk about", "before we begin", "subscribe and leave a review",
    "we will be right back", "we'll be right back", "thanks for listening", "now let us get into the conversation",
    "now let's get into the conversation", "this episode is brought to you by", "brought to you by", "sponsored by",
    "use the code", "discount at checkout", "in the episode notes", "in the show notes", "sponsor link",
    "thanks to our sponsor", "support for the show",
]


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(test: str, column: str, cues: list[str]) -> str:
    """SQL, alike in both dialects: some cue passes ``contains`` or ``starts_with``."""
    return "(" + " OR ".join(f"{test}({column}, {quoted(c)})" for c in cues) + ")"


VAGUE = "(o_words <= 9 AND (contains(o, 'that') OR contains(o, 'this') OR contains(o, 'those') OR contains(o, ' it ') OR startswith(o, 'it ')))"

#: Rubric scores and composites over signal columns; the same SQL holds in both engines. Floats add
#: up in this order, which decides ties.
SCORES_SQL = {
    "self_contained": "CASE WHEN reference THEN 2 WHEN pronoun_open THEN 3 WHEN hook THEN 5 ELSE 4 END",
    "opening_strength": "CASE WHEN vague_open THEN 3 WHEN (hook AND question_open) OR absolute_claim THEN 5 WHEN hook THEN 4 ELSE 3 END",
    "specificity": "CASE WHEN repeated_claim OR (has_number AND contrast) THEN 5 WHEN absolute_claim OR has_number OR contrast THEN 4 ELSE 3 END",
    "tension": "CASE WHEN exchange OR (contrast AND question_open) THEN 5 WHEN contrast OR question_open THEN 4 ELSE 3 END",
    "payoff": "CASE WHEN repeated_claim OR (payoff_cue AND end_score >= CAST(2.5 AS FLOAT)) THEN 5 WHEN exchange OR payoff_cue OR end_score >= CAST(2.2 AS FLOAT) THEN 4 ELSE 3 END",
    "clarity": "CASE WHEN filler_rate > CAST(0.09 AS FLOAT) THEN 3 WHEN filler_rate > CAST(0.05 AS FLOAT) THEN 4 ELSE 5 END",
    "context_dependency": "CASE WHEN reference THEN 4 WHEN pronoun_open THEN 3 ELSE 1 END",
    "slop_risk": "1",
}


def f32(x: str, k: str) -> str:
    return f"CAST({x} AS FLOAT) * CAST({k} AS FLOAT)"


COMPOSITE_SQL = (
    " + ".join(f32(c, k) for c, k in (("self_contained", "2.0"), ("payoff", "1.6"), ("opening_strength", "1.4"), ("clarity", "1.2"), ("tension", "1.0"), ("specificity", "0.8")))
    + " - " + f32("context_dependency", "1.5")
)
VALIDATION_SQL = COMPOSITE_SQL + " - " + f32("slop_risk", "2.0")
PROPOSAL_SQL = (
    COMPOSITE_SQL + " + end_score"
    + "".join(f" {sign} CASE WHEN {c} THEN CAST({k} AS FLOAT) ELSE CAST(0 AS FLOAT) END" for sign, c, k in (("+", "repeated_claim", "4.0"), ("+", "exchange", "3.0"), ("+", "absolute_claim", "1.5"), ("-", "vague_open", "4.0")))
    + " + CAST(boost AS FLOAT)"
)
#: Reasons to reject a scored candidate, in order: SQL for the text and for when it holds; durations in ms.
REASONS_SQL = [
    ("'self_contained ' || self_contained || ' is below 4'", "self_contained < 4"),
    ("'payoff ' || payoff || ' is below 3'", "payoff < 3"),
    ("'clarity ' || clarity || ' is below 4'", "clarity < 4"),
    ("'context_dependency ' || context_dependency || ' is above 2'", "context_dependency > 2"),
    ("'slop_risk ' || slop_risk || ' is above 2'", "slop_risk > 2"),
    (
        "'duration ' || cast(floor((end_ms - start_ms) / 1000) AS BIGINT) || 's falls outside 20–90 seconds'",
        "NOT (end_ms - start_ms BETWEEN 20000 AND 90000 OR (end_ms - start_ms BETWEEN 15000 AND 110000 AND payoff >= 4 AND self_contained >= 5 AND clarity >= 4))",
    ),
]
OVERLAP_REASON = "overlaps more than 30% with a higher-ranked clip"
# Words of absolute claims.
ABSOLUTE_WORDS = ["everyone", "everybody", "nobody", "never", "always"]


#: The lists by the names under which ``operators.windows`` looks them up.
CUES = {
    "hook": HOOK_STARTS, "contrast": CONTRAST_CUES, "payoff": PAYOFF_CUES, "reference": REFERENCE_CUES, "pronouns": PRONOUN_OPENERS, "fillers": FILLERS,
    "housekeeping": HOUSEKEEPING_CUES, "absolute": ABSOLUTE_WORDS, "absolute_phrases": ["no one", "all of us"],
}


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, duration_ms, parts) as :func:`best_windows` takes them; features are found there, for all sentences at once."""
    return rows.select("doc_id", "duration_ms", "parts")


def best_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, duration_ms, s, e, start_ms, end_ms, end_score, payoff_cue, ...): the best end of each start that
    has one 20 to 90 s later, the first of equal ends, with the window's signals. Cues match the joined text of
    the window, so one may span sentences; repeated claims and exchanges compare sentences."""
    return windows.windows_of_rows(rows, CUES)


def document_windows(docs: DataFrame) -> DataFrame:
    """:func:`best_windows` of documents (doc_id, text) as timed words; nothing but the text goes to Python."""
    return windows.windows_of_texts(spread(docs.select("doc_id", "text")), CUES, WORD_PITCH_MS, WORD_MS)


def signals(found: DataFrame) -> DataFrame:
    """Windows with the rate of their fillers."""
    return found.withColumn("filler_rate", (F.col("fillers").cast("float") / F.col("words").cast("float")).cast("float"))


def scored(found: DataFrame) -> DataFrame:
    """Windows with an editorial signal and no blocker, with rubric scores and the composite."""
    s = signals(found).where(
        "NOT housekeeping AND NOT (fillers >= 5 AND filler_rate >= CAST(0.08 AS FLOAT))"
        " AND (hook OR contrast OR payoff_cue OR repeated_claim OR exchange OR absolute_claim)"
    )
    for name, sql in SCORES_SQL.items():
        s = s.withColumn(name, F.expr(sql))
    if "boost" not in s.columns:
        s = s.withColumn("boost", F.lit(0.0))
    return s.withColumn("composite", F.expr(PROPOSAL_SQL))


def rejections(column_prefix: str = "") -> str:
    """SQL for the array of reasons that hold."""
    return "filter(array(" + ", ".join(f"CASE WHEN {c} THEN {r} END" for r, c in REASONS_SQL) + "), x -> x IS NOT NULL)"
