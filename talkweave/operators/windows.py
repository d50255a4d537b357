"""Sentences, best windows and their signals over whole Arrow batches.

A window's signals are never read from its text. Each document is gone through once: for a signal, the
sentence where something begins notes the first sentence by which it has ended, and the least of these
from a sentence on tells every window that starts there. So the work grows with the text, not with the
windows, which overlap some ten times over. All arrays run on over the documents of a batch; what
would cross into the next document ends after any window of the one before. Cues are looked for over
arrays of all characters, not sentence by sentence.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.operators.segments import LEAST_MS, MOST_MS, PAUSE_MS, SENTENCE_BYTES, TAIL_MS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that executors need no copy of this library

SLICE_BYTES = 1 << 20  # of text that is worked on at once
SLICE_PAIRS = 1 << 16  # of starts and ends that are scored at once
_SPACE = " \t\n\x0b\f\r"
_TOKEN = re.compile(f"[^{_SPACE}]+")
_MARKS = re.compile(r"^(?:(?!')[\W_])+|(?:(?!')[\W_])+\Z")
_ENDS = r"[.?!…][\"')\]]*$"
_LAST = np.isin(np.arange(256), list(".?!\"')]".encode() + "…".encode()[-1:]))  # bytes that _ENDS can end with
_POINTING = ["that", "this", "those"]


@dataclass
class Sentences:
    """Sentences of many documents, one after another: text and times, and each document's first (one more at the end)."""

    text: pa.Array
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _claims(low: pa.Array) -> pa.Array:
    """Letters and digits, runs of others as one space; the pattern costs some ms to compile, so for many texts at once."""
    return pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{N}]+", " "), characters=" ")


def _sums(x) -> np.ndarray:
    """Sums of what lies before each place, and of all."""
    return np.concatenate(([0], np.cumsum(x, dtype=np.int64)))


def _last_bytes(words: pa.Array) -> np.ndarray:
    """The last byte of each of ``words``, none of which is empty."""
    _, offsets, data = words.buffers()
    upto = np.frombuffer(offsets, np.int32)[words.offset + 1 : words.offset + 1 + len(words)]
    return np.frombuffer(data, np.uint8)[upto - 1]


def split(words: pa.Array, first: np.ndarray, start: np.ndarray, end: np.ndarray, most_bytes: int | None = SENTENCE_BYTES) -> Sentences:
    """Sentences by the rules of :func:`segments.sentence_spans`; ``first`` has each document's first word."""
    if not len(words):
        return Sentences(pa.array([], pa.string()), start, end, np.zeros(len(first), dtype=np.int64))
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = _LAST[_last_bytes(words)]
    ends[ends] = _flags(pc.match_substring_regex(words.filter(pa.array(ends)), _ENDS))
    ends[first[1:][np.diff(first) > 0] - 1] = True
    ends[:-1] |= start[1:] - end[:-1] >= PAUSE_MS
    if most_bytes:
        run = _sums(size + 1)
        last = np.flatnonzero(ends)
        begin = np.concatenate(([0], last[:-1] + 1))
        long = run[last + 1] - run[begin] >= most_bytes
        for a, b in zip(begin[long].tolist(), last[long].tolist()):
            while (cut := a + int(np.searchsorted(run[a + 1 : b + 2], run[a] + most_bytes))) < b:
                ends[cut] = True
                a = cut + 1
    last = np.flatnonzero(ends)
    begin = np.concatenate(([0], last + 1))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), words), " ")
    return Sentences(text, start[begin[:-1]], end[last], np.searchsorted(begin[:-1], first))


def split_texts(texts: pa.Array, pitch_ms: int, word_ms: int) -> Sentences:
    """Sentences of whole texts whose words are spoken at a fixed pitch."""
    listed = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = listed.flatten().cast(pa.string())
    full = _flags(pc.greater(pc.binary_length(words), 0))
    words = words.filter(pa.array(full))
    first = _sums(full)[_sums(pc.list_value_length(listed).to_numpy(zero_copy_only=False))]
    start = (np.arange(len(words), dtype=np.int64) - np.repeat(first[:-1], np.diff(first))) * pitch_ms
    return split(words, first, start, start + word_ms)


def _length_scores() -> np.ndarray:
    """What a window's length adds to its score, by ms from LEAST_MS - 1 to MOST_MS + 1; lengths at both ends don't fit."""
    f = np.float32
    seconds = (np.arange(LEAST_MS - 1, MOST_MS + 2).astype(f).astype(np.float64) / 1000).astype(f)
    off = np.minimum((np.abs(seconds - f(45)).astype(np.float64) / 45).astype(f), f(1))
    out = f(1) - off * f(0.6)
    out[[0, -1]] = -np.inf
    return out


def _best_ends(x: Sentences, terminal: np.ndarray, payoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, score) of the best end, 20 to 90 s later, of each sentence that has one; the first of equals."""
    n, f = len(x.start), np.float32
    doc = x.doc
    same = np.concatenate((doc[1:] == doc[:-1], [False]))
    pause = np.full(n, f(0.5))
    pause[:-1][same[:-1]] = np.where((x.start[1:] - x.end[:-1])[same[:-1]] >= 700, f(0.8), f(0))
    base = np.where(terminal, f(1), f(0)) + np.where(payoff, f(1.4), f(0)) + pause
    # places between which ends may lie: times rise from document to document, and within one as far as they do
    far = int(max(x.end.max(initial=0), x.start.max(initial=0))) + MOST_MS + 1
    at, here = doc * far + x.end, doc * far + x.start
    low = np.maximum(np.searchsorted(np.maximum.accumulate(at), here + LEAST_MS), np.arange(n))
    high = np.minimum(np.searchsorted(np.minimum.accumulate(at[::-1])[::-1], here + MOST_MS, "right"), x.first[1:][doc])
    size = np.maximum(high - low, 0)
    own = np.flatnonzero(size)
    low, size = low[own], size[own]
    upto = _sums(size)
    by_length = _length_scores()
    s, e, score = [], [], []
    a = 0
    while a < len(own):
        b = max(int(np.searchsorted(upto, upto[a] + SLICE_PAIRS, "right")) - 1, a + 1)
        heads, many = upto[a:b] - upto[a], size[a:b]
        j = np.repeat(low[a:b] - heads, many)
        j += np.arange(len(j))
        length = x.end[j]
        length -= np.repeat(x.start[own[a:b]] + (LEAST_MS - 1), many)
        each = base[j] + by_length[np.clip(length, 0, len(by_length) - 1, out=length)]
        top = np.maximum.reduceat(each, heads)
        won = np.flatnonzero(each == np.repeat(top, many))
        i = np.searchsorted(heads, won, "right") - 1
        one = np.concatenate(([True], i[1:] != i[:-1])) & (top[i] > -np.inf)
        s.append(own[a:b][i[one]])
        e.append(j[won[one]])
        score.append(top[i[one]])
        a = b
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *s]), np.concatenate([none, *e]), np.concatenate([none.astype(f), *score])


def _points(low: str) -> bool:
    """Some word points at something unsaid."""
    return "that" in low or "this" in low or "those" in low or " it " in low or low.startswith("it ")


def _chars(codes: np.ndarray) -> np.ndarray:
    """Characters as bytes, 255 for what is beyond; cues are ASCII."""
    return np.minimum(codes, 255).astype(np.uint8)


def _fours(chars: np.ndarray) -> np.ndarray:
    """At each place the four characters from there on, as one number; the last three places have none."""
    return np.ndarray(len(chars) - 3, "<u4", chars, strides=(1,)).copy()


def _hashed(fours: np.ndarray) -> np.ndarray:
    return (fours * np.uint32(2654435761)) >> np.uint32(16)


def _key(part: str) -> int:
    return int.from_bytes(part.encode("ascii"), "little")


def _standing(fours: np.ndarray, at: np.ndarray, begins: np.ndarray, cue: str) -> np.ndarray:
    """Those of the places ``at``, by number, at which the cue stands; ``begins`` has the four characters there."""
    mask = np.uint32((1 << 8 * min(len(cue), 4)) - 1)
    left = np.flatnonzero(begins & mask == np.uint32(_key(cue[:4])))
    for k in [*range(4, len(cue) - 4, 4), len(cue) - 4]:
        if k > 0:
            left = left[fours[at[left] + k] == np.uint32(_key(cue[k : k + 4]))]
    return left


class _Text:
    """Sentences' lower-case texts run together by single spaces, as in a window: arrays over all characters, between
    spaces at both ends. ``first`` has each sentence's first place (one more at the end), ``end`` that after its last."""

    PAD = 64  # more than any cue has

    def __init__(self, text: pa.Array):
        size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        full = text if size.all() else text.filter(pa.array(size > 0))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(full)], pa.int32()), full), " ")[0].as_py()
        self.low = " " + joined.lower() + " " * self.PAD
        if len(self.low) != 1 + len(joined) + self.PAD:
            size[size > 0] = [len(t.lower()) for t in full.to_pylist()]
        self.first = 1 + _sums(size + (size > 0))
        self.end = self.first[:-1] + size
        self.codes = np.frombuffer(self.low.encode("utf-32-le"), "<u4")
        self.chars = _chars(self.codes)
        self.fours = _fours(self.chars)
        self.space = (self.chars == 32) | (self.chars - np.uint8(9) < 5)
        turns = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        self.words, self.word_ends = turns[::2], turns[1::2]

    def upto(self, places: np.ndarray) -> np.ndarray:
        """How many of the places lie before each sentence, and in all."""
        return np.searchsorted(places, self.first)

    def sentence(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[:-1], places, "right") - 1

    def find(self, cues: list[str]) -> dict[str, np.ndarray]:
        """Every place of every cue."""
        some = np.zeros(1 << 16, dtype=bool)
        some[_hashed(np.array([_key(c[:4]) for c in cues if len(c) >= 4], dtype=np.uint32))] = True
        likely = np.flatnonzero(some[_hashed(self.fours[: len(self.low) - self.PAD])])
        begins = self.fours[likely]
        last = len(self.low) - self.PAD
        out = {}
        for cue in dict.fromkeys(cues):
            if len(cue) < 4:
                at = np.flatnonzero(self.fours & np.uint32((1 << 8 * len(cue)) - 1) == np.uint32(_key(cue)))
            else:
                at = likely[_standing(self.fours, likely, begins, cue)]
            out[cue] = at[at + len(cue) <= last]
        return out

    def spans(self, found: dict[str, np.ndarray], cues: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sentence in which each place of the cues begins and that in which it ends. The space
        before a sentence is there only with that sentence."""
        begin = np.concatenate([found[c] for c in cues])
        end = np.concatenate([found[c] + len(c) - 1 for c in cues])
        return self.sentence(begin), np.searchsorted(self.first[:-1] - 1, end, "right") - 1

    def opens(self, at: np.ndarray, end: np.ndarray, cues: list[str], whole: bool = False) -> np.ndarray:
        """Whether some cue stands at each place and ends by ``end``; ``whole``: before white space."""
        out = np.zeros(len(at), dtype=bool)
        begins = self.fours[at]
        for cue in cues:
            some = _standing(self.fours, at, begins, cue)
            some = some[at[some] + len(cue) <= end[some]]
            out[some[self.space[at[some] + len(cue)]] if whole else some] = True
        return out


class _Claims:
    """Sentences' claims (letters and digits, runs of others as one space) run together, each word before a space.
    ``first`` has each claim's first place and ``upto`` its first word (one more at the end)."""

    def __init__(self, x: _Text):
        held = (x.chars - np.uint8(97) < 26) | (x.chars - np.uint8(48) < 10)
        beyond = np.flatnonzero(x.chars > 127)
        kinds, which = np.unique(x.codes[beyond], return_inverse=True)
        held[beyond] = _flags(pc.match_substring_regex(pa.array([chr(k) for k in kinds.tolist()], pa.string()), r"[\p{L}\p{N}]"))[which]
        kept = held.copy()
        kept[1:] |= held[:-1]
        kept = np.flatnonzero(kept)
        self.first = np.searchsorted(kept, x.first)
        codes = np.where(held, x.codes, np.uint32(32))[kept]
        chars = _chars(np.pad(codes, (0, _Text.PAD)))
        self.fours = _fours(chars)
        spaces = np.flatnonzero(chars == 32)
        self.words = np.concatenate(([0], spaces + 1))[:-1]
        self.upto = np.searchsorted(self.words, self.first)
        self.counts = np.diff(self.upto)
        codes[self.first[self.first > 0] - 1] = 10
        self.text = codes.astype("<u4").tobytes().decode("utf-32-le")
        self.begins = self.fours[self.words]

    def said(self, phrase: str) -> tuple[np.ndarray, np.ndarray]:
        """How often the phrase in whole words has begun before each sentence, and how often it has ended."""
        key = phrase + " "
        at = self.words[_standing(self.fours, self.words, self.begins, key)]
        return np.searchsorted(at, self.first), np.searchsorted(at + len(phrase) - 1, self.first)

    def unique(self, doc: np.ndarray) -> np.ndarray:
        """Claims that the twelve characters after their first word show to be held by no other of their document."""
        out = np.zeros(len(self.counts), dtype=bool)
        some = np.flatnonzero(self.counts >= 3)
        second = self.upto[some] + 1
        h = np.repeat(doc.astype(np.uint32) * np.uint32(0x9E3779B1), self.counts) ^ self.begins
        for k in (4, 8):
            h = (h * np.uint32(0x85EBCA6B)) ^ (h >> np.uint32(15)) ^ self.fours[self.words + k]
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(11)).astype(np.int64)
        alone = np.bincount(h, minlength=1 << 21)[h[second]] == 1
        out[some[alone & (self.first[some + 1] - 1 - self.words[second] >= 12)]] = True
        return out


def first_end(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` sentences, the first by which a span (begun in ``i``, ended in ``j``) that begins there or later has ended."""
    out = np.full(n, n, dtype=np.int64)
    np.minimum.at(out, i, j)
    return np.minimum.accumulate(out[::-1])[::-1]


def _repeats(claims: _Claims, doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """:func:`first_end` of pairs of claims, one of which (three words or more) holds the other, looked for only
    where a window holds both: from each the next that holds it, and the last before that does."""
    n = len(doc)
    reach, back = np.full(n, -1), np.full(n, n)
    reach[s] = e
    np.minimum.at(back, e, s)
    reach, back = np.maximum.accumulate(reach), np.minimum.accumulate(back[::-1])[::-1]
    whole = np.arange(n)
    sought = (claims.counts >= 3) & ((reach > whole) | (back < whole)) & ~claims.unique(doc)
    text, pos = claims.text, claims.first.tolist()
    i, j = [], []
    for k, r, b in zip(*(x[sought].tolist() for x in (whole, reach, back))):
        claim = text[pos[k] : pos[k + 1] - 1]
        if r > k and (p := text.find(claim, pos[k + 1], max(pos[r + 1] - 1, 0))) >= 0:
            i.append(k)
            j.append(bisect_right(pos, p) - 1)
        if b < k and (p := text.rfind(claim, pos[b], max(pos[k] - 1, 0))) >= 0:
            i.append(bisect_right(pos, p) - 1)
            j.append(k)
    return first_end(n, np.array(i, dtype=np.int64), np.array(j, dtype=np.int64))


#: What :func:`measured` gives for each window, with Spark's types.
COLUMNS = (
    "s int, e int, start_ms bigint, end_ms bigint, end_score float, payoff_cue boolean, words int, fillers int, vague_open boolean, hook boolean, contrast boolean,"
    " reference boolean, pronoun_open boolean, question_open boolean, has_number boolean, repeated_claim boolean, exchange boolean, absolute_claim boolean, housekeeping boolean"
)


def measured(x: Sentences, cues: dict[str, list[str]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Each window's document, and its columns. ``cues`` has the lists of ``operators.signals`` by name."""
    n = len(x.start)
    text = _Text(x.text)
    claims = _Claims(text)
    found = text.find([*_POINTING, " it ", *(c for k in ("payoff", "contrast", "reference", "housekeeping", "absolute") for c in cues[k])])
    i, j = text.spans(found, cues["payoff"])
    pays = np.zeros(n, dtype=bool)
    pays[i[i == j]] = True
    last = text.end - 1
    while (blank := (last >= text.first[:-1]) & (text.chars[last] == 32)).any():
        last -= blank
    s, e, score = _best_ends(x, np.isin(text.codes[last], [ord(c) for c in ".?!…"]) & (last >= text.first[:-1]), pays)
    doc = x.doc[s]
    head = x.first[:-1][doc]

    def within(kind: str) -> np.ndarray:
        return first_end(n, *text.spans(found, cues[kind]))[s] <= e

    def said(phrases: list[str]) -> np.ndarray:
        """How often a window's claims, run together, say some of the phrases in whole words."""
        total = np.zeros(len(s), dtype=np.int64)
        for begun, ended in map(claims.said, phrases):
            total += np.maximum(ended[e + 1] - begun[s], 0)
        return total

    absolute = np.zeros(n, dtype=bool)
    for cue in cues["absolute"]:
        at = found[cue]
        plain = text.space[at - 1] & text.space[at + len(cue)]
        absolute[text.sentence(at[plain])] = True
        for w in set((np.searchsorted(text.words, at[~plain], "right") - 1).tolist()):
            if _MARKS.sub("", text.low[text.words[w] : text.word_ends[w]]) in cues["absolute"]:
                absolute[text.sentence(text.words[w])] = True
    absolute = _sums(absolute)
    words = text.upto(text.words)
    n_words = np.diff(words)
    digits = text.upto(np.flatnonzero(text.chars - np.uint8(48) < 10))
    asks = np.diff(text.upto(np.flatnonzero(text.chars == ord("?")))) > 0
    reacts = np.zeros(n, dtype=bool)
    reacts[:-1] = asks[:-1] & (n_words[1:] <= 12) & (x.start[1:] - x.end[:-1] <= 1500)
    reacts = _sums(reacts)
    points = np.zeros(n, dtype=bool)
    for cue in _POINTING:
        points[text.sentence(found[cue])] = True
    at = found[" it "] + 1
    i = text.sentence(at)
    points[i[at + 2 < text.end[i]]] = True
    vague = ((n_words <= 9) & points)[s]
    opener, end = text.first[s], text.end[s]
    first = np.append(text.words, 0)[words[s]]
    first = np.where(n_words[s] > 0, first, end)
    before = np.maximum(e - 1, head)
    return doc, {
        "s": s - head,
        "e": e - head,
        "start_ms": x.start[s],
        "end_ms": x.end[e],
        "end_score": score,
        "payoff_cue": pays[e] | pays[before],
        "words": np.maximum(words[e + 1] - words[s], 1),
        "fillers": said(cues["fillers"]),
        "vague_open": vague,
        "hook": text.opens(opener, end, cues["hook"]) | asks[s],
        "contrast": within("contrast"),
        "reference": within("reference"),
        "pronoun_open": text.opens(first, end, cues["pronouns"], whole=True) | vague,
        "question_open": text.opens(first, end, ["what", "why", "how", "who", "when"], whole=True) | asks[s],
        "has_number": digits[e + 1] > digits[s],
        "repeated_claim": _repeats(claims, x.doc, s, e)[s] <= e,
        "exchange": reacts[e] > reacts[s],
        "absolute_claim": (absolute[e + 1] > absolute[s]) | (said(cues["absolute_phrases"]) > 0),
        "housekeeping": within("housekeeping"),
    }


def appealing(x: Sentences, s: np.ndarray, e: np.ndarray, cues: dict[str, list[str]]) -> list[str]:
    """The best of each window's first five sentences as a headline: one whose claim (three words or more) another
    sentence of the window holds, an absolute claim, a question, a short one, no vague opener; the last of equals."""
    size = e - s + 1
    upto = _sums(size)
    own = x.text.take(pa.array(np.repeat(s - upto[:-1], size) + np.arange(upto[-1])))
    texts = own.to_pylist()
    lows = [t.lower() for t in texts]
    normed = _claims(pa.array(lows, pa.string())).to_pylist()
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        text, low, claims = texts[a:b], lows[a:b], normed[a:b]
        best = (-99, 0)
        for i, (t, o, claim) in enumerate(zip(text[:5], low[:5], claims[:5])):
            words = _TOKEN.findall(o)
            held = claim.count(" ") >= 2 and any(claim in c for j, c in enumerate(claims) if j != i)
            absolute = any(_MARKS.sub("", w) in cues["absolute"] for w in words) or any(f" {p} " in f" {claim} " for p in cues["absolute_phrases"])
            points = 5 * held + 3 * absolute + 2 * ("?" in t) + (3 <= len(words) <= 16) - 3 * (len(words) <= 9 and _points(o))
            best = max(best, (points, i))
        out.append(text[best[1]])
    return out


def _sliced(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about SLICE_BYTES; rows stay whole."""
    for batch in batches:
        upto = _sums(pc.fill_null(size(batch), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(batch):
            b = max(int(np.searchsorted(upto, upto[a] + SLICE_BYTES, "right")) - 1, a + 1)
            yield batch.slice(a, b - a)
            a = b


def _rows(ids: pa.Array, duration: pa.Array, x: Sentences, cues: dict[str, list[str]]) -> pa.RecordBatch:
    doc, found = measured(x, cues)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "boolean": pa.bool_()}
    own = {name: pa.array(found[name]).cast(kinds[kind]) for name, kind in (c.split() for c in COLUMNS.split(","))}
    return pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(doc)), "duration_ms": duration.take(pa.array(doc)), **own})


def _schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, duration_ms bigint, {COLUMNS}"


def windows_of_rows(rows: DataFrame, cues: dict[str, list[str]]) -> DataFrame:
    """Windows of ``rows`` (doc_id, duration_ms, parts), parts with text, start_ms and end_ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, lambda b: pc.multiply(pc.list_value_length(b["parts"]), SENTENCE_BYTES)):
            first = _sums(pc.fill_null(pc.list_value_length(b["parts"]), 0).to_numpy(zero_copy_only=False))
            text, start, end = b["parts"].flatten().flatten()
            x = Sentences(pc.fill_null(text, ""), start.to_numpy(zero_copy_only=False), end.to_numpy(zero_copy_only=False), first)
            yield _rows(b["doc_id"], b["duration_ms"], x, cues)

    part = F.transform("parts", lambda x: F.struct(x["text"].alias("text"), x["start_ms"].cast("long").alias("start_ms"), x["end_ms"].cast("long").alias("end_ms")))
    return rows.select("doc_id", F.col("duration_ms").cast("long").alias("duration_ms"), part.alias("parts")).mapInArrow(run, _schema(rows))


def windows_of_texts(docs: DataFrame, cues: dict[str, list[str]], pitch_ms: int, word_ms: int) -> DataFrame:
    """Windows of ``docs`` (doc_id, text), whose words are spoken at a fixed pitch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, lambda b: pc.binary_length(b["text"])):
            x = split_texts(b["text"], pitch_ms, word_ms)
            last = x.first[1:] - 1
            full = last >= x.first[:-1]
            duration = pa.array(np.append(x.end, 0)[last] + TAIL_MS, pa.int64(), mask=~full)
            yield _rows(b["doc_id"], duration, x, cues)

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs))


def shown_of_texts(docs: DataFrame, cues: dict[str, list[str]], pitch_ms: int, word_ms: int) -> DataFrame:
    """``docs`` (doc_id, text, chosen), chosen an array of structs with s and e, as one row for each of these:
    (doc_id, x, best, opening, closing), x the struct and the rest the texts of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, lambda b: pc.binary_length(b["text"])):
            x = split_texts(b["text"], pitch_ms, word_ms)
            doc, chosen = pc.list_parent_indices(b["chosen"]), b["chosen"].flatten()
            head = x.first[doc.to_numpy(zero_copy_only=False)]
            s, e = (head + chosen.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e"))
            best = pa.array(appealing(x, s, e, cues), pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].take(doc), "x": chosen, "best": best, "opening": x.text.take(pa.array(s)), "closing": x.text.take(pa.array(e))})

    kind = docs.schema["chosen"].dataType.elementType.simpleString()
    return docs.select("doc_id", "text", "chosen").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x {kind}, best string, opening string, closing string")
