"""SentencePiece encoding and decoding by a table of distinct marked words.

Where no piece holds a white-space marker after another character, pieces never cross from one
marked word (a run of markers and the characters up to the next marker) into the next, so a word is
segmented alike wherever it stands. Each distinct word is then segmented once for each table and its
ids are joined back by position. A vocabulary with crossing pieces is encoded text by text.

The table belongs to a task and starts anew at a stated size, so memory is bounded and nothing is
shuffled; a corpus-wide table would move every word of every text to look it up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.llm._shared import spare_name

MARK = "▁"
TABLE_WORDS = 300_000  # entries, each a word and its place, after which a task's table starts anew
BATCH_BYTES = 4 << 20  # of ids or text, after which a result batch is handed on

_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def words_are_apart(model) -> bool:
    """Whether no piece has a marker after another character, and spaces pass unchanged.

    A lone marker must be a piece. The rest is a probe of the normalizer: spaces at either end and in
    runs must survive, and exactly one marker must be put in front.
    """
    crossing = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    probe = "".join(model.encode("  a  b ", out_type=str))
    return not crossing and model.piece_to_id(MARK) != model.unk_id() and probe == f"{MARK * 3}a{MARK * 2}b{MARK}"


class WordTable:
    """Ids of marked words, each segmented once; ``encode`` gives a text's ids with begin and end."""

    def __init__(self, model, limit: int = TABLE_WORDS):
        self.model, self.limit = model, limit
        self.apart = words_are_apart(model)
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _add(self, new: list[str]) -> None:
        # the library puts one marker in front, which the word has already
        for word, ids in zip(new, self.model.encode([w[1:] for w in new], num_threads=1)):
            if word == MARK:  # the library gives no id for an empty text
                ids = [self.model.piece_to_id(MARK)]
            at = self.places[word] = len(self.places)
            if at == len(self.starts):
                self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.starts[at], self.counts[at] = self.used, len(ids)
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def encode(self, text: str) -> np.ndarray:
        begin, end = self.model.bos_id(), self.model.eos_id()
        if not text or not self.apart:
            return np.array([begin, *self.model.encode(text), end], np.uint32)
        words = _MARKED.findall(MARK + text.replace(" ", MARK))
        if len(self.places) > self.limit:
            self._clear()
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if new:
            self._add(new)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) + 2, np.uint32)
        out[0], out[-1] = begin, end
        # gather every word's run of ids
        out[1:-1] = self.ids[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1])]
        return out


def _appended(df: DataFrame, name: str, kind: str, source: str, made) -> DataFrame:
    """``df`` with a column that ``made()``, called in each task, computes value by value."""
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{source}`").alias("value"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, made {kind}"
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = made()
        for b in batches:
            values, held, first = [], 0, 0
            for i in range(b.num_rows):
                values.append(one(b.column(1)[i].as_py()))
                held += len(values[-1])
                if held >= BATCH_BYTES or i + 1 == b.num_rows:
                    rows_ = b.column(0).slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([rows_, pa.array(values, arrow)], names=["row", "made"])
                    values, held, first = [], 0, i + 1

    return rows.mapInArrow(run, schema).select("row.*", F.col("made").alias(name))


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col``: the text's ids, begin and end included, as little-endian uint32 bytes.

    Ids are the library's own for the whole text without sampling. Defined results: a null text is
    an empty text (begin and end only); a very long text, and a very long word, is encoded whole; the
    library settles ties between segmentations; rows, repeated or with nulls elsewhere, stay as they
    are, with all columns; a name that ``df`` already has, whatever the case, is an error; an empty
    table gives no rows.
    """
    if spare_name(df, out_col) != out_col:
        raise ValueError(f"column {out_col} exists")

    def made():
        table = WordTable(_model(model_path))
        return lambda text: table.encode(text or "").astype("<u4", copy=False).tobytes()

    return _appended(df, out_col, "binary", text_col, made)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the library's decoding of the packed ids.

    Defined results: null and empty ids give an empty text; ids of any length are decoded whole; rows,
    repeated or with nulls elsewhere, stay as they are; a name that ``df`` has is an error; an empty table gives no rows.
    """
    if spare_name(df, out_col) != out_col:
        raise ValueError(f"column {out_col} exists")

    def made():
        model = _model(model_path)
        return lambda ids: model.decode(np.frombuffer(ids or b"", "<u4").tolist()) if ids else ""

    return _appended(df, out_col, "string", ids_col, made)
