"""Chat formatting: a state machine over roles checks turn order; a template gives marked segments."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each turn, which roles are learnt, and which role may follow which.

    ``marks`` maps a role to what opens and closes its turns. Any other role is written between
    ``other[0]`` and ``other[1]``, its turn closed by ``other[2]``. ``after`` maps a state (the last
    role; "" at the start) to the roles allowed next; ``final`` are the states to end in. Control
    strings never hold the escape character, nor begin with what they end with, so none can arise
    where a text meets a mark.
    """

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    learnt: frozenset[str]
    after: dict[str, frozenset[str]]
    final: frozenset[str]
    controls: tuple[str, ...]
    escape: str = field(default="\\")

    def escaped(self, text: Column) -> Column:
        """Doubles the escape character, then breaks each control string after its first character."""
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(c[0] + self.escape + c[1:]))
        return out

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(" + re.escape(self.escape) + ")?", lambda m: m[1] or "", text)


INSTRUCTION_TEMPLATE = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>\n"), "user": ("[INST]", "[/INST]\n"), "assistant": ("<s>", "</s>\n")},
    other=("<role>", "</role>", "</turn>\n"),
    learnt=frozenset({"assistant"}),
    after={
        "": frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"}),
    },
    final=frozenset({"assistant"}),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<role>", "</role>", "</turn>"),
)


def format_chats(
    turns: DataFrame,
    template: Template = INSTRUCTION_TEMPLATE,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: (conv_id, seq, role, state_before, in_order, ends_well, segments).

    ``segments`` is an array of (text, loss): the opening mark, the escaped text, the closing mark.
    Joined by ``seq`` (1, 2, ... in each conversation) they are the formatted conversation; nothing
    stands between turns. The state machine's state is the role before, so ``in_order`` needs one
    look back; ``ends_well`` says, on a conversation's last turn, whether the machine may stop there
    (null on others). Turns out of order are marked, not dropped. A conversation stays one row for
    each turn: however long it is, no task holds it as one value.

    Defined results: null texts and null roles are empty strings; a role that the template doesn't
    know is written out, escaped, between marks of its own and is never in order; turns are sorted
    by turn number (null first), then role, then text, so ties and repeated rows have one order and
    all stay; a text of any length is one segment; a null conversation id is a conversation; other columns, whatever their names, are
    neither read nor returned; an empty table gives no rows.
    """
    t = template
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    in_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    state = F.coalesce(F.lag("role").over(in_turn), F.lit(""))
    rows = rows.select(
        "conv_id",
        F.row_number().over(in_turn).cast("long").alias("seq"),
        "role",
        state.alias("state_before"),
        F.lead("role").over(in_turn).isNull().alias("last"),
        "text",
    )
    allowed = F.lit(False)
    for before, after in t.after.items():
        first = (F.col("seq") == 1) if before == "" else (F.col("seq") > 1)
        allowed = allowed | (first & (F.col("state_before") == before) & F.col("role").isin(*after))
    opening = F.concat(F.lit(t.other[0]), t.escaped(F.col("role")), F.lit(t.other[1]))
    closing = F.lit(t.other[2])
    for role, (begin, end) in t.marks.items():
        opening = F.when(F.col("role") == role, F.lit(begin)).otherwise(opening)
        closing = F.when(F.col("role") == role, F.lit(end)).otherwise(closing)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return rows.select(
        "conv_id",
        "seq",
        "role",
        "state_before",
        allowed.alias("in_order"),
        F.when(F.col("last"), F.col("role").isin(*t.final)).alias("ends_well"),
        F.array(
            segment(opening, F.lit(False)),
            segment(t.escaped(F.col("text")), F.col("role").isin(*t.learnt)),
            segment(closing, F.lit(False)),
        ).alias("segments"),
    )


def read_back(formatted: DataFrame, template: Template = INSTRUCTION_TEMPLATE) -> DataFrame:
    """What a reader finds in the formatted text: a row per conversation with digests.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, well_formed,
    in_order. Turns are found by the marks in the text alone; the roles that ``format_chats`` had in
    hand are not looked at. Each conversation's pieces pass in order through one running parse, so
    memory holds one batch and an unfinished turn, never a conversation. A conversation is read by one
    task, as its digest is of all turns in order: its time is bounded by its own length.

    Defined results: a text that does not parse is counted as no turn and makes ``well_formed`` false;
    a null conversation id is a conversation; turns of any length, empty ones and repeated rows count
    as they stand; other columns are not read; an empty table gives no rows.
    """
    pieces = (
        formatted.select("conv_id", "seq", "segments", "in_order")
        .repartition(F.col("conv_id"))
        .sortWithinPartitions("conv_id", "seq")
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "").alias("loss"),
            "in_order",
        )
    )
    kind = formatted.schema["conv_id"].dataType.simpleString()
    out = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, well_formed boolean, in_order boolean"
    )
    t = template
    ways = [f"{re.escape(b)}(?P<t{i}>.*?){re.escape(e)}" for i, (b, e) in enumerate(t.marks.values())]
    ways.append(f"{re.escape(t.other[0])}(?P<role>.*?){re.escape(t.other[1])}(?P<other>.*?){re.escape(t.other[2])}")
    turn = re.compile("|".join(ways), re.DOTALL)
    roles = list(t.marks)

    class Reading:
        def __init__(self) -> None:
            self.n = self.loss_chars = self.chars = 0
            self.turns, self.loss, self.rest, self.ok, self.order = hashlib.sha256(), hashlib.sha256(), "", True, True

        def add(self, text: str, loss: str, in_order: bool) -> None:
            self.chars += len(text)
            self.order &= bool(in_order)
            plain = t.unescaped(loss)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
            self.rest += text
            at = 0
            while m := turn.match(self.rest, at):
                at = m.end()
                k = m.lastgroup
                role, body = (t.unescaped(m["role"]), m["other"]) if k == "other" else (roles[int(k[1:])], m[k])
                self.turns.update(f"{role}\n{t.unescaped(body)}\n".encode())
                self.n += 1
            self.rest = self.rest[at:]

        def row(self) -> tuple:
            return (self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok and not self.rest, self.order)

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "well_formed", "in_order"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, reading = None, None
        key_type = None
        done: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*done))
            arrays = [pa.array(cols[0], key_type)] + [pa.array(c) for c in cols[1:]]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names])

        for b in batches:
            key_type = b.schema.field("conv_id").type
            for key, text, loss, order in zip(*(b.column(i).to_pylist() for i in range(4))):
                if reading is None or key != of:
                    if reading is not None:
                        done.append((of, *reading.row()))
                    of, reading = key, Reading()
                reading.add(text, loss, order)
            if len(done) >= 4096:
                yield emit()
        if reading is not None:
            done.append((of, *reading.row()))
        if done:
            yield emit()

    return pieces.mapInArrow(parse, out)
