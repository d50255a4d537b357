"""Caption events and subtitle documents. All of one transcript's work stays in its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import alnum_length, subtitle_escape, subtitle_time
from talkweave.operators.series import clean_spans, impact_spans

WHITE = "FFFFFF"
IMPACT_ACCENT, CLEAN_ACCENT = "00DDFF", "24B2FF"
IMPACT_PAD_MS, CLEAN_PAD_MS, HEADLINE_MS, LEAST_MS = 200, 160, 3500, 10
OPENING_WORDS, OPENING_SHARE = 14, 0.7

# Fields and styles of the subtitle format.
FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
CLEAN_STYLES = [
    ("Caption", "66,&H00FFFFFF,&H00FFFFFF,&H00141414,&H7A000000,-1,0,0,0,100,100,0,0,1,3.4,1.2,2,90,90,400,1"),
    ("Headline", "42,&H00F2F2F2,&H00FFFFFF,&H00141414,&H7A000000,-1,0,0,0,100,100,0,0,1,2.6,1,8,110,110,110,1"),
]
IMPACT_STYLE = ("Impact", "84,&H00FFFFFF,&H00FFFFFF,&H00000000,&H9C000000,-1,0,0,0,100,100,1,0,1,3.2,3.6,5,60,60,60,1")

# Sizes, widths of a character, and places of the lines with a large word.
SMALL, SMALL_FLOOR, LARGE, LARGE_FLOOR = 70.0, 46.0, 150.0, 92.0
EM_UPPER, EM_LOWER, LINE_WIDTH, PITCH, LEAN = 0.62, 0.55, 940.0, 1.04, 34.0
ANCHOR_Y, TOP, BOTTOM = 1270.0, 920.0, 1640.0

# Words too common to be shown large.
COMMON_WORDS = """
the a an and or but so of to in on at is are was
were be been it its it's that that's this these if you
your you're we we're i i'm he she they them their there
there's like just really very what what's when how why would
could can can't will won't because about for with as do did
does don't have has had not no yes my me us our than
then get got go going gonna all any some one out up down
now well
""".split()


def _header(title: str, styles: list[str]) -> str:
    info = ["[Script Info]", f"Title: captions ({title})", "ScriptType: v4.00+", "PlayResX: 1080", "PlayResY: 1920", "WrapStyle: 2", "ScaledBorderAndShadow: yes", ""]
    return "\n".join([*info, "[V4+ Styles]", f"Format: {FIELDS}", *styles, "", "[Events]", f"Format: {EVENT_FIELDS}", ""])


def clean_header(font: str = "Inter") -> str:
    return _header("clean", [f"Style: {name},{font},{rest}" for name, rest in CLEAN_STYLES])


def impact_header(font: str = "Inter") -> str:
    face = "Inter ExtraBold" if font == "Inter" else font
    return _header("impact", [f"Style: {IMPACT_STYLE[0]},{face},{IMPACT_STYLE[1]}"])


def plain_words(text: Column) -> Column:
    """Lower-case alphanumeric cores of the words of a text, without empty ones."""
    cores = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(cores, lambda w: w != "")


def shows_headline(headline: Column, words: Column) -> Column:
    """Whether a headline says more than the first 14 words: under 70 % of its words are among them.

    Null and blank headlines, and those without a letter or digit, are not shown.
    """
    said = plain_words(F.coalesce(headline, F.lit("")))
    opening = F.flatten(F.transform(F.slice(words, 1, OPENING_WORDS), lambda w: plain_words(w["text"])))
    held = F.size(F.filter(said, lambda w: F.array_contains(opening, w)))
    return F.coalesce(F.try_divide(held.cast("float"), F.size(said).cast("float")) < F.lit(OPENING_SHARE).cast("float"), F.lit(False))


def relative_words(words: Column, clip_start: Column) -> Column:
    """Words timed from the clip's start, none before 0. A word without length gets 10 ms and pushes
    the next one's start to its end, and that one's end to 10 ms after its start."""
    moved = F.transform(
        words,
        lambda w: w.withField("start_ms", F.greatest(w["start_ms"] - clip_start, F.lit(0).cast("long"))).withField(
            "end_ms", F.greatest(w["end_ms"] - clip_start, F.lit(0).cast("long"))
        ),
    )

    def step(out: Column, w: Column) -> Column:
        before = F.try_element_at(out, F.lit(-1))
        pushed = F.coalesce(before["fixed"], F.lit(False))
        start = F.when(pushed, F.greatest(w["start_ms"], before["w"]["end_ms"])).otherwise(w["start_ms"])
        end = F.when(pushed, F.greatest(w["end_ms"], start + LEAST_MS)).otherwise(w["end_ms"])
        fixed = end <= start
        one = F.struct(w.withField("start_ms", start).withField("end_ms", F.when(fixed, start + LEAST_MS).otherwise(end)).alias("w"), fixed.alias("fixed"))
        return F.concat(out, F.array(one))

    zero = F.filter(F.transform(moved, lambda w: F.struct(w.alias("w"), F.lit(True).alias("fixed"))), lambda x: F.lit(False))
    repaired = F.transform(F.aggregate(moved, zero, step), lambda x: x["w"])
    return F.when(F.exists(moved, lambda w: w["end_ms"] <= w["start_ms"]), repaired).otherwise(moved)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _page_events(words: Column, span: Column, page_no: Column, clip_len: Column, accent: str, style: str, pad: int) -> Column:
    """For each word of a page and each of its lines the time it is spoken, and a neutral line up to the next word."""
    page = F.slice(words, span["first"] + 1, span["last"] - span["first"] + 1)
    over = F.get(words, span["last"])["end_ms"]
    ceiling = F.least(over + pad, F.get(words, span["last"] + 1)["start_ms"], F.greatest(clip_len, over))
    lines = lockup(page, page_no) if style == "Impact" else F.array(_line(F.lit(0), F.size(page) - 1, F.lit(False), F.lit(0.0)))

    def shown(v: Column, line: Column) -> Column:
        text = subtitle_escape(v["text"])
        return F.when(line["emphasis"], F.upper(text)).otherwise(F.lower(text)) if style == "Impact" else text

    def at(line: Column, first: Column | None) -> Column:
        if style != "Impact":
            return F.lit("")
        place = F.format_string("{\\an5\\pos(%.0f,%.0f)\\fs%.0f\\blur0.6", line["x"], line["y"], line["fs"])
        size = F.when(line["emphasis"], "85").otherwise("90")
        grow = F.concat(F.lit("\\fscx"), size, F.lit("\\fscy"), size, F.lit("\\t(0,110,\\fscx100\\fscy100)"))
        return F.concat(place, F.when(first, grow).otherwise("") if first is not None else F.lit(""), F.lit("}"))

    def spoken(lines: Column, w: Column, i: Column) -> Column:
        until = F.coalesce(F.get(page, i + 1)["start_ms"], ceiling)
        end = F.least(F.greatest(w["end_ms"], w["start_ms"] + LEAST_MS), until)

        def on_line(line: Column) -> Column:
            own = F.slice(page, line["first"] + 1, line["last"] - line["first"] + 1)

            def word(v: Column, j: Column) -> Column:
                lit = F.concat(F.lit(f"{{\\c&H{accent}&}}"), shown(v, line), F.lit(f"{{\\c&H{WHITE}&}}"))
                return F.when(i == j + line["first"], lit).otherwise(shown(v, line))

            said = F.concat(at(line, i == 0), F.array_join(F.transform(own, word), " "))
            rest = F.concat(at(line, None), F.array_join(F.transform(own, lambda v: shown(v, line)), " "))
            return F.array(
                F.struct(w["start_ms"].alias("start_ms"), end.alias("end_ms"), F.lit(style).alias("style"), said.alias("text")),
                F.struct(end.alias("start_ms"), until.alias("end_ms"), F.lit(style).alias("style"), rest.alias("text")),
            )

        events = F.flatten(F.transform(lines, on_line))
        return F.filter(events, lambda e: (end > w["start_ms"]) & (e["end_ms"] > e["start_ms"]))

    return _bound(lines, lambda ls: F.flatten(F.transform(page, lambda w, i: spoken(ls, w, i))))


def _line(first: Column, last: Column, emphasis: Column, fs: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), emphasis.alias("emphasis"), fs.cast("double").alias("fs"))


def emphasis_word(page: Column) -> Column:
    """Place of the word to show large: the last of 5 characters or more that isn't common, else of 3
    or more, else the longest (the last of several)."""

    def last_of(least: int) -> Column:
        held = F.transform(page, lambda w, i: F.when((alnum_length(w["text"]) >= least) & ~F.array_contains(F.array(*map(F.lit, COMMON_WORDS)), F.lower(F.regexp_replace(w["text"], r"[^\p{L}\p{N}']", ""))), i))
        return F.array_max(held)

    longest = F.array_max(F.transform(page, lambda w, i: F.struct(alnum_length(w["text"]).alias("n"), i.alias("i"))))["i"]
    return F.coalesce(last_of(5), last_of(3), longest, F.lit(0))


def _line_bytes(page: Column, line: Column) -> Column:
    own = F.slice(page, line["first"] + 1, line["last"] - line["first"] + 1)
    return F.aggregate(own, F.lit(0), lambda a, w: a + F.octet_length(w["text"])) + F.size(own) - 1


def lockup(page: Column, page_no: Column) -> Column:
    """One to three lines (first, last, emphasis, fs, x, y) of a page: small words, a large one, small words.

    Lines too wide for the frame shrink to a floor; the stack is centred on its anchor and kept within
    its band; small lines lean left and right in turn, as far as the frame lets them.
    """

    def sized(line: Column) -> Column:
        em = F.when(line["emphasis"], EM_UPPER).otherwise(EM_LOWER)
        full = F.when(line["emphasis"], LARGE).otherwise(SMALL)
        floor = F.when(line["emphasis"], LARGE_FLOOR).otherwise(SMALL_FLOOR)
        n = _line_bytes(page, line)
        return line.withField("fs", F.when(n * em * full > LINE_WIDTH, F.greatest(F.lit(LINE_WIDTH) / (n * em), floor)).otherwise(full))

    def placed(lines: Column) -> Column:
        height = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["fs"] * PITCH)
        low = F.greatest(F.lit(ANCHOR_Y) - height / 2, F.lit(TOP))
        top = F.when(low + height > BOTTOM, F.lit(BOTTOM) - height).otherwise(low)

        def put(line: Column, i: Column) -> Column:
            above = F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0.0), lambda a, x: a + x["fs"] * PITCH)
            room = F.greatest((1080.0 - _line_bytes(page, line) * EM_LOWER * line["fs"]) / 2 - 50, F.lit(0.0))
            lean = F.when(F.pmod(i + page_no, F.lit(2)) == 0, -F.least(F.lit(LEAN), room)).otherwise(F.least(F.lit(LEAN), room))
            x = F.when(line["emphasis"], 540.0).otherwise(lean + 540.0)
            return line.withField("x", x).withField("y", top + above + line["fs"] * PITCH / 2)

        return F.transform(lines, put)

    def lines(e: Column) -> Column:
        n = F.size(page)
        all_ = F.array(_line(F.lit(0), e - 1, F.lit(False), F.lit(0.0)), _line(e, e, F.lit(True), F.lit(0.0)), _line(e + 1, n - 1, F.lit(False), F.lit(0.0)))
        return F.transform(F.filter(all_, lambda x: x["last"] >= x["first"]), sized)

    return _bound(_bound(emphasis_word(page), lines), placed)


def _events(transcripts: DataFrame, clip_len: Column, spans, accent: str, style: str, pad: int) -> DataFrame:
    none = F.expr("cast(array() as array<struct<text:string,start_ms:bigint,end_ms:bigint,p:double>>)")
    rows = transcripts.withColumn("clip_len", clip_len).withColumn("words", F.coalesce("words", none))
    rows = rows.withColumn("words", relative_words(F.col("words"), F.lit(0).cast("long"))).withColumn("spans", spans(F.col("words")))
    pages = _bound(F.col("words"), lambda ws: F.transform("spans", lambda s, i: _page_events(ws, s, i, F.col("clip_len"), accent, style, pad)))
    return rows.withColumn("events", F.flatten(pages))


def clean_events(transcripts: DataFrame, clip_len: Column, headline: Column | None = None, accent: str = CLEAN_ACCENT) -> DataFrame:
    """(doc_id, events): array of (start_ms, end_ms, style, text), the headline's first if it is shown.

    ``words`` must be in order and timed from the clip's start (``relative_words``); null and empty
    ones give no events of words.
    """
    said = transcripts.withColumn("headline", headline if headline is not None else F.lit(None).cast("string"))
    rows = _events(said, clip_len, clean_spans, accent, "Caption", CLEAN_PAD_MS)
    top = F.struct(
        F.lit(0).cast("long").alias("start_ms"), F.least(F.lit(HEADLINE_MS).cast("long"), F.col("clip_len")).alias("end_ms"),
        F.lit("Headline").alias("style"), subtitle_escape(F.col("headline")).alias("text"),
    )
    shown = shows_headline(F.col("headline"), F.col("words"))
    return rows.select("doc_id", F.when(shown, F.concat(F.array(top), F.col("events"))).otherwise(F.col("events")).alias("events"))


def impact_events(transcripts: DataFrame, clip_len: Column, accent: str = IMPACT_ACCENT) -> DataFrame:
    """(doc_id, events) in the style with one large word a page; an event for each line."""
    return _events(transcripts, clip_len, impact_spans, accent, "Impact", IMPACT_PAD_MS).select("doc_id", "events")


def documents(events: DataFrame, header: str) -> DataFrame:
    """(doc_id, document): the subtitle file of each transcript."""

    def line(e: Column) -> Column:
        return F.concat(F.lit("Dialogue: 0,"), subtitle_time(e["start_ms"]), F.lit(","), subtitle_time(e["end_ms"]), F.lit(","), e["style"], F.lit(",,0,0,0,,"), e["text"], F.lit("\n"))

    return events.select("doc_id", F.concat(F.lit(header), F.array_join(F.transform("events", line), "")).alias("document"))


def words_within(words: Column, start: Column, end: Column) -> Column:
    """The words that lie wholly in an interval."""
    return F.filter(words, lambda w: (w["start_ms"] >= start) & (w["end_ms"] <= end))


def edited_words(words: Column, text: Column) -> Column:
    """Words with the texts of an edited caption: by position where the counts agree, else the edited words
    share the time from the first start to the last end evenly. A null edit leaves words as they are, a blank one none."""
    new = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def timed(x: Column) -> Column:
        words, new, n = x["words"], x["new"], F.size(x["new"])
        start = F.get(words, F.lit(0))["start_ms"]
        span = F.greatest(F.try_element_at(words, F.lit(-1))["end_ms"], start + 1) - start
        swapped = F.zip_with(words, new, lambda w, t: w.withField("text", t))

        def even(t: Column, i: Column) -> Column:
            w = F.get(words, F.lit(0)).withField("text", t).withField("p", F.lit(1.0))
            return w.withField("start_ms", start + F.floor(span * i / n)).withField("end_ms", start + F.floor(span * (i + 1) / n))

        return F.when(x["kept"] | (F.size(words) == 0), words).when(F.size(words) == n, swapped).otherwise(F.transform(new, even))

    # bound as one: a filter pushed below this projection would else split the text anew for every word
    return _bound(F.struct(words.alias("words"), new.alias("new"), text.isNull().alias("kept")), timed)
