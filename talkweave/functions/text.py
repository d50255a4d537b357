"""Text, time and interval functions as Columns; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leads that a headline drops, in this order.
HEADLINE_LEADS = ["so", "and", "but", "um", "uh", "well", "yeah", "okay", "ok"]
# Fonts that a caption may name.
CAPTION_FONTS = ["Inter", "Arial", "Helvetica Neue", "Avenir Next", "Verdana", "Georgia"]
# The stages of a job, in order; each is also the name of the state it puts the job in.
STAGES = [
    "inspecting", "extracting_audio", "transcribing", "selecting_candidates", "validating_candidates", "analyzing_layout", "rendering",
]


def once(value: Column) -> Column:
    """The value as a generator of one row. What is computed from it can't be merged with it, nor a filter
    pushed below it, so it is computed once a row however often lambdas above refer to it."""
    return F.explode(F.array(value))


def normalize(text: Column) -> Column:
    """Lower case; runs of what is neither letter nor digit become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_list(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def clock(ms: Column) -> Column:
    """MM:SS, from an hour on H:MM:SS."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def clock_precise(ms: Column) -> Column:
    return F.concat(clock(ms), F.format_string(".%03d", ms % 1000))


def subtitle_time(ms: Column) -> Column:
    """H:MM:SS.CC, cut, not rounded."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, F.floor(ms % 1000 / 10))


def slug(text: Column, most: int) -> Column:
    """ASCII letters and digits in lower case, runs of others as one hyphen, at most ``most`` long."""
    raw = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(raw, "^-", ""), 1, most), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("clip")).otherwise(cut)


def headline(text: Column) -> Column:
    """Leads before a space dropped, ends trimmed of points and commas, at most 90 characters (cut at the
    last space in them, or after 87 without one), first letter large."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    for lead in HEADLINE_LEADS:
        t = F.regexp_replace(t, rf"(?i)^{lead} \s*", "")
    t = F.regexp_replace(t, r"[.,]+$", "")
    head = F.substring(t, 1, 90)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(F.substring(head, 1, 87))
    t = F.when(F.char_length(t) > 90, F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("…"))).otherwise(t)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))


def quote_head(text: Column, n: int = 12) -> Column:
    return F.array_join(F.slice(word_list(text), 1, n), " ")


def quote_tail(text: Column, n: int = 12) -> Column:
    w = word_list(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)), " ")


def alnum_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def table_cell(text: Column) -> Column:
    """A Markdown cell: null and empty as a dash; backslash, bar and line break escaped."""
    t = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("—")).otherwise(t)


def subtitle_escape(text: Column) -> Column:
    """Braces become parentheses and backslashes slashes; a line break, which would end the event, a space."""
    return F.translate(text, "{}\\\n", "()/ ")


def hex_to_bgr(colour: Column, default: str = "FFFFFF") -> Column:
    """#RRGGBB, with or without the hash, as BBGGRR in upper case; anything else is the default."""
    digits = F.regexp_replace(F.trim(colour), "^#+", "")
    ok = F.coalesce(digits.rlike("^[0-9A-Fa-f]{6}$"), F.lit(False))
    bgr = F.upper(F.concat(F.substring(digits, 5, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2)))
    return F.when(ok, bgr).otherwise(F.lit(default))


def font_name(name: Column) -> Column:
    """The listed font of that name, whatever its case; else null."""
    out = F.lit(None).cast("string")
    for f in CAPTION_FONTS:
        out = F.when(F.lower(F.trim(name)) == f.lower(), F.lit(f)).otherwise(out)
    return out


def clamp_score(x: Column) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(1)), F.lit(5)).cast("int")


def rate(text: Column) -> Column:
    """"num/den" as a double; null if either is zero or missing."""
    num = F.try_element_at(F.split(text, "/"), F.lit(1)).try_cast("double")
    den = F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double")
    return F.try_divide(F.nullif(num, F.lit(0.0)), F.nullif(den, F.lit(0.0)))


def ends_sentence(word: Column, comma: bool = False) -> Column:
    """Ends with . ? ! or an ellipsis (or a comma), closing quotes and brackets apart."""
    return word.rlike("[.?!…" + ("," if comma else "") + r"][\"')\]]*$")


def display_state(stage: Column) -> Column:
    """The state that a stage puts its job in; unknown names and null are the first state."""
    return F.when(stage.isin(STAGES), stage).otherwise(F.lit("created"))


def clip_filename(rank: Column, head: Column) -> Column:
    """Rank in two digits and the headline's slug."""
    return F.concat(F.format_string("%02d-", rank), slug(head, 48), F.lit(".mp4"))


def output_folder(source_name: Column) -> Column:
    """The slug of a source's name without its endings."""
    return slug(F.regexp_replace(source_name, r"(\.mp4)+$", ""), 60)


def caption_style(name: Column, strict: bool = False) -> Column:
    """``clean`` (also called minimal) or ``impact``, which stands for all else; ``strict``: null for all else."""
    given = F.lower(F.trim(name))
    if strict:
        return F.when(given.isin("impact", "clean"), given)
    return F.when(given.isin("clean", "minimal"), F.lit("clean")).otherwise(F.lit("impact"))


def byte_range(spec: Column, size: Column) -> Column:
    """A request for bytes of a resource: struct (status, first, last); status ``whole`` without a
    request, ``part``, or ``invalid``: other units, several ranges, or none of the bytes."""
    first = F.regexp_extract(spec, r"^bytes=(\+?\d*)-(\+?\d*)$", 1)
    last = F.regexp_extract(spec, r"^bytes=(\+?\d*)-(\+?\d*)$", 2)
    n, a, b = size.cast("decimal(38,0)"), first.try_cast("decimal(38,0)"), last.try_cast("decimal(38,0)")
    tail = F.greatest(n - b, F.lit(0))  # the last b bytes
    start = F.when(first == "", tail).otherwise(a)
    end = F.when((first == "") | (last == ""), n - 1).otherwise(F.least(b, n - 1))
    shaped = spec.rlike(r"^bytes=(\+?\d*)-(\+?\d*)$") & (n > 0) & F.when(first == "", b > 0).otherwise((a < n) & (end >= a))
    status = F.when(spec.isNull(), "whole").when(F.coalesce(shaped, F.lit(False)), "part").otherwise("invalid")
    return F.struct(status.alias("status"), F.when(status == "part", start).cast("long").alias("first"), F.when(status == "part", end).cast("long").alias("last"))


def plan_counts(duration_ms: Column) -> Column:
    """struct (target, proposals): a clip for every ten minutes, one at least, and half as many again, three at least."""
    target = F.greatest(F.round(duration_ms / 60_000.0 / 10.0).cast("long"), F.lit(1).cast("long"))
    return F.struct(target.alias("target"), F.greatest(F.ceil(target * 1.5), F.lit(3)).cast("long").alias("proposals"))


def rejection_text(reason: Column, reasons: Column, rule: Column, message: Column, detail: Column) -> Column:
    """What a rejection says, whichever of its fields say it; nulls are passed over."""
    return F.array_join(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (F.array(reason), reasons, F.array(rule, message, detail))]), " ")
