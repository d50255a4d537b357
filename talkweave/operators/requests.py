"""What a request may ask for: uploads, restyling, framing and provider settings as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions.text import caption_style, font_name
from talkweave.operators.series import ACCENTS

# Bytes of disk that uploads leave free, default accents by style, and the providers' default models.
RESERVE_BYTES = 1 << 30
DEFAULT_ACCENTS = {"impact": "#FFDD00", "clean": "#FFB224"}
DEFAULT_MODELS = {"openai": "gpt-4o-mini", "anthropic": "claude-sonnet-4-5"}
LABELS = {"openai": "OpenAI", "anthropic": "Anthropic"}
ENDINGS = [".mp4", ".m4v"]
# What a refused request is told.
NO_SPACE = "Not enough free disk space for this video. Free up space and try again."
NO_FILE = "No file received. Drop one MP4 into the studio."
BAD_ENDING = "Attach an .mp4 file. Other containers are post-MVP."
BAD_MODE = "accent_mode must be manual, random, or optimized"
BAD_STYLE = 'style must be "impact" or "clean"'
BAD_ACCENT = "accent_color must be #RRGGBB"
BAD_FONT = "font must be one of the curated caption fonts"


def capacity_bytes(free_gb: Column) -> Column:
    """Bytes that uploads may fill; null (unknown) is no limit."""
    free = (F.greatest(free_gb, F.lit(0.0)) * RESERVE_BYTES).cast("long")
    return F.when(free_gb.isNotNull(), F.greatest(free - RESERVE_BYTES, F.lit(0).cast("long")))


def accent(text: Column) -> Column:
    """#RRGGBB, its hash put before it where it lacks; null where it is no colour."""
    t = F.trim(text)
    return F.when(t.rlike("^#*[0-9A-Fa-f]{6}$"), F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))


def drawn_accent(key: Column) -> Column:
    """One of the palette's colours by the key's digest, so that a rerun draws the same."""
    byte = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(a) for a in ACCENTS]), byte % len(ACCENTS) + 1)


def short_id(key: Column) -> Column:
    """Ten hexadecimal digits by the key's digest."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 10)


def temp_name(name: Column, key: Column) -> Column:
    """A hidden sibling of a file that keeps its last ending: .stem.part-id.ending."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit("."), F.when(stem == "", "artifact").otherwise(stem), F.lit(".part-"), short_id(key), F.substring(name, F.length(stem) + 1, F.length(name)))


def _last(fields: Column, name: str, value) -> Column:
    """The last field of that name whose value, put through ``value``, isn't null."""
    good = F.filter(F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: value(f["value"])), lambda v: v.isNotNull())
    return F.try_element_at(good, F.lit(-1))


def _accent_mode(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("manual", "random", "optimized"), t)


def uploads(requests: DataFrame) -> DataFrame:
    """(request_id, error, original_name, caption_style, accent_color, framing_mode, size) of requests
    (request_id, free_gb, best_accent, fields).

    ``fields`` is an array of (name, value, file_name, chunks), in the order sent; ``chunks`` are the
    sizes in which a file came. The first field that is wrong decides ``error``, as does, within a file,
    the first chunk beyond the capacity, which counts all files of the request. Unknown styles and
    colours are passed over, an unknown accent mode is an error; ``best_accent`` is the colour that
    suits the video (null: the default). With an error all else is null.
    """
    files = lambda f: f["name"] == "file"
    capacity = capacity_bytes(F.col("free_gb"))
    total = lambda xs: F.aggregate(F.coalesce(xs, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)

    def step(a: Column, f: Column) -> Column:
        size = a["size"] + F.when(files(f), total(f["chunks"])).otherwise(F.lit(0))
        ending = F.lower(F.coalesce(f["file_name"], F.lit("source.mp4")))
        wrong = (
            F.when((f["name"] == "accent_mode") & f["value"].isNotNull() & _accent_mode(f["value"]).isNull(), BAD_MODE)
            .when(files(f) & ~(ending.endswith(ENDINGS[0]) | ending.endswith(ENDINGS[1])), BAD_ENDING)
            .when(files(f) & (size > capacity), NO_SPACE)
        )
        return F.struct(F.coalesce(a["error"], wrong).alias("error"), size.alias("size"))

    read = F.aggregate("fields", F.expr("named_struct('error', cast(null as string), 'size', 0L)"), step)
    rows = requests.withColumn("_read", read)
    error = F.coalesce("_read.error", F.when(F.col("_read.size") == 0, NO_FILE))
    fields = F.col("fields")
    mode = F.coalesce(_last(fields, "accent_mode", _accent_mode), F.lit("manual"))
    colour = (
        F.when(mode == "random", drawn_accent(F.col("request_id")))
        .when(mode == "optimized", F.coalesce("best_accent", F.lit(DEFAULT_ACCENTS["impact"])))
        .otherwise(_last(fields, "accent_color", accent))
    )
    framing = F.when(_last(fields, "framing_mode", lambda v: F.trim(v)) == "background", "background").otherwise("fill")
    name = F.coalesce(F.try_element_at(F.filter(fields, files), F.lit(-1))["file_name"], F.lit("source.mp4"))
    out = {
        "original_name": name,
        "caption_style": _last(fields, "caption_style", lambda v: caption_style(v, strict=True)),
        "accent_color": colour,
        "framing_mode": framing,
        "size": F.col("_read.size"),
    }
    return rows.withColumn("error", error).select("request_id", "error", *[F.when(F.col("error").isNull(), v).alias(k) for k, v in out.items()])


def framed(mode: Column, analysed: Column) -> Column:
    """struct (mode, centre): the layout for a mode that was asked for and one that analysis gave; ``centre``
    is set where no track was found and the middle is cropped instead."""
    fill, tracked = mode == "fill", analysed == "face_crop"
    return F.struct(F.when(fill, "face_crop").otherwise("blur_pad").alias("mode"), F.when(fill & ~tracked, F.lit(0.5)).alias("centre"))


def restyled(requests: DataFrame, default_font: str) -> DataFrame:
    """(clip_id, error, style, accent_color, caption_font, caption_text) for requests (clip_id, style, accent_color,
    font, text) joined with what the clip has (old_style, old_accent, old_font, old_text).

    What is left out keeps the clip's value, else takes the default; what is given must be right, and
    the first of style, colour and font that is not decides ``error``, with which all else is null.
    """
    asked = caption_style(F.col("style"), strict=True)
    style = F.when(F.col("style").isNotNull(), asked).otherwise(caption_style(F.coalesce("old_style", F.lit("impact"))))
    default = F.when(style == "clean", DEFAULT_ACCENTS["clean"]).otherwise(DEFAULT_ACCENTS["impact"])
    colour = F.when(F.col("accent_color").isNotNull(), accent(F.col("accent_color"))).otherwise(F.coalesce("old_accent", default))
    font = F.when(F.col("font").isNotNull(), font_name(F.col("font"))).otherwise(F.coalesce("old_font", F.lit(default_font)))
    error = (
        F.when(F.col("style").isNotNull() & asked.isNull(), BAD_STYLE)
        .when(F.col("accent_color").isNotNull() & accent(F.col("accent_color")).isNull(), BAD_ACCENT)
        .when(F.col("font").isNotNull() & font_name(F.col("font")).isNull(), BAD_FONT)
    )
    out = {"style": style, "accent_color": colour, "caption_font": font, "caption_text": F.coalesce(F.trim("text"), "old_text")}
    return requests.select("clip_id", error.alias("error"), *[F.when(error.isNull(), v).alias(k) for k, v in out.items()])


def effective_model(provider: Column, model: Column) -> Column:
    """The model that was set, else the provider's default."""
    default = F.when(provider == "anthropic", DEFAULT_MODELS["anthropic"]).otherwise(DEFAULT_MODELS["openai"])
    return F.coalesce(F.nullif(F.trim(model), F.lit("")), default)


def connected(provider: Column, key: Column) -> Column:
    return (provider == "offline") | (F.trim(F.coalesce(key, F.lit(""))) != "")


def connection_message(provider: Column, model: Column, key: Column) -> Column:
    """struct (ok, message) of a connection test, the provider's own answer apart."""
    label = F.when(provider == "openai", LABELS["openai"]).when(provider == "anthropic", LABELS["anthropic"])
    article = F.concat(F.lit("Enter an "), label, F.lit(" API key first."))
    good = F.concat(label, F.lit(" connection verified. Using model "), effective_model(provider, model), F.lit("."))
    text = (
        F.when(provider == "offline", "Local ranking is ready — no API key needed.")
        .when(label.isNull(), F.concat(F.lit("Unknown provider `"), provider, F.lit("`.")))
        .when(~connected(provider, key), article)
        .otherwise(good)
    )
    return F.struct(((provider == "offline") | (label.isNotNull() & connected(provider, key))).alias("ok"), text.alias("message"))
