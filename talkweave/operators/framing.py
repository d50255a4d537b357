"""Crop keyframes from a face track, and the filter strings that an encoder takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output size, pan speed in widths a second, dead band, most keyframes, frame rates kept.
WIDTH, HEIGHT = 1080, 1920
PAN_PER_S, DEAD_BAND, MOST_KEYS = 0.10, 0.012, 12
FPS_LOW, FPS_HIGH, FPS_ELSE = 20.0, 60.0, 30.0


def crop_keyframes(track: DataFrame, key: str, fps: float = 1.0) -> DataFrame:
    """(key, keyframes): array of (t_ms, cx) from a smoothed track (key, frame, cx).

    Every second frame may become a key. It moves from the last key no faster than the pan speed
    and is left out within the dead band; of more than 12 keys every second one goes until they fit.
    A fold over one track's samples, in frame order.
    """
    items = F.array_sort(F.collect_list(F.struct("frame", F.col("cx").cast("double").alias("cx"))))
    zero = F.expr("cast(array() as array<struct<t_ms:bigint,cx:double>>)")

    def step(keys: Column, x: Column) -> Column:
        t = F.floor(x["frame"] / F.lit(fps) * 1000).cast("long")
        last = F.try_element_at(keys, F.lit(-1))
        reach = (t - last["t_ms"]) / 1000.0 * PAN_PER_S
        cx = F.when(last.isNull(), x["cx"]).otherwise(F.least(F.greatest(x["cx"], last["cx"] - reach), last["cx"] + reach))
        new = last.isNull() | (F.abs(last["cx"] - cx) > DEAD_BAND)
        return F.when(new, F.concat(keys, F.array(F.struct(t.alias("t_ms"), cx.alias("cx"))))).otherwise(keys)

    even = F.filter("items", lambda x: F.pmod(x["frame"], F.lit(2)) == 0)
    keys = track.groupBy(key).agg(items.alias("items")).select(key, F.aggregate(even, zero, step).alias("keys"))
    halvings = F.ceil(F.log2(F.greatest(F.size("keys") / float(MOST_KEYS), F.lit(1.0))))
    apart = F.pow(F.lit(2), halvings).cast("int")
    return keys.withColumn("apart", apart).select(key, F.filter("keys", lambda k, i: F.pmod(i, F.col("apart")) == 0).alias("keyframes"))


def crop_x(keyframes: Column, scaled_width: Column) -> Column:
    """The crop's x over time: linear between keys, held after the last, half-way without keys."""
    most = (scaled_width - WIDTH).cast("double")

    def px(k: Column) -> Column:
        return F.least(F.greatest(k["cx"] * scaled_width - WIDTH / 2.0, F.lit(0.0)), most)

    def piece(k: Column, i: Column) -> Column:
        n = F.get(keyframes, i + 1)
        t0, t1, x0, x1 = k["t_ms"] / 1000.0, n["t_ms"] / 1000.0, px(k), px(n)
        said = F.format_string("if(lt(t\\,%.3f)\\,%.1f+(%.1f-%.1f)*(t-%.3f)/%.3f\\,", t1, x0, x1, x0, t0, t1 - t0)
        return F.when(n["t_ms"] > k["t_ms"], said)

    pieces = F.filter(F.transform(keyframes, piece), lambda s: s.isNotNull())
    held = F.format_string("%.1f", F.coalesce(px(F.try_element_at(keyframes, F.lit(-1))), most / 2.0))
    return F.concat(F.array_join(pieces, ""), held, F.repeat(F.lit(")"), F.size(pieces)))


def filter_graph(width: Column, height: Column, keyframes: Column, subtitles: Column | None = None) -> Column:
    """The filter graph of one clip: a moving crop where there are keyframes and the scaled picture is wide
    enough, else the picture over its own blurred copy. ``subtitles`` is a filter to burn in, or null."""
    scaled = (F.round(width * float(HEIGHT) / height / 2.0) * 2).cast("long")
    subs = F.lit("") if subtitles is None else F.coalesce(F.concat(subtitles, F.lit(",")), F.lit(""))
    audio = "[0:a]asetpts=PTS-STARTPTS[a]"
    crop = F.concat(
        F.lit(f"[0:v]setpts=PTS-STARTPTS,scale=-2:{HEIGHT}:force_divisible_by=2,crop={WIDTH}:{HEIGHT}:x='"),
        crop_x(keyframes, scaled), F.lit("':y=0,"), subs, F.lit("format=yuv420p[v];" + audio),
    )
    fit = f"scale={WIDTH}:{HEIGHT}:force_original_aspect_ratio="
    blur = F.concat(
        F.lit("[0:v]setpts=PTS-STARTPTS,split=2[bga][fga];"),
        F.lit(f"[bga]{fit}increase:force_divisible_by=2,crop={WIDTH}:{HEIGHT},gblur=sigma=26,eq=brightness=-0.14:saturation=0.8[bg];"),
        F.lit(f"[fga]{fit}decrease:force_divisible_by=2[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2,"), subs, F.lit("format=yuv420p[v];" + audio),
    )
    return F.when(keyframes.isNotNull() & (scaled >= WIDTH), crop).otherwise(blur)


def filter_quoted(path: Column) -> Column:
    """A path for a single-quoted filter option."""
    return F.replace(F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:")), F.lit("'"), F.lit("'\\''"))


def output_rate(fps: Column) -> Column:
    """Rates from 20 to 60 pass, others (and null) become 30."""
    return F.when(fps.between(FPS_LOW, FPS_HIGH), fps).otherwise(F.lit(FPS_ELSE))
