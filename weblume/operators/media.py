"""Animated images: frames shown in a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_time(delays: Column) -> Column:
    return F.aggregate(delays, F.lit(0.0), lambda a, x: a + x)


def _longest_window(laid: Column) -> Column:
    """No fewer frames than any window of a second has: its ends move 2n times at most. Sums here differ by rounding from those
    of each window by itself, so a little more than a second is let in."""
    zero = F.struct(F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0.0).alias("s"), F.lit(0).alias("k"))

    def move(w: Column, _: Column) -> Column:
        x = F.get(laid, w["r"])
        grow = F.coalesce((w["r"] < F.size(laid)) & (w["s"] + x <= 1.000001), F.lit(False))
        held = w["l"] < w["r"]
        r = w["r"] + F.when(grow | ~held, 1).otherwise(0)
        left = w["l"] + F.when(grow, 0).otherwise(1)
        s = F.when(grow, w["s"] + x).when(held, w["s"] - F.get(laid, w["l"])).otherwise(0.0)
        return F.struct(left.alias("l"), r.alias("r"), s.alias("s"), F.greatest(w["k"], r - left).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(2 * F.size(laid), F.lit(1))), zero, move)["k"]


def _most_in_a_second(laid: Column) -> Column:
    """Most frames from any on whose delays stay within a second: each window is summed by itself, but no further than the
    longest goes."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("c"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        fits = a["open"] & (a["s"] + x <= 1.0)
        return F.struct((a["s"] + F.when(fits, x).otherwise(0.0)).alias("s"), (a["c"] + F.when(fits, 1).otherwise(0)).alias("c"), fits.alias("open"))

    def most(reach: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(laid), F.lit(1)))
        return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(laid, i, reach), zero, step)["c"]))

    return F.transform(F.array(_longest_window(laid)), most)[0]


def frames_per_second(delays: Column, loops: Column) -> Column:
    """Most frames within any second of play.

    An animation of a second or less shows its frames times its loops. Else the frames are laid out once (one loop), twice (a
    second or more), or as often as two seconds take, and a window of delays slides over them.
    """
    total, n = display_time(delays), F.size(delays)
    times = F.when(loops == 1, 1).when(total >= 1, 2).otherwise(F.least(F.greatest(F.floor(F.lit(2.0) / total), F.lit(2)), loops)).cast("int")
    laid = F.flatten(F.array_repeat(delays, times))
    most = F.transform(F.array(laid), _most_in_a_second)[0]  # laid out once, not for each frame
    return F.when(n == 0, 0).when(total <= 1.0, (n * loops).cast("int")).otherwise(F.greatest(most, F.lit(1)))


def most_in_window(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Most rows of a key within a window that ends at one of them.

    Time is cut into spans, of a day or ten windows; a row in the last window of its span is also sent to the next, where it is
    counted but ends no window. So a key with a third of all rows is as many tasks as it has spans.
    """
    span, reach = max(86_400, 10 * seconds) * 1_000_000, seconds * 1_000_000
    rows = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t")).withColumn("__s", F.floor(F.col("__t") / F.lit(span)).cast("long"))
    late = F.col("__t") >= (F.col("__s") + 1) * span - reach
    sent = rows.select(key, "__t", F.explode(F.when(late, F.array(F.struct(F.col("__s").alias("s"), F.lit(True).alias("own")), F.struct((F.col("__s") + 1).alias("s"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("__s").alias("s"), F.lit(True).alias("own"))))).alias("__x"))
    w = Window.partitionBy(key, "__x.s").orderBy("__t").rangeBetween(-reach, 0)
    return sent.select(key, "__x.own", F.count("*").over(w).alias("c")).where("own").groupBy(key).agg(F.max("c").alias("most"))


def animations(images: DataFrame) -> DataFrame:
    """Image rows with animated, display_time and fps."""
    delays = F.col("frame_delays")
    return images.withColumn("animated", F.col("frames") > 1).withColumn("display_time", display_time(delays) * F.col("loops")).withColumn("fps", frames_per_second(delays, F.col("loops")))


def pixels(value: Column, whole: Column) -> Column:
    """A width or height attribute in pixels: plain, with px, or a percentage of the whole; -1 for other text."""
    number = F.regexp_extract(value, r"^\s*([\d.]+)", 1).try_cast("double")
    return F.coalesce(F.when(value.rlike(r"%\s*$"), number * whole / 100).when(value.rlike(r"^\s*[\d.]+\s*(px)?\s*$"), number), F.lit(-1.0))
