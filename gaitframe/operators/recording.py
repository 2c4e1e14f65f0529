"""Acceptance rules for a recording: each rule passes, fails or is unknown; fail outweighs unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the requirements.
FRAME_RATE, DETECTED, SINGLE, SIZE, TRANSIT_S, TRANSIT_SPAN, WINDOWS, WINDOW_S = 25.0, 0.10, 0.95, (0.25, 0.50), 3.0, 0.4, 4, 30.0
CONSTANT = 0.01


def upper_median(a: Column) -> Column:
    """The element at half the length of the sorted values (not an interpolated median)."""
    return F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))


def window_bounds(frames: int, rate: float, windows: int = WINDOWS, seconds: float = WINDOW_S) -> list[tuple[int, int]]:
    """Stretches of whole seconds that begin at even steps of a recording; all of it when they would fill it."""
    if frames <= 0 or rate <= 0:
        return [(0, max(frames, 0))]
    size, count = max(int(seconds * rate), 1), max(windows, 1)
    if frames <= size * count:
        return [(0, frames)]
    return [(i * (frames // count), min(i * (frames // count) + size, frames)) for i in range(count)]


def frame_rate_floor(features: list[dict], spec: float = FRAME_RATE) -> float:
    """The stricter of the specification's floor and what available features need."""
    return max([spec, *(f.get("requires_sampling_hz", 0.0) for f in features if f.get("available", True))])


def rate_of(text: Column) -> Column:
    """A rate written as a ratio such as 30000/1001; null when it cannot be read or is over 0."""
    parts = F.split(text, "/")
    return F.try_divide(parts[0].try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))


def constant_rate(average: Column, nominal: Column) -> Column:
    """Whether average and nominal rate differ by at most 1 %; null if either is absent, 0/0 or 0."""
    a, n = (F.when(~c.eqNullSafe(F.lit("0/0")), rate_of(c)) for c in (average, nominal))
    return F.when(n != 0, F.abs(a - n) / n <= CONSTANT)


def filename_time(name: Column) -> Column:
    """A capture time in a file name, such as 2024-03-05T13-04-28 or 20240305_130428; null if there is none or it is no time."""
    digits = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[T_ -](\d{2})[-:_]?(\d{2})[-:_]?(\d{2})"
    text = F.concat(*[F.regexp_extract(name, digits, i) for i in range(1, 7)])
    return F.when(text != "", F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def shares(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """frames (recording, frame_index, boxes) and sizes (recording, size, one row a detection): share of frames
    with a detection, of those with exactly one, upper median of all detections' sizes."""
    median = sizes.groupBy("recording").agg(upper_median(F.collect_list("size")).alias("box_size"))
    out = frames.groupBy("recording").agg(
        F.avg(F.when(F.col("boxes") > 0, 1.0).otherwise(0.0)).alias("detected"),
        F.try_divide(F.count_if(F.col("boxes") == 1) * 1.0, F.count_if(F.col("boxes") > 0) * 1.0).alias("single"),
        F.count("*").alias("frames"),
    )
    return out.join(median, "recording", "left")


def transits(centres: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per recording: tracklets, those that cross the section, and the upper median of their seconds.

    centres: recording, tracklet_id, frame_index, x, y; recordings: recording, frame_rate, long_side. A tracklet
    crosses if its last centre is far enough from its first; how long it stays does not make it cross.
    """
    ends = centres.groupBy("recording", "tracklet_id").agg(
        F.count("*").alias("n"), F.min("frame_index").alias("f0"), F.max("frame_index").alias("f1"),
        *[f(c, "frame_index").alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min_by), (1, F.max_by))],
    )
    t = ends.join(recordings.select("recording", "frame_rate", "long_side"), "recording")
    moved = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.greatest(F.col("long_side"), F.lit(1))
    crosses = (F.col("n") >= 2) & (moved >= TRANSIT_SPAN)
    seconds = F.when(crosses, F.struct(F.try_divide(F.col("f1") - F.col("f0") + 1.0, F.col("frame_rate").cast("double")).alias("s"), moved.alias("m")))
    out = t.groupBy("recording").agg(F.count("*").alias("tracklets"), F.count_if(crosses).alias("traverses"), upper_median(F.collect_list(seconds)).alias("_m"))
    return out.select("recording", "tracklets", "traverses", F.col("_m.s").alias("transit_seconds"))


def verdict(parts: list[tuple[Column, Column]]) -> Column:
    """(attempted, passed) of every part: a failed part fails, else a part that was not attempted leaves it unknown."""
    fail, unknown = F.lit(False), F.lit(False)
    for tried, passed in parts:
        fail, unknown = fail | (tried & ~F.coalesce(passed, F.lit(False))), unknown | ~tried
    return F.when(fail, "fail").when(unknown, "unknown").otherwise("pass")


def rules(
    s: DataFrame, floor: float = FRAME_RATE, detected: float = DETECTED, single: float = SINGLE, size: tuple[float, float] = SIZE, transit: float = TRANSIT_S
) -> DataFrame:
    """One row per recording, requirement and rule: pass, fail or unknown.

    s: recording, frame_rate, constant (null where it could not be read), captured_at, detected, single,
    box_size, tracklets, traverses, transit_seconds. Nothing detected fails visibility, too little leaves it
    unknown; the other detection rules are judged on whatever was detected. The identity feed is never at hand.
    """
    yes, some = F.lit(True), F.coalesce(F.col("detected") > 0, F.lit(False))
    rate = F.coalesce(F.col("frame_rate"), F.lit(0.0))
    seen = F.when(~some, "fail").when(F.col("detected") < detected, "unknown").otherwise("pass")
    judged = lambda ok: F.when(~some, "unknown").when(ok, "pass").otherwise("fail")
    crossing = (
        F.when(~some | (rate <= 0) | (F.coalesce("tracklets", F.lit(0)) == 0), "unknown")
        .when(F.coalesce("traverses", F.lit(0)) == 0, "fail")
        .otherwise(F.when(F.col("transit_seconds") >= transit, "pass").otherwise("fail"))
    )
    checks = {
        ("R2", "frame rate"): verdict([(rate > 0, rate >= floor), (F.col("constant").isNotNull(), F.col("constant"))]),
        ("R6", "capture time"): verdict([(yes, F.col("captured_at").isNotNull()), (F.lit(False), F.lit(False))]),
        ("R1", "animal visibility"): seen,
        ("R3", "one animal at a time"): judged(F.col("single") >= single),
        ("R4", "framing"): judged(F.col("box_size").between(*size)),
        ("R4", "transit"): crossing,
        ("R5", "identity feed"): F.lit("unknown"),
    }
    parts = F.array(*[F.struct(F.lit(r).alias("requirement"), F.lit(n).alias("rule"), c.alias("status")) for (r, n), c in checks.items()])
    return s.select("recording", F.explode(parts).alias("p")).select("recording", "p.*")


def combined(checks: DataFrame) -> DataFrame:
    """Per recording: any fail fails it, else any unknown leaves it unknown; ok is without a fail. failed and unknown list the rules."""
    named = lambda x: F.array_sort(F.collect_list(F.when(F.col("status") == x, F.concat_ws(" ", "requirement", "rule"))))
    fail, unknown = F.bool_or(F.col("status") == "fail"), F.bool_or(F.col("status") == "unknown")
    return checks.groupBy("recording").agg(F.when(fail, "fail").when(unknown, "unknown").otherwise("pass").alias("status"), (~fail).alias("ok"), named("fail").alias("failed"), named("unknown").alias("unknown"))


def analysed(recordings: DataFrame, windows: int = WINDOWS, seconds: float = WINDOW_S) -> DataFrame:
    """recording, analysed_seconds, duration_seconds and their ratio, by the rule of window_bounds."""
    n, rate = F.greatest(F.col("frames"), F.lit(0)), F.col("frame_rate")
    size = F.greatest(F.floor(seconds * rate), F.lit(1))
    used = F.when(n <= size * windows, n).otherwise(size * windows)
    out = recordings.select("recording", F.when(rate > 0, used / rate).otherwise(0.0).alias("analysed_seconds"), F.when(rate > 0, n / rate).otherwise(0.0).alias("duration_seconds"))
    return out.withColumn("analysed_share", F.try_divide("analysed_seconds", "duration_seconds"))


def sampled(frames: DataFrame, recordings: DataFrame, windows: int = WINDOWS, seconds: float = WINDOW_S) -> DataFrame:
    """The frames (recording, frame_index, ...) that lie in one of the recording's stretches."""
    r = recordings.select("recording", F.col("frames").alias("_n"), F.floor(seconds * F.col("frame_rate")).alias("_s"), F.col("frame_rate").alias("_r"))
    f = frames.join(r, "recording")
    size, step = F.greatest(F.col("_s"), F.lit(1)), F.floor(F.col("_n") / windows)
    inside = (F.col("frame_index") < step * windows) & (F.pmod(F.col("frame_index"), step) < size)
    return f.filter((F.col("frame_index") < F.col("_n")) & ((F.col("_r") <= 0) | (F.col("_n") <= size * windows) | inside)).drop("_n", "_s", "_r")


def numbered(frames: DataFrame) -> DataFrame:
    """frames with frame_index from 0 in the order of their paths within a recording."""
    return frames.withColumn("frame_index", F.row_number().over(Window.partitionBy("recording").orderBy("path")) - 1)
