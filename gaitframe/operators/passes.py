"""Passes through a lane and gait features.

positions: tracklet_id, frame_index, position. frames: one row per pass and frame: pass_id, idx, t (seconds from
the pass's start, null where the clock is not reliable), ax, ay and bx, by (cranial and caudal end of the body
axis, null where not seen) and a column pair per further point.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY, EXIT, MIN_FRAMES, MIN_USABLE, MAX_REDUCED = 0.20, 0.80, 8, 3, 0.40
COVERED, REDUCED_COVER, VISIBLE = 0.8, 0.4, 0.30


def first_crossing(positions: DataFrame, level: float) -> DataFrame:
    """First frame of each tracklet whose position reaches level from below."""
    w = Window.partitionBy("tracklet_id").orderBy("frame_index")
    up = (F.lag("position").over(w) < level) & (F.col("position") >= level)
    return positions.withColumn("_up", up).groupBy("tracklet_id").agg(F.min(F.when(F.col("_up"), F.col("frame_index"))).alias("crossing"))


def segment(positions: DataFrame, entry: float = ENTRY, exit_: float = EXIT) -> DataFrame:
    """Passes of each tracklet in order: complete ones from an entry crossing to the next exit crossing, and a
    partial one for frames left after the last.

    A partial pass begins where the last pass ended, keeps whichever crossing was seen and names the missing
    one; an exit counts as seen without an entry only if no entry follows. With exit below entry the lane is
    travelled in reverse. State runs along the frames, so a fold walks the sorted array.
    """
    sign = 1.0 if exit_ >= entry else -1.0
    p = positions.select("tracklet_id", "frame_index", (F.col("position") * sign).alias("position"))
    rows = p.groupBy("tracklet_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", "position"))).alias("_f"))
    out = rows.select("tracklet_id", F.explode(_fold(F.col("_f"), sign * entry, sign * exit_)).alias("p")).select("tracklet_id", "p.*")
    name = F.concat(F.col("tracklet_id").cast("string"), F.lit(":p"), F.lpad(F.col("pass_no").cast("string"), 3, "0"))
    return out.withColumns({"pass_id": name, "direction": F.lit("forward" if sign > 0 else "reverse")})


def _fold(f: Column, entry: float, exit_: float) -> Column:
    """Array of passes (pass_no, first_frame, last_frame, frame_count, entry_frame, exit_frame, completeness, missing_boundary)."""
    n = F.size(f)
    up = lambda i, level: (i > 0) & (F.get(f, F.greatest(i - 1, F.lit(0)))["position"] < level) & (F.get(f, i)["position"] >= level)
    kind = "struct<first:int,last:int,entry:int,exit:int>"
    start = F.struct(F.lit(0).alias("cursor"), F.lit(-1).alias("entry"), F.lit(-1).alias("lone"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        entered = F.when((s["entry"] < 0) & up(i, entry), i).otherwise(s["entry"])
        done = (entered >= 0) & up(i, exit_)
        lone = F.when((entered < 0) & (s["lone"] < 0) & up(i, exit_), i).otherwise(s["lone"])
        item = F.struct(entered.alias("first"), i.alias("last"), entered.alias("entry"), i.alias("exit"))
        return F.struct(
            F.when(done, i + 1).otherwise(s["cursor"]).alias("cursor"),
            F.when(done, F.lit(-1)).otherwise(entered).alias("entry"),
            F.when(done, F.lit(-1)).otherwise(lone).alias("lone"),
            F.when(done, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        some = F.when(s["entry"] >= 0, s["entry"])
        left = F.struct(s["cursor"].alias("first"), (n - 1).alias("last"), some.alias("entry"), F.when(some.isNull() & (s["lone"] >= 0), s["lone"]).alias("exit"))
        every = F.when(s["cursor"] < n, F.concat(s["out"], F.array(left))).otherwise(s["out"])
        frame = lambda i: F.get(f, i)["frame_index"]
        whole = lambda p: p["entry"].isNotNull() & p["exit"].isNotNull()
        missing = lambda p: (
            F.when(whole(p), "").when(p["entry"].isNotNull(), "exit").when(p["exit"].isNotNull(), "entry").otherwise("entry and exit")
        )
        return F.transform(
            every,
            lambda p, k: F.struct(
                k.alias("pass_no"), frame(p["first"]).alias("first_frame"), frame(p["last"]).alias("last_frame"), (p["last"] - p["first"] + 1).alias("frame_count"),
                frame(p["entry"]).alias("entry_frame"), frame(p["exit"]).alias("exit_frame"), F.when(whole(p), "complete").otherwise("partial").alias("completeness"),
                missing(p).alias("missing_boundary"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, finish)


def frame_rate(first_frame: Column, last_frame: Column, first_us: Column, last_us: Column) -> Column:
    """Frames of a pass by its seconds; 0 where either is not positive or a time is missing."""
    frames, span = last_frame - first_frame, (last_us - first_us) / 1e6
    return F.coalesce(F.when((span > 0) & (frames > 0), frames / span), F.lit(0.0))


def elapsed(frames: DataFrame) -> DataFrame:
    """frames (pass_id, idx, us, reliable) with t, seconds since the pass's first frame; null for all if any stamp is missing or unreliable."""
    w = Window.partitionBy("pass_id")
    sound = F.bool_and(F.col("us").isNotNull() & F.col("reliable")).over(w)
    first = F.min_by("us", "idx").over(w)
    return frames.withColumn("t", F.when(sound, (F.col("us") - first) / 1e6))


def sampling_rate(frames: DataFrame) -> DataFrame:
    """Frames per second of each pass from t; null without a clock, with one frame or without a span."""
    span = F.max_by("t", "idx") - F.min_by("t", "idx")
    n = F.count("*")
    sound = (F.count("t") == n) & (n >= 2)
    return frames.groupBy("pass_id").agg(F.when(sound & (span > 0), (n - 1) / span).alias("sampling_hz"))


def geometry(frames: DataFrame, min_frames: int = 3) -> DataFrame:
    """frames with the pass's frame of reference: x, y (middle of the axis where both ends are seen), ux, uy
    (direction of travel), mx, my (mean place) and reference (median length of the axis).

    The direction is the main axis of the path, turned the way the path ends; of a path that does not move it is
    (1, 0). Passes with fewer than min_frames usable frames or without a length are left out. All of it comes
    from windows over the pass, so frames move once.

    Of a path that ends at a right angle to its main axis the side is left to the rounding of the sums, as in
    the SQL; the frames are summed in one order, the last first, so that it does not change from run to run.
    """
    seen = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    f = frames.withColumns({"x": F.when(seen, (F.col("ax") + F.col("bx")) / 2), "y": F.when(seen, (F.col("ay") + F.col("by")) / 2)})
    f = f.withColumn("_len", F.when(seen, F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))))
    w = Window.partitionBy("pass_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.when(F.col("x").isNotNull(), F.col("idx"))
    g = f.withColumns(
        {
            "usable": F.count("x").over(w), "mx": F.avg("x").over(w), "my": F.avg("y").over(w), "_vx": F.var_pop("x").over(w), "_vy": F.var_pop("y").over(w),
            "_c": F.covar_pop("x", "y").over(w), "reference": F.percentile("_len", F.lit(0.5)).over(w),
            "_dx": F.max_by("x", at).over(w) - F.min_by("x", at).over(w),
            "_dy": F.max_by("y", at).over(w) - F.min_by("y", at).over(w),
        }
    )
    angle = 0.5 * F.atan2(2 * F.col("_c"), F.col("_vx") - F.col("_vy"))
    g = g.withColumns({"ux": F.cos(angle), "uy": F.sin(angle)})
    turn = F.when(F.col("ux") * F.col("_dx") + F.col("uy") * F.col("_dy") < 0, -1.0).otherwise(1.0)
    g = g.withColumns({"ux": F.col("ux") * turn, "uy": F.col("uy") * turn})
    return g.filter((F.col("usable") >= min_frames) & (F.col("reference") > 0)).drop("_len", "_vx", "_vy", "_c", "_dx", "_dy")


def along(x: Column, y: Column) -> Column:
    return (x - F.col("mx")) * F.col("ux") + (y - F.col("my")) * F.col("uy")


def across(x: Column, y: Column) -> Column:
    return (y - F.col("my")) * F.col("ux") - (x - F.col("mx")) * F.col("uy")


def motion_features(frames: DataFrame, head: tuple[str, str] = ("hx", "hy")) -> DataFrame:
    """speed, speed_variability, lateral_sway, tracking_jitter, head_lateral_offset and head_bob per pass (F1-F6).

    Speeds need a clock; they are taken between usable frames whose time grows. The head's offset counts every
    frame that shows the head, its bob those that show the axis too, three at least.
    """
    w = Window.partitionBy("pass_id").orderBy("idx")
    g = geometry(frames)
    g = g.withColumns({"_on": F.col("x").isNotNull(), "_al": along(F.col("x"), F.col("y")), "_ac": across(F.col("x"), F.col("y")), "_hd": across(F.col(head[0]), F.col(head[1]))})
    u = Window.partitionBy("pass_id", "_on").orderBy("idx")
    clock = F.count_if(F.col("t").isNull()).over(Window.partitionBy("pass_id")) == 0
    dt = F.col("t") - F.lag("t").over(u)
    v = F.when(clock & F.col("_on") & (dt > 0), F.abs(F.col("_al") - F.lag("_al").over(u)) / dt / F.col("reference"))
    smooth = (F.coalesce(F.lag("_ac").over(u), F.lit(0.0)) + F.col("_ac") + F.coalesce(F.lead("_ac").over(u), F.lit(0.0))) / 3
    p = g.withColumns({"v": v, "jit": F.when(F.col("_on"), F.abs(F.col("_ac") - smooth)), "rel": F.col("_hd") - F.col("_ac")})
    swing = F.percentile("rel", F.array(F.lit(0.05), F.lit(0.95)))
    out = p.groupBy("pass_id").agg(
        F.percentile("v", F.lit(0.5)).alias("speed"), F.stddev_pop("v").alias("_sv"), F.avg("v").alias("_mv"), F.sqrt(F.avg(F.col("_ac") ** 2)).alias("_rms"),
        F.percentile("jit", F.lit(0.5)).alias("_jit"), F.avg(F.abs("_hd")).alias("_off"), swing.alias("_sw"), F.count("rel").alias("_n"), F.max("reference").alias("_len"),
    )
    variability = F.when(F.col("_mv") > 0, F.col("_sv") / F.col("_mv")).when(F.col("_mv").isNotNull(), 0.0)
    return out.select(
        "pass_id", "speed", variability.alias("speed_variability"), (F.col("_rms") / F.col("_len")).alias("lateral_sway"), (F.col("_jit") / F.col("_len")).alias("tracking_jitter"),
        (F.col("_off") / F.col("_len")).alias("head_lateral_offset"), F.when(F.col("_n") >= 3, (F.col("_sw")[1] - F.col("_sw")[0]) / F.col("_len")).alias("head_bob"),
    )


def curvature(frames: DataFrame, point: tuple[str, str] = ("cx", "cy")) -> DataFrame:
    """Median distance of a point from the line between the axis ends, by the reference length (F7)."""
    g = geometry(frames)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    d = F.abs(dx * (F.col("ay") - F.col(point[1])) - (F.col("ax") - F.col(point[0])) * dy) / F.nullif(F.hypot(dx, dy), F.lit(0.0))
    out = g.withColumn("_d", d).groupBy("pass_id").agg(F.percentile("_d", F.lit(0.5)).alias("_m"), F.max("reference").alias("_len"))
    return out.select("pass_id", (F.col("_m") / F.col("_len")).alias("spine_lateral_curvature"))


def limb_offsets(frames: DataFrame, limbs: dict[str, tuple[str, str]]) -> DataFrame:
    """pass_id, idx, t, limb, offset and reference: each limb's place along the travel, relative to the body."""
    g = geometry(frames)
    one = lambda n, x, y: F.struct(F.lit(n).alias("limb"), ((F.col(x) - F.col("x")) * F.col("ux") + (F.col(y) - F.col("y")) * F.col("uy")).alias("offset"))
    e = g.select("pass_id", "idx", "t", "reference", F.explode(F.array(*[one(n, x, y) for n, (x, y) in limbs.items()])).alias("e"))
    return e.select("pass_id", "idx", "t", "reference", "e.*")


def stride_features(offsets: DataFrame) -> DataFrame:
    """Mean excursion (P95 - P5, three samples at least) by the reference length, and asymmetry of two limbs (F8, F9).

    Two limbs that do not move have asymmetry 0; with another number of limbs there is none.
    """
    seen = offsets.filter(F.col("offset").isNotNull() & ~F.isnan("offset"))
    per = seen.groupBy("pass_id", "limb").agg(F.count("*").alias("n"), F.percentile("offset", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.max("reference").alias("_len"))
    per = per.filter("n >= 3").withColumn("e", F.col("q")[1] - F.col("q")[0])
    out = per.groupBy("pass_id").agg(F.avg("e").alias("_m"), F.count("*").alias("limbs"), F.max("e").alias("_a"), F.min("e").alias("_b"), F.max("_len").alias("_len"))
    asym = F.when(F.col("limbs") == 2, F.coalesce(F.try_divide(F.col("_a") - F.col("_b"), F.col("_a") + F.col("_b")), F.lit(0.0)))
    return out.select("pass_id", (F.col("_m") / F.col("_len")).alias("stride_length"), "limbs", asym.alias("step_asymmetry"))


def strongest_frequency(t: np.ndarray, value: np.ndarray) -> float:
    """The strongest frequency of a series, resampled evenly; NaN with fewer than six samples or no duration."""
    if len(t) < 6 or t[-1] <= t[0]:
        return math.nan
    even = np.linspace(t[0], t[-1], len(t))
    power = np.abs(np.fft.rfft(np.interp(even, t, value - value.mean())))[1:]
    return float(np.fft.rfftfreq(len(even), (t[-1] - t[0]) / (len(even) - 1))[1:][power.argmax()]) if len(power) else math.nan


def stride_frequency(offsets: DataFrame) -> DataFrame:
    """Mean over the limbs of a pass of their strongest frequency (F10); the pass needs a clock and two limbs declared.

    The transform needs a limb's whole series in order: it travels as one list, and a kernel takes many at once.
    """
    kind = offsets.schema["pass_id"].dataType.simpleString()
    seen = F.when(F.col("offset").isNotNull(), F.struct("idx", "t", F.col("offset").alias("o")))
    per = offsets.groupBy("pass_id", "limb").agg(F.bool_or(F.col("t").isNull()).alias("_off"), F.array_sort(F.collect_list(seen)).alias("_s"))
    per = per.select("pass_id", F.when(~F.col("_off") & (F.size("_s") >= 6), F.transform("_s", lambda x: x["t"])).alias("_t"), F.transform("_s", lambda x: x["o"]).alias("_v"))

    def run(batches):
        for b in batches:
            t, v = b.column("_t"), b.column("_v")
            f = [strongest_frequency(t[i].values.to_numpy(), v[i].values.to_numpy()) if t[i].is_valid else math.nan for i in range(b.num_rows)]
            yield pa.record_batch([b.column("pass_id"), pa.array(f, pa.float64())], names=["pass_id", "f"])

    out = per.mapInArrow(run, f"pass_id {kind}, f double").groupBy("pass_id")
    out = out.agg(F.count("*").alias("_limbs"), F.avg(F.when(~F.isnan("f"), F.col("f"))).alias("stride_frequency"))
    return out.filter("_limbs = 2 AND stride_frequency IS NOT NULL").drop("_limbs")


def coverage(points: DataFrame) -> DataFrame:
    """points (pass_id, name, x, confidence): per pass and point the share of frames that show it and its mean confidence there."""
    seen = F.col("x").isNotNull()
    return points.groupBy("pass_id", "name").agg(
        F.avg(F.when(seen, 1.0).otherwise(0.0)).alias("coverage"), F.coalesce(F.avg(F.when(seen, F.col("confidence"))), F.lit(0.0)).alias("confidence")
    )


def feature_quality(available: Column, needs_hz: Column, sampling_hz: Column, value: Column, cover: Column, conf: Column, floor: float = VISIBLE) -> Column:
    """unavailable, unusable, good, reduced: the first rule that holds.

    A feature that needs a sampling rate is unusable where the rate is lower or unknown.
    """
    slow = (needs_hz > 0) & (sampling_hz.isNull() | (sampling_hz < needs_hz))
    return (
        F.when(~available, "unavailable")
        .when(slow, "unusable")
        .when(value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf")), "unusable")
        .when((cover >= COVERED) & (conf >= floor), "good")
        .when(cover >= REDUCED_COVER, "reduced")
        .otherwise("unusable")
    )


def pass_validity(
    resolved: Column, complete: Column, frames: Column, usable: Column, reduced: Column, min_frames: int = MIN_FRAMES, accept_partial: bool = False,
    min_usable: int = MIN_USABLE, max_reduced: float = MAX_REDUCED,
) -> Column:
    """The first reason that makes a pass invalid, or valid. usable and reduced count available features only."""
    return (
        F.when(~resolved, "unresolved_identity")
        .when(frames < min_frames, "too_few_frames")
        .when(~complete & F.lit(not accept_partial), "partial_pass")
        .when(usable == 0, "no_usable_features")
        .when(usable < min_usable, "too_few_usable_features")
        .when(reduced / usable > max_reduced, "too_many_reduced_features")
        .otherwise("valid")
    )
