"""Joins between the stages of a run, and its counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP_SECONDS, CLIP_RATE = 3.0, 25.0


def back_fill(poses: DataFrame, tracked: DataFrame) -> DataFrame:
    """poses (detection_id) with the tracklet their detection became part of, '' if none."""
    t = tracked.select(F.col("detection_id").alias("_d"), F.col("tracklet_id").alias("_t"))
    return poses.drop("tracklet_id").join(t, F.col("detection_id") == F.col("_d"), "left").withColumn("tracklet_id", F.coalesce("_t", F.lit(""))).drop("_d", "_t")


def assigned_passes(passes: DataFrame, assignments: DataFrame) -> DataFrame:
    """passes with animal_id and resolved from the assignment of their tracklet; without one they are unresolved."""
    a = assignments.select(F.col("tracklet_id").alias("_t"), F.col("animal_id").cast("string").alias("animal_id"))
    out = passes.join(a, F.col("tracklet_id") == F.col("_t"), "left").drop("_t")
    return out.withColumn("resolved", F.coalesce(F.col("animal_id") != "", F.lit(False))).withColumn("animal_id", F.coalesce("animal_id", F.lit("")))


def pass_poses(passes: DataFrame, poses: DataFrame) -> DataFrame:
    """The poses of each pass: those of its tracklet from its first to its last frame."""
    p = passes.select("pass_id", F.col("tracklet_id").alias("_t"), "first_frame", "last_frame")
    out = poses.join(p, (F.col("tracklet_id") == F.col("_t")) & F.col("frame_index").between(F.col("first_frame"), F.col("last_frame")))
    return out.drop("_t", "first_frame", "last_frame")


def event_inputs(assessments: DataFrame, features: DataFrame, passes: DataFrame) -> DataFrame:
    """Assessments with the phenotype of their record and the window of their pass; dropped without either.

    features: pass_id, phenotype; passes: pass_id, source_id, first_frame, last_frame, first_us, last_us. A pass without
    times has the moment of the assessment as its window.
    """
    out = assessments.join(features.select("pass_id", "phenotype"), "pass_id").join(passes.select("pass_id", "source_id", "first_frame", "last_frame", "first_us", "last_us"), "pass_id")
    return out.withColumns({"window_start_us": F.coalesce("first_us", "us"), "window_end_us": F.coalesce("last_us", "us")})


def with_source(passes: DataFrame, sources: DataFrame) -> DataFrame:
    """passes with the media of their source, null where it is not registered."""
    s = sources.select(F.col("source_id").alias("_s"), "media_path", "kind")
    return passes.join(s, F.col("source_id") == F.col("_s"), "left").drop("_s")


def clip_plan(events: DataFrame, before: float = CLIP_SECONDS, after: float = CLIP_SECONDS, masked: bool = False) -> DataFrame:
    """Frames of the clip of every alert whose source is known (media_path, first_frame, last_frame, rate).

    Without a rate the frames count as 25 a second. Nothing is retained without a masker, and the reason is kept.
    """
    alerts = events.filter((F.col("level") == "alert") & F.col("media_path").isNotNull())
    rate = F.when(F.col("rate") > 0, F.col("rate")).otherwise(CLIP_RATE)
    reason = F.lit("") if masked else F.lit("no masker configured; a clip may not be written without human masking")
    return alerts.select(
        "pass_id", "media_path", F.greatest(F.col("first_frame") - F.floor(before * rate), F.lit(0)).alias("clip_first"), (F.col("last_frame") + F.floor(after * rate)).alias("clip_last"),
        rate.alias("rate"), F.lit(masked).alias("retained"), reason.alias("failure_reason"),
    )


def perception_report(frames: DataFrame, detections: DataFrame, tracklets: DataFrame, points: DataFrame) -> DataFrame:
    """One row per source: frames, those without a detection, detections, tracklets by their end, poses and keypoints.

    frames: source_id, frame_index; detections: source_id, frame_index, low_confidence; tracklets: source_id,
    tracklet_id, reason; points: source_id, pose_id, low_confidence, visible.
    """
    d = detections.groupBy("source_id").agg(F.count("*").alias("detections"), F.count_if("low_confidence").alias("low_detections"))
    empty = frames.join(detections.select("source_id", "frame_index").distinct(), ["source_id", "frame_index"], "left_anti")
    f = frames.groupBy("source_id").agg(F.count("*").alias("frames")).join(empty.groupBy("source_id").agg(F.count("*").alias("frames_without_detection")), "source_id", "left")
    ends = tracklets.groupBy("source_id", "reason").agg(F.count("*").alias("n"))
    t = ends.groupBy("source_id").agg(F.sum("n").alias("tracklets"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("terminations"))
    pose = points.groupBy("source_id", "pose_id").agg(F.max("low_confidence").alias("low"), F.count("*").alias("k"), F.count_if(~F.col("visible")).alias("hidden"))
    p = pose.groupBy("source_id").agg(F.count("*").alias("poses"), F.count_if("low").alias("low_poses"), F.sum("k").alias("keypoints"), F.sum("hidden").alias("keypoints_not_visible"))
    out = f
    for other in (d, t, p):
        out = out.join(other, "source_id", "left")
    return out.fillna(0)


def run_counters(passes: DataFrame, records: DataFrame, assessments: DataFrame, events: DataFrame) -> DataFrame:
    """One row: passes, valid ones, where the series put the records, scored and other assessments, events, alerts."""
    from ..sources.series import area

    one = [
        passes.agg(F.count("*").alias("passes")),
        records.agg(F.count_if("valid").alias("valid_passes"), *[F.count_if(area() == a).alias(n) for a, n in (("observations", "observations"), ("unattributed", "unattributed"), ("audit", "audited"))]),
        assessments.agg(F.count("*").alias("assessments"), F.count_if(F.col("state") == "scored").alias("scored"), F.count_if(F.col("state") != "scored").alias("insufficient_history")),
        events.agg(F.count("*").alias("events"), F.count_if(F.col("level") == "alert").alias("alerts")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # one row each
    return out


def hold_out(rows: DataFrame, key: str, test: DataFrame) -> DataFrame:
    """The rows whose key is a test key (test: key)."""
    return rows.join(test.select(F.col(test.columns[0]).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")


def held_out_perception(tracklets: DataFrame, assignments: DataFrame, boxes: DataFrame, points: DataFrame, poses: DataFrame, test: DataFrame) -> tuple[DataFrame, ...] | None:
    """Tracklets, boxes, label points and poses of the test animals, poses with the animal as their instance.

    None if no tracklet of a test animal is left: then the whole is evaluated. Labels go by animal, not by frame,
    so animals beside a test animal do not count as missed.
    """
    mine = hold_out(assignments.filter("animal_id IS NOT NULL AND animal_id != ''").select("tracklet_id", "animal_id"), "animal_id", test)
    kept = hold_out(tracklets, "tracklet_id", mine.select("tracklet_id"))
    if kept.isEmpty():
        return None
    p = poses.join(mine.withColumnsRenamed({"tracklet_id": "_t", "animal_id": "instance"}), F.col("tracklet_id") == F.col("_t")).drop("_t")
    return kept, hold_out(boxes, "instance", test), hold_out(points, "instance", test), p
