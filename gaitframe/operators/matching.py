"""Boxes of predictions and labels: greedy one-to-one matching, best overlap, detection and tracking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box_iou

IOU = 0.50


def frame_pairs(predictions: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs within a frame with their overlap; a frame holds a bounded number of boxes."""
    p = predictions.select(*keys, "pi", F.col("box").alias("p_box"), *[c for c in predictions.columns if c not in (*keys, "pi", "box")])
    t = labels.select(*keys, "ti", F.col("box").alias("t_box"), *[c for c in labels.columns if c not in (*keys, "ti", "box")])
    return p.join(t, keys).withColumn("iou", box_iou(F.col("p_box"), F.col("t_box")))


def greedy(pairs: DataFrame, keys: list[str], threshold: float = IOU) -> DataFrame:
    """matches: array of (iou, pi, ti) per frame, largest overlap first, every box at most once."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("k"), "pi", "ti")))
    lists = pairs.filter(F.col("iou") >= threshold).groupBy(*keys).agg(entries.alias("_p"))
    fold = """aggregate(_p, slice(_p, 1, 0), (acc, x) -> if(exists(acc, y -> y.pi = x.pi OR y.ti = x.ti), acc, concat(acc, array(x))))"""
    return lists.withColumn("matches", F.expr(fold)).drop("_p")


def detection_counts(predictions: DataFrame, labels: DataFrame, keys: list[str], threshold: float = IOU) -> DataFrame:
    """tp, fp, fn and the sum of overlaps per frame; frames with only predictions or only labels count too."""
    p = predictions.groupBy(*keys).agg(F.count("*").alias("n_p"))
    t = labels.groupBy(*keys).agg(F.count("*").alias("n_t"))
    m = greedy(frame_pairs(predictions, labels, keys), keys, threshold)
    m = m.select(*keys, F.size("matches").alias("tp"), F.aggregate("matches", F.lit(0.0), lambda s, x: s - x["k"]).alias("iou_sum"))
    out = p.join(t, keys, "full").join(m, keys, "left").fillna(0, ["n_p", "n_t", "tp"]).fillna(0.0, ["iou_sum"])
    return out.select(*keys, "tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_t") - F.col("tp")).alias("fn"), "iou_sum")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def detection_metrics(counts: DataFrame) -> DataFrame:
    """One row: true and false positives, misses, precision, recall, F1 and mean overlap of the matches; 0 where nothing is to divide."""
    s = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("iou_sum").alias("iou")).fillna(0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("iou"), tp).alias("mean_iou"))


def best_overlap(pairs: DataFrame, keys: list[str], threshold: float = IOU) -> DataFrame:
    """Per prediction the label of largest overlap, at least threshold; of equals the first label."""
    w = Window.partitionBy(*keys, "pi").orderBy(F.desc("iou"), "ti")
    return pairs.filter(F.col("iou") >= threshold).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


MOSTLY = 0.8


def tracking_metrics(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: identity switches, mean purity, mostly tracked share, mean fragmentation, tracklets and labelled tracks.

    hits: tracklet_id, order, track_id (null where unmatched), every detection of every tracklet; labels: one
    row per labelled box with its track_id. Purity is averaged over tracklets with a match. A track is mostly
    tracked when one tracklet covers 80 % of its boxes; fragments are the tracklets that show it. Tracks are
    known by their id alone, across sources.
    """
    w = Window.partitionBy("tracklet_id").orderBy("order")
    seen = hits.filter("track_id IS NOT NULL")
    switches = seen.withColumn("_p", F.lag("track_id").over(w)).agg(F.count_if(F.col("_p") != F.col("track_id")).alias("switches"))
    per = seen.groupBy("tracklet_id", "track_id").agg(F.count("*").alias("n"))
    pure = per.groupBy("tracklet_id").agg((F.max("n") / F.sum("n")).alias("p")).agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("purity"))
    found = per.groupBy("track_id").agg(F.count("*").alias("pieces"), F.max("n").alias("most"))
    tracks = labels.groupBy("track_id").agg(F.count("*").alias("length")).join(found, "track_id", "left")
    whole = tracks.agg(
        F.coalesce(F.avg(F.when(F.coalesce("most", F.lit(0)) / F.col("length") >= MOSTLY, 1.0).otherwise(0.0)), F.lit(0.0)).alias("mostly_tracked"),
        F.coalesce(F.avg("pieces"), F.lit(0.0)).alias("fragmentation"), F.count("*").alias("tracks"),
    )
    count = hits.agg(F.count_distinct("tracklet_id").alias("tracklets"))
    return switches.crossJoin(pure).crossJoin(whole).crossJoin(count)  # one row each


def pose_pairs(points: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted points (keys, name, x, y, null where not visible) beside their labels (keys, name, x, y, visible, position).

    Of several labels for one point the last by position counts; points without a label are left out. With the
    labelled instance among the keys, several animals of a frame stay apart.
    """
    last = labels.groupBy(*keys, "name").agg(F.max_by(F.struct("x", "y", "visible"), "position").alias("l"))
    return points.join(last, [*keys, "name"]).select(*keys, "name", F.col("x").alias("px"), F.col("y").alias("py"), F.col("l.x").alias("lx"), F.col("l.y").alias("ly"), F.col("l.visible").alias("visible"))


def pose_metrics(points: DataFrame, distance: float = 0.10, normaliser: float = 100.0) -> DataFrame:
    """points: px, py (null where not predicted visible), lx, ly, visible. PCK, visibility agreement and their six counts."""
    has, seen = F.col("px").isNotNull(), F.col("visible")
    both = has & seen
    near = both & (F.hypot(F.col("px") - F.col("lx"), F.col("py") - F.col("ly")) / normaliser <= distance)
    s = points.agg(
        F.count("*").alias("compared"), F.count_if(both).alias("evaluated"), F.count_if(near).alias("correct"), F.count_if(has).alias("claimed_visible"),
        F.count_if(seen).alias("labelled_visible"), F.count_if(has & ~seen).alias("claimed_but_occluded"), F.count_if(has == seen).alias("_agree"),
    )
    return s.withColumn("pck", ratio(F.col("correct"), F.col("evaluated"))).withColumn("visibility_agreement", ratio(F.col("_agree"), F.col("compared"))).drop("_agree")
