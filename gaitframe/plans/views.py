"""Driver tables as observation tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass_id, animal_id, site_key, us, value and k of the event table."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pass_id"), F.col("user_id").alias("animal_id"), F.col("event_type").alias("site_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


OBS = """obs AS (SELECT event_id AS pass_id, user_id AS animal_id, event_type AS site_key, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
LONG = (
    OBS
    + """, long AS (SELECT pass_id, animal_id, site_key, us, 'value' AS feature, value FROM obs WHERE value IS NOT NULL
UNION ALL SELECT pass_id, animal_id, site_key, us, 'k', k FROM obs WHERE k IS NOT NULL)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and line number, which the table does not promise."""
    least = [F.min(c).alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey", "l_tax", "l_returnflag")]
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least)


LINES = """li AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag
  FROM lineitem GROUP BY ALL)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and labelled boxes: a line item is a box of its order's frame, and boxes of a frame overlap much.

    Labels are moved, and those of returned items are missing.
    """
    li = lines(spark, sf_dir)
    y = ((F.col("l_linenumber") % 2) * 10).cast("double")
    box = lambda x: F.struct(x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 50).alias("y2")).alias("box")
    x = F.col("l_quantity") * 2
    p = li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("pi"), box(x), (F.col("l_suppkey") % 50).alias("tracklet_id"))
    t = li.filter("l_returnflag != 'R'").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("ti"), box(x + (F.col("l_partkey") % 5) * 6), (F.col("l_suppkey") % 40).alias("track_id"))
    return p, t


BOXES = LINES + """, p AS (SELECT l_orderkey AS frame, l_linenumber AS pi, l_quantity * 2 AS x1, (l_linenumber % 2) * 10.0 AS y1, l_suppkey % 50 AS tracklet_id FROM li),
t AS (SELECT l_orderkey AS frame, l_linenumber AS ti, l_quantity * 2 + (l_partkey % 5) * 6 AS x1, (l_linenumber % 2) * 10.0 AS y1, l_suppkey % 40 AS track_id FROM li WHERE l_returnflag != 'R'),
pairs AS (SELECT frame, pi, ti, tracklet_id, track_id, w * h / (60 * 50 * 2 - w * h) AS iou FROM (
  SELECT p.frame, pi, ti, tracklet_id, track_id, greatest(least(p.x1, t.x1) + 60 - greatest(p.x1, t.x1), 0)::DOUBLE AS w, greatest(least(p.y1, t.y1) + 50 - greatest(p.y1, t.y1), 0)::DOUBLE AS h
  FROM p JOIN t ON p.frame = t.frame) q)"""

ANCHORS = ("view", "click")


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are no readings: ten minutes before a camera."""
    e = read(spark, sf_dir, "events").filter(~F.col("event_type").isin(*ANCHORS))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("tracklet_id"), F.concat(F.lit("s"), F.col("user_id") % 50).alias("site_key"), F.concat(F.lit("c"), F.col("event_id") % 2).alias("camera_id"),
        us.alias("start_us"), (us + 600_000_000).alias("end_us"), F.col("user_id").cast("string").alias("true_animal"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks are readings of twenty minutes; views know no camera."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*ANCHORS))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").cast("string").alias("animal_id"), F.concat(F.lit("s"), F.col("user_id") % 50).alias("site_key"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("c"), F.col("event_id") % 2)).alias("camera_id"), us.alias("from_us"), (us + 1_200_000_000).alias("to_us"),
        F.when(F.col("event_type") == "click", 0.4).otherwise(1.0).alias("confidence"), (F.col("event_id") % 100).cast("double").alias("pos"),
    )


PAIRS = """t AS (SELECT event_id AS tracklet_id, 's' || (user_id % 50) AS site, 'c' || (event_id % 2) AS cam, epoch_us(ts) AS a, epoch_us(ts) + 600000000 AS b, user_id::VARCHAR AS true_animal
  FROM events WHERE event_type NOT IN ('view', 'click')),
n AS (SELECT user_id::VARCHAR AS animal_id, 's' || (user_id % 50) AS site, CASE WHEN event_type = 'click' THEN 'c' || (event_id % 2) END AS cam, epoch_us(ts) AS f, epoch_us(ts) + 1200000000 AS u,
  CASE WHEN event_type = 'click' THEN 0.4 ELSE 1.0 END AS conf, (event_id % 100) * 1.0 AS pos FROM events WHERE event_type IN ('view', 'click')),
pairs AS (SELECT tracklet_id, animal_id, f, u, a, b, pos, conf, true_animal, t.site FROM t JOIN n ON t.site = n.site AND f <= b AND a <= u AND (n.cam IS NULL OR n.cam = t.cam))"""


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane positions: an animal's events move in a fixed zig-zag through the lane."""
    c = read(spark, sf_dir, "events").select(F.col("user_id").alias("tracklet_id"), F.col("event_id").alias("frame_index"))
    return c.withColumn("position", (F.col("frame_index") * 37 % 101).cast("double") / 100)


WALK = """wk AS (SELECT user_id AS tracklet_id, event_id AS frame_index, ((event_id * 37) % 101)::DOUBLE / 100 AS position FROM events),
lg AS (SELECT *, lag(position) OVER w AS pv, row_number() OVER w - 1 AS i FROM wk WINDOW w AS (PARTITION BY tracklet_id ORDER BY frame_index))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass per order: its line items are frames of a walking animal. Untaxed items do not show the axis, returned ones not the head."""
    li = lines(spark, sf_dir)
    i = F.col("l_linenumber").cast("double")
    x, y = F.col("l_quantity") / 10 + i, i * 3 + (F.col("l_partkey") % 7).cast("double")
    half = (F.lit(40.0) + F.col("l_suppkey") % 5) / 2
    axis, head = F.col("l_tax") > 0, F.col("l_returnflag") != "R"
    return li.select(
        F.col("l_orderkey").alias("pass_id"), F.col("l_linenumber").alias("idx"), (i * 0.1).alias("t"), F.when(axis, x).alias("ax"), F.when(axis, y + half).alias("ay"),
        F.when(axis, x).alias("bx"), F.when(axis, y - half).alias("by"), F.when(head, F.col("l_quantity") / 8 + i).alias("hx"), F.when(head, i * 3 + 5 + (F.col("l_partkey") % 3).cast("double")).alias("hy"),
        (x + 3).alias("cx"), (y + 1).alias("cy"), (x + (F.col("l_partkey") % 11).cast("double")).alias("lx"), (y + (F.col("l_suppkey") % 13).cast("double")).alias("ly"),
        (x - (F.col("l_partkey") % 5).cast("double")).alias("rx"), (y - (F.col("l_suppkey") % 17).cast("double")).alias("ry"),
    )


FRAMES = LINES + """, f0 AS (SELECT l_orderkey AS pass_id, l_linenumber AS idx, l_linenumber * 0.1::DOUBLE AS t, l_tax > 0 AS axis, l_returnflag != 'R' AS head, l_quantity / 10 + l_linenumber::DOUBLE AS x0,
  l_linenumber::DOUBLE * 3 + (l_partkey % 7)::DOUBLE AS y0, (40.0::DOUBLE + l_suppkey % 5) AS len0, l_quantity / 8 + l_linenumber::DOUBLE AS hx0, l_linenumber::DOUBLE * 3 + 5 + (l_partkey % 3)::DOUBLE AS hy0,
  (l_partkey % 11)::DOUBLE AS p11, (l_partkey % 5)::DOUBLE AS p5, (l_suppkey % 13)::DOUBLE AS s13, (l_suppkey % 17)::DOUBLE AS s17 FROM li),
f AS (SELECT *, CASE WHEN axis THEN x0 END AS x, CASE WHEN axis THEN y0 END AS y, CASE WHEN axis THEN len0 END AS len, CASE WHEN head THEN hx0 END AS hx, CASE WHEN head THEN hy0 END AS hy FROM f0),
s AS (SELECT pass_id, count(x) AS usable, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c, median(len) AS reference, arg_max(x, idx) FILTER (axis) - arg_min(x, idx) FILTER (axis) AS dx,
  arg_max(y, idx) FILTER (axis) - arg_min(y, idx) FILTER (axis) AS dy FROM f GROUP BY 1),
a0 AS (SELECT *, cos(0.5 * atan2(2 * c, vx - vy)) AS u0, sin(0.5 * atan2(2 * c, vx - vy)) AS v0 FROM s WHERE usable >= 3 AND reference > 0),
g AS (SELECT f.*, usable, reference, mx, my, u0 * sg AS ux, v0 * sg AS uy FROM f JOIN (SELECT *, CASE WHEN u0 * dx + v0 * dy < 0 THEN -1 ELSE 1 END AS sg FROM a0) b USING (pass_id))"""
