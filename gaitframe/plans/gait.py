"""Passes, gait features, keypoints, detections, tracker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lane_position, touches_border
from ..operators import passes, perception
from . import views
from .registry import query, r6
from .views import BOXES, FRAMES, WALK


@query("first_crossing", f"WITH {WALK} SELECT tracklet_id, min(frame_index) FILTER (WHERE pv < 0.2 AND position >= 0.2) AS crossing FROM lg GROUP BY 1")
def first_crossing(spark, sf_dir):
    return passes.first_crossing(views.walk(spark, sf_dir), 0.2)


def _segments(up: str, down: str, direction: str) -> str:
    """Entry and exit crossings as lists; each step of the recursion is one pass."""
    step = "(SELECT *, list_min(list_filter(xs, lambda i: i >= greatest(coalesce(en, c), 1))) AS ex FROM (SELECT *, list_min(list_filter(es, lambda i: i >= greatest(c, 1))) AS en FROM {src}))"
    return f"""WITH RECURSIVE {WALK}, l AS (SELECT tracklet_id, count(*) AS n, list(frame_index ORDER BY i) AS fr, coalesce(list(i) FILTER (WHERE {up}), []) AS es, coalesce(list(i) FILTER (WHERE {down}), []) AS xs FROM lg GROUP BY 1),
r AS (SELECT tracklet_id, n, fr, es, xs, seq, c, en, ex FROM {step.format(src="(SELECT *, 0 AS seq, 0::BIGINT AS c FROM l)")}
  UNION ALL SELECT tracklet_id, n, fr, es, xs, seq, c, en, ex FROM {step.format(src="(SELECT tracklet_id, n, fr, es, xs, seq + 1 AS seq, ex + 1 AS c FROM r WHERE en IS NOT NULL AND ex IS NOT NULL AND ex + 1 < n)")}),
b AS (SELECT *, en IS NOT NULL AND ex IS NOT NULL AS whole FROM r)
SELECT tracklet_id, tracklet_id || ':p' || lpad(seq::VARCHAR, 3, '0') AS pass_id, seq AS pass_no, fr[CASE WHEN whole THEN en ELSE c END + 1] AS first_frame, fr[CASE WHEN whole THEN ex ELSE n - 1 END + 1] AS last_frame,
  CASE WHEN whole THEN ex - en + 1 ELSE n - c END AS frame_count, fr[en + 1] AS entry_frame, fr[ex + 1] AS exit_frame, CASE WHEN whole THEN 'complete' ELSE 'partial' END AS completeness,
  CASE WHEN whole THEN '' WHEN en IS NOT NULL THEN 'exit' WHEN ex IS NOT NULL THEN 'entry' ELSE 'entry and exit' END AS missing_boundary, '{direction}' AS direction FROM b"""


@query("lane_passes", _segments("pv < 0.2 AND position >= 0.2", "pv < 0.8 AND position >= 0.8", "forward"))
def lane_passes(spark, sf_dir):
    return passes.segment(views.walk(spark, sf_dir))


@query("reverse_passes", _segments("pv > 0.97 AND position <= 0.97", "pv > 0.02 AND position <= 0.02", "reverse"))
def reverse_passes(spark, sf_dir):
    """The same lane travelled the other way, with boundaries near its ends."""
    return passes.segment(views.walk(spark, sf_dir), 0.97, 0.02)


@query("travel_direction", f"WITH {FRAMES} SELECT DISTINCT pass_id, usable, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy, round(reference, 6) AS reference FROM g")
def travel_direction(spark, sf_dir):
    t = passes.geometry(views.frames(spark, sf_dir)).select("pass_id", "usable", (F.round("ux", 6) + 0.0).alias("ux"), (F.round("uy", 6) + 0.0).alias("uy"), *r6("reference"))
    return t.distinct()


@query(
    "motion_features",
    f"""WITH {FRAMES}, p AS (SELECT *, (x - mx) * ux + (y - my) * uy AS al, (y - my) * ux - (x - mx) * uy AS ac, (hy - my) * ux - (hx - mx) * uy AS hd FROM g),
l AS (SELECT *, CASE WHEN axis AND t - lag(t) OVER w > 0 THEN abs(al - lag(al) OVER w) / (t - lag(t) OVER w) / reference END AS v,
  CASE WHEN axis THEN abs(ac - (coalesce(lag(ac) OVER w, 0) + ac + coalesce(lead(ac) OVER w, 0)) / 3) END AS jit FROM p WINDOW w AS (PARTITION BY pass_id, axis ORDER BY idx))
SELECT pass_id, round(median(v), 5) AS speed, round(CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) WHEN avg(v) IS NOT NULL THEN 0 END, 5) AS speed_variability, round(sqrt(avg(ac ** 2)) / max(reference), 5) AS lateral_sway,
  round(median(jit) / max(reference), 5) AS tracking_jitter, round(avg(abs(hd)) / max(reference), 5) AS head_lateral_offset,
  round(CASE WHEN count(hd - ac) >= 3 THEN (quantile_cont(hd - ac, 0.95) - quantile_cont(hd - ac, 0.05)) / max(reference) END, 5) AS head_bob FROM l GROUP BY pass_id""",
)
def motion_features(spark, sf_dir):
    f = passes.motion_features(views.frames(spark, sf_dir))
    return f.select("pass_id", *[F.round(F.col(c), 5).alias(c) for c in ("speed", "speed_variability", "lateral_sway", "tracking_jitter", "head_lateral_offset", "head_bob")])


LIMBS = {"left": ("lx", "ly"), "right": ("rx", "ry")}
_OFFSETS = FRAMES + """, o AS (SELECT pass_id, reference, 'left' AS limb, (x0 + p11 - x) * ux + (y0 + s13 - y) * uy AS off FROM g UNION ALL SELECT pass_id, reference, 'right', (x0 - p5 - x) * ux + (y0 - s17 - y) * uy FROM g)"""


@query(
    "stride_features",
    f"""WITH {_OFFSETS}, q AS (SELECT pass_id, limb, max(reference) AS len, quantile_cont(off, 0.95) - quantile_cont(off, 0.05) AS e FROM o WHERE off IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT pass_id, round(avg(e) / max(len), 6) AS stride_length, count(*) AS limbs, round(CASE WHEN count(*) = 2 THEN coalesce((max(e) - min(e)) / nullif(max(e) + min(e), 0), 0) END, 6) AS step_asymmetry FROM q GROUP BY 1""",
)
def stride_features(spark, sf_dir):
    return passes.stride_features(passes.limb_offsets(views.frames(spark, sf_dir), LIMBS)).select("pass_id", *r6("stride_length"), "limbs", *r6("step_asymmetry"))


@query("stride_frequency")
def stride_frequency(spark, sf_dir):
    return passes.stride_frequency(passes.limb_offsets(views.frames(spark, sf_dir), LIMBS))


@query(
    "curvature",
    f"""WITH {FRAMES} SELECT pass_id, round(median(CASE WHEN axis THEN abs(0 * (y0 + len0 / 2 - (y0 + 1)) - (x0 - (x0 + 3)) * (0 - len0)) / len0 END) / max(reference), 6) AS spine_lateral_curvature FROM g GROUP BY 1""",
)
def curvature(spark, sf_dir):
    return passes.curvature(views.frames(spark, sf_dir)).select("pass_id", *r6("spine_lateral_curvature"))


_CLOCK = "c AS (SELECT l_orderkey AS pass_id, l_linenumber AS idx, epoch_us(min(l_shipdate)) AS us, min(l_returnflag) != 'R' AS ok FROM lineitem GROUP BY ALL)"


def _clock(spark, sf_dir):
    us = F.unix_micros(F.min("l_shipdate").cast("timestamp"))
    c = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pass_id"), F.col("l_linenumber").alias("idx"))
    return c.agg(us.alias("us"), (F.min("l_returnflag") != "R").alias("reliable"))


@query(
    "sampling_rate",
    f"""WITH {_CLOCK}, e AS (SELECT pass_id, count(*) AS n, bool_and(ok) AS sound, (arg_max(us, idx) - arg_min(us, idx)) / 1e6 AS span FROM c GROUP BY 1)
SELECT pass_id, round(CASE WHEN sound AND n >= 2 AND span > 0 THEN (n - 1) / span END * 1e6, 4) AS sampling_hz FROM e""",
)
def sampling_rate(spark, sf_dir):
    r = passes.sampling_rate(passes.elapsed(_clock(spark, sf_dir)))
    return r.select("pass_id", F.round(F.col("sampling_hz") * 1e6, 4).alias("sampling_hz"))


@query(
    "pass_frame_rate",
    f"""WITH {_CLOCK}, e AS (SELECT pass_id, max(idx) - min(idx) AS fr, (arg_max(us, idx) - arg_min(us, idx)) / 1e6 AS span FROM c GROUP BY 1) SELECT pass_id, round(CASE WHEN span > 0 AND fr > 0 THEN fr / span ELSE 0 END * 1e6, 4) AS rate FROM e""",
)
def pass_frame_rate(spark, sf_dir):
    p = _clock(spark, sf_dir).groupBy("pass_id").agg(F.min("idx").alias("f0"), F.max("idx").alias("f1"), F.min_by("us", "idx").alias("u0"), F.max_by("us", "idx").alias("u1"))
    return p.select("pass_id", F.round(passes.frame_rate(*(F.col(c) for c in ("f0", "f1", "u0", "u1"))) * 1e6, 4).alias("rate"))


@query(
    "pass_validity",
    """WITH g AS (SELECT l_orderkey AS pass_id, count(*) AS frames, count(*) FILTER (WHERE l_quantity > 10) AS usable, count(*) FILTER (WHERE l_quantity > 10 AND l_quantity < 20) AS reduced, max(l_linestatus) = 'O' AS complete,
  min(l_returnflag) != 'R' AS resolved FROM lineitem GROUP BY 1)
SELECT pass_id, CASE WHEN NOT resolved THEN 'unresolved_identity' WHEN frames < 3 THEN 'too_few_frames' WHEN NOT complete THEN 'partial_pass' WHEN usable = 0 THEN 'no_usable_features' WHEN usable < 3 THEN 'too_few_usable_features'
  WHEN reduced / usable > 0.4 THEN 'too_many_reduced_features' ELSE 'valid' END AS validity FROM g""",
)
def pass_validity(spark, sf_dir):
    q = F.col("l_quantity")
    g = views.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pass_id")).agg(
        F.count("*").alias("frames"), F.count_if(q > 10).alias("usable"), F.count_if((q > 10) & (q < 20)).alias("reduced"), (F.max("l_linestatus") == "O").alias("complete"),
        (F.min("l_returnflag") != "R").alias("resolved"),
    )
    v = passes.pass_validity(F.col("resolved"), F.col("complete"), F.col("frames"), F.col("usable"), F.col("reduced"), 3)
    return g.select("pass_id", v.alias("validity"))


# --- keypoints and features' quality ---------------------------------------------------------------

#: Items are keypoints of an order's pose: the return flag is the native name, the tax the confidence.
_MAP = [("A", "nose"), ("N", "withers"), ("R", "nose"), ("R", "tail")]
_NAMES = ["nose", "withers", "tail", "hoof"]
_SKELETON = f"""m AS (SELECT * FROM (VALUES {", ".join(map(str, _MAP))}) v(native, name)), nm AS (SELECT unnest({_NAMES}) AS name),
nt AS (SELECT l_orderkey AS pose_id, l_returnflag AS native, l_linenumber * 3 + position(l_returnflag IN 'ANR') AS position, max(l_quantity) AS x, max(l_tax) * 10 AS conf FROM lineitem GROUP BY ALL),
bst AS (SELECT pose_id, name, x, conf, row_number() OVER (PARTITION BY pose_id, name ORDER BY conf DESC, position) AS k FROM nt JOIN m USING (native)),
sk AS (SELECT p.pose_id, nm.name, CASE WHEN conf >= 0.3 THEN x END AS x, coalesce(conf, 0) AS confidence, CASE WHEN conf >= 0.3 THEN 'visible' ELSE 'not_visible' END AS visibility
  FROM (SELECT DISTINCT pose_id FROM nt) p CROSS JOIN nm LEFT JOIN (SELECT * FROM bst WHERE k = 1) b ON b.pose_id = p.pose_id AND b.name = nm.name)"""


def _skeleton(spark, sf_dir):
    li = views.read(spark, sf_dir, "lineitem")
    place = F.col("l_linenumber") * 3 + F.instr(F.lit("ANR"), F.col("l_returnflag"))
    native = li.groupBy(F.col("l_orderkey").alias("pose_id"), F.col("l_returnflag").alias("native_name"), place.alias("position"))
    native = native.agg(F.max("l_quantity").alias("x"), F.lit(0.0).alias("y"), (F.max("l_tax") * 10).alias("confidence"))
    mapping = spark.createDataFrame(_MAP, "native_name string, name string")
    return perception.skeleton(native, mapping, spark.createDataFrame([(n,) for n in _NAMES], "name string"))


@query("skeleton_points", f"WITH {_SKELETON} SELECT pose_id, name, x, round(confidence, 6) AS confidence, visibility FROM sk")
def skeleton_points(spark, sf_dir):
    return _skeleton(spark, sf_dir).select("pose_id", "name", "x", *r6("confidence"), "visibility")


@query("pose_summary", f"WITH {_SKELETON}, a AS (SELECT pose_id, avg((x IS NOT NULL)::INT) AS coverage, coalesce(avg(CASE WHEN x IS NOT NULL THEN confidence END), 0) AS c FROM sk GROUP BY 1) SELECT pose_id, round(coverage, 6) AS coverage, round(c, 6) AS mean_confidence, c < 0.5 AS low_confidence FROM a")
def pose_summary(spark, sf_dir):
    return perception.pose_summary(_skeleton(spark, sf_dir)).select("pose_id", *r6("coverage", "mean_confidence"), "low_confidence")


#: Orders of a customer are the poses of one pass.
_COVER = f"{_SKELETON}, pp AS (SELECT o_custkey AS pass_id, name, x, confidence FROM sk JOIN orders ON o_orderkey = pose_id), cv AS (SELECT pass_id, name, avg((x IS NOT NULL)::INT) AS coverage, coalesce(avg(CASE WHEN x IS NOT NULL THEN confidence END), 0) AS confidence FROM pp GROUP BY ALL)"


def _coverage(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pose_id"), F.col("o_custkey").alias("pass_id"))
    return passes.coverage(_skeleton(spark, sf_dir).join(o, "pose_id"))


@query("keypoint_coverage", f"WITH {_COVER} SELECT pass_id, name, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence FROM cv")
def keypoint_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir).select("pass_id", "name", *r6("coverage", "confidence"))


#: feature, position of the dependency, point; whether it is available, and the rate it needs.
_DEPENDS = [("speed", 0, "withers"), ("speed", 1, "tail"), ("head_bob", 0, "nose"), ("head_bob", 1, "withers"), ("stance", 0, "hoof")]
_FEATURES = [("speed", True, 0.0), ("head_bob", True, 5.0), ("stance", False, 0.0)]


@query(
    "feature_quality",
    f"""WITH {_COVER}, dp AS (SELECT * FROM (VALUES {", ".join(map(str, _DEPENDS))}) v(feature, position, name)), ft AS (SELECT * FROM (VALUES {", ".join(map(str, _FEATURES))}) v(feature, available, needs)),
lim AS (SELECT pass_id, feature, arg_min(name, {{'c': coverage, 'p': position}}) AS limiting_keypoint, min(coverage) AS coverage, min(confidence) AS confidence FROM cv JOIN dp USING (name) GROUP BY ALL),
v AS (SELECT *, CASE WHEN pass_id % 4 != 0 THEN (pass_id % 8)::DOUBLE END AS hz, CASE WHEN pass_id % 9 != 0 THEN 1.0 END AS value FROM lim JOIN ft USING (feature))
SELECT pass_id, feature, limiting_keypoint, round(coverage, 6) AS coverage, CASE WHEN NOT available THEN 'unavailable' WHEN needs > 0 AND (hz IS NULL OR hz < needs) THEN 'unusable' WHEN value IS NULL THEN 'unusable'
  WHEN coverage >= 0.8 AND confidence >= 0.3 THEN 'good' WHEN coverage >= 0.4 THEN 'reduced' ELSE 'unusable' END AS quality FROM v""",
)
def feature_quality(spark, sf_dir):
    dep = spark.createDataFrame(_DEPENDS, "feature string, position int, name string")
    ft = spark.createDataFrame(_FEATURES, "feature string, available boolean, needs double")
    c = _coverage(spark, sf_dir).join(dep, "name")
    lim = perception.limiting_point(c, ["pass_id"]).join(ft, "feature")
    hz, value = F.when(F.col("pass_id") % 4 != 0, (F.col("pass_id") % 8).cast("double")), F.when(F.col("pass_id") % 9 != 0, 1.0)
    q = passes.feature_quality(F.col("available"), F.col("needs"), hz, value, F.col("coverage"), F.col("confidence"))
    return lim.select("pass_id", "feature", "limiting_keypoint", *r6("coverage"), q.alias("quality"))


# --- detections and tracks -------------------------------------------------------------------------


@query(
    "detections",
    """SELECT l_orderkey || '#' || l_linenumber || ':' || l_linenumber AS detection_id, l_discount * 10 < 0.5 AS low_confidence FROM lineitem WHERE l_discount * 10 >= 0.25""",
)
def detections(spark, sf_dir):
    li = views.read(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("frame_index"), F.col("l_linenumber").alias("position"), (F.col("l_discount") * 10).alias("confidence"))
    return perception.detections(raw).select("detection_id", "low_confidence")


@query("box_places", f"WITH {BOXES} SELECT frame, pi, x1 <= 4 OR y1 <= 4 OR x1 + 60 >= 156 OR y1 + 50 >= 116 AS touches, round((y1 + 25) / 120, 6) AS lane FROM p")
def box_places(spark, sf_dir):
    """Whether a box touches the border of a picture of 160 by 120, and its place in the lane."""
    p, _ = views.boxes(spark, sf_dir)
    return p.select("frame", "pi", touches_border(F.col("box"), F.lit(160), F.lit(120)).alias("touches"), F.round(lane_position(F.col("box"), "y", F.lit(120)), 6).alias("lane"))


def _frames(spark, sf_dir):
    e = views.read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_index"), (us + (F.col("event_id") % 13 - 6) * 3_600_000_000).alias("us"), (F.col("event_type") != "error").alias("reliable"))


_FRAMES = "f AS (SELECT user_id AS source_id, event_id AS frame_index, epoch_us(ts) + (event_id % 13 - 6) * 3600000000 AS us, event_type != 'error' AS reliable FROM events)"
_ANOMALY = f"{_FRAMES}, an AS (SELECT *, coalesce(reliable AND us < last_value(CASE WHEN reliable THEN us END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS anomaly FROM f)"


@query(
    "ingest_report",
    f"""WITH {_ANOMALY} SELECT source_id, count(*) FILTER (WHERE reliable) AS emitted, count(*) FILTER (WHERE NOT reliable) AS excluded, count(*) FILTER (WHERE NOT reliable) AS unreliable, count(*) FILTER (WHERE anomaly) AS anomalies,
  min(frame_index) FILTER (WHERE reliable) AS first_index, max(frame_index) FILTER (WHERE reliable) AS last_index FROM an GROUP BY 1""",
)
def ingest_report(spark, sf_dir):
    return perception.ingest_report(_frames(spark, sf_dir), "exclude")


@query("time_anomalies", f"WITH {_ANOMALY} SELECT source_id, frame_index FROM an WHERE anomaly")
def time_anomalies(spark, sf_dir):
    return perception.time_anomalies(_frames(spark, sf_dir)).filter("anomaly").select("source_id", "frame_index")


@query("kept_frames", f"WITH {_FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_index) AS k FROM f WHERE reliable) SELECT source_id, frame_index FROM n WHERE k <= 30")
def kept_frames(spark, sf_dir):
    """Frames of reliable time, at most 30 a source (the operator's own limit); the others do not count."""
    return perception.kept_frames(_frames(spark, sf_dir), "exclude", 30).select("source_id", "frame_index")


@query(
    "strided_frames",
    f"WITH {_FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_index) AS k FROM f WHERE frame_index % 3 = 0 AND frame_index > 100) SELECT source_id, frame_index FROM n WHERE k <= 20",
)
def strided_frames(spark, sf_dir):
    """Stride 3 after a checkpoint at frame 100, at most 20 frames a source (the operator's own limit)."""
    return perception.strided(_frames(spark, sf_dir), 3, 100, 20).select("source_id", "frame_index")


@query("resumed_frames", f"WITH {_FRAMES}, c AS (SELECT source_id, max(frame_index) AS l FROM f WHERE frame_index < 500 GROUP BY 1) SELECT source_id, frame_index FROM f LEFT JOIN c USING (source_id) WHERE frame_index % 3 = 0 AND (l IS NULL OR frame_index > l)")
def resumed_frames(spark, sf_dir):
    """What a run with stride 3 emits after one that stopped before frame 500."""
    f = _frames(spark, sf_dir)
    return perception.resumed(f, perception.checkpoint(f.filter("frame_index < 500")), 3).select("source_id", "frame_index")


def _tracked(spark, sf_dir):
    p, _ = views.boxes(spark, sf_dir)
    b = p.select((F.col("frame") % 64).cast("string").alias("source_id"), F.col("frame").alias("frame_index"), F.col("pi").cast("long").alias("position"), "box.*")
    return perception.track(b, width=160, height=120)


@query("tracker")
def tracker(spark, sf_dir):
    return _tracked(spark, sf_dir).groupBy("reason").agg(F.count_distinct("tracklet_id").alias("tracks"), F.count("*").alias("boxes"))


@query("tracklet_extents")
def tracklet_extents(spark, sf_dir):
    return perception.tracklets(_tracked(spark, sf_dir)).select("source_id", "tracklet_id", "first_frame", "last_frame", "boxes", "reason", "extent.*")


@query(
    "served_points",
    f"""WITH {BOXES}, b AS (SELECT *, row_number() OVER (PARTITION BY frame, pi ORDER BY iou DESC, ti) AS k FROM pairs WHERE iou >= 0.3), u AS (SELECT frame, pi, ti FROM b WHERE k = 1)
SELECT u.frame, pi, ti, n.name, round(l_quantity + n.o, 6) AS x, CASE WHEN l_partkey % 3 != 0 THEN 1.0 ELSE 0.0 END AS confidence FROM u JOIN li ON l_orderkey = frame AND l_linenumber = ti, (VALUES ('nose', 0), ('tail', 9)) n(name, o)""",
)
def served_points(spark, sf_dir):
    """Each predicted box gets the points of the labelled one it overlaps most."""
    p, t = views.boxes(spark, sf_dir)
    d = p.select(F.lit("s").alias("source_id"), F.col("frame").alias("frame_index"), F.col("pi").alias("detection_id"), "box")
    b = t.select(F.lit("s").alias("source_id"), F.col("frame").alias("frame_index"), F.col("ti").alias("position"), F.col("ti").alias("track_id"), "box")
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("o")) for n, o in (("nose", 0), ("tail", 9))]))
    k = views.lines(spark, sf_dir).select("*", names.alias("n")).select(
        F.lit("s").alias("source_id"), F.col("l_orderkey").alias("frame_index"), F.col("l_linenumber").alias("track_id"), "n.name", (F.col("l_quantity") + F.col("n.o")).alias("x"), F.lit(0.0).alias("y"),
        (F.col("l_partkey") % 3 != 0).alias("visible"),
    )
    out = perception.served_points(d, b, k)
    return out.select(F.col("frame_index").alias("frame"), F.col("detection_id").alias("pi"), F.col("track_id").alias("ti"), "name", *r6("x"), "confidence")
