"""The joins between the stages of a run, and a run from the series to the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline, events, report, run
from ..sources import files, series, stages
from ..sources.delivery import Delivery
from . import history, metrics, views, who
from .history import _EVENTS, _assessed
from .registry import ORACLES, query
from .tables import FEATURES, REC, records

#: A customer is a tracklet, an order one of its passes (its items the poses), a part priority the reader.
_PASSES = "ps AS (SELECT o_orderkey AS pass_id, o_custkey AS tracklet_id, (o_orderkey % 5)::BIGINT AS f0, (o_orderkey % 5 + 3)::BIGINT AS f1 FROM orders)"


def _passes(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pass_id"), F.col("o_custkey").alias("tracklet_id"), (F.col("o_orderkey") % 5).alias("first_frame"), (F.col("o_orderkey") % 5 + 3).alias("last_frame"))


@query(
    "assigned_passes",
    f"WITH {_PASSES}, a AS (SELECT c_custkey AS t, CASE WHEN c_acctbal > 0 THEN c_name END AS animal FROM customer WHERE c_mktsegment != 'MACHINERY') SELECT pass_id, coalesce(animal, '') AS animal_id, animal IS NOT NULL AS resolved FROM ps LEFT JOIN a ON t = tracklet_id",
)
def assigned_passes(spark, sf_dir):
    c = views.read(spark, sf_dir, "customer").filter("c_mktsegment != 'MACHINERY'")
    a = c.select(F.col("c_custkey").alias("tracklet_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("animal_id"))
    return run.assigned_passes(_passes(spark, sf_dir), a).select("pass_id", "animal_id", "resolved")


_POSES = "po AS (SELECT l_orderkey AS pose_id, l_linenumber AS k, o_custkey AS tracklet_id, l_linenumber AS frame_index FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _poses(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("tracklet_id"))
    li = views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pose_id"), F.col("l_linenumber").alias("frame_index"))
    return li.join(o, F.col("o_orderkey") == F.col("pose_id")).drop("o_orderkey")


@query("pass_poses", f"WITH {_PASSES}, {_POSES} SELECT pass_id, pose_id, frame_index FROM ps JOIN po USING (tracklet_id) WHERE frame_index BETWEEN f0 AND f1")
def pass_poses(spark, sf_dir):
    return run.pass_poses(_passes(spark, sf_dir), _poses(spark, sf_dir)).select("pass_id", "pose_id", "frame_index")


@query("back_filled_poses", "SELECT l_orderkey AS detection_id, l_linenumber AS k, CASE WHEN o_orderstatus = 'F' THEN 't' || o_custkey ELSE '' END AS tracklet_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def back_filled_poses(spark, sf_dir):
    """Poses learn their tracklet from the detection they were estimated on."""
    p = views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("detection_id"), F.col("l_linenumber").alias("k"), F.lit("").alias("tracklet_id"))
    t = views.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("detection_id"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("tracklet_id"))
    return run.back_fill(p, t)


_WINDOWS = """wi AS (SELECT pass_id, us, level, CASE WHEN pass_id % 3 != 0 THEN us - 5000000 END AS first_us, CASE WHEN pass_id % 3 != 0 THEN us + 5000000 END AS last_us, 'src' || pass_id % 4 AS source_id, pass_id AS f0, pass_id + 60 AS f1 FROM keyed)"""


def _windows(spark, sf_dir):
    """Events with the window of their pass; every third pass has no times, and one source in four is not registered."""
    a = _assessed(spark, sf_dir)
    timed = F.col("pass_id") % 3 != 0
    p = a.select(
        "pass_id", F.concat(F.lit("src"), (F.col("pass_id") % 4).cast("string")).alias("source_id"), F.col("pass_id").alias("first_frame"), (F.col("pass_id") + 60).alias("last_frame"),
        F.when(timed, F.col("us") - 5_000_000).alias("first_us"), F.when(timed, F.col("us") + 5_000_000).alias("last_us"),
    )
    ph = a.select("pass_id", F.create_map(F.lit("risk"), F.col("risk_score")).alias("phenotype"))
    e = events.build(run.event_inputs(a, ph, p), "digest")
    src = spark.createDataFrame([(f"src{i}", f"/media/{i}.mp4", "video") for i in range(3)], "source_id string, media_path string, kind string")
    return run.with_source(e, src)


@query("event_windows", f"{_EVENTS}, {_WINDOWS} SELECT pass_id, level, coalesce(first_us, us) AS window_start_us, coalesce(last_us, us) AS window_end_us, CASE WHEN source_id != 'src3' THEN '/media/' || source_id[4:] || '.mp4' END AS media_path FROM wi")
def event_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("pass_id", "level", "window_start_us", "window_end_us", "media_path")


@query(
    "clip_plan",
    f"""{_EVENTS}, {_WINDOWS}, rt AS (SELECT *, CASE WHEN first_us IS NULL THEN 25.0 ELSE (f1 - f0) / 10.0 END AS rate FROM wi WHERE level = 'alert' AND source_id != 'src3')
SELECT pass_id, greatest(f0 - floor(3 * rate), 0)::BIGINT AS clip_first, (f1 + floor(3 * rate))::BIGINT AS clip_last, false AS retained FROM rt""",
)
def clip_plan(spark, sf_dir):
    from ..operators.passes import frame_rate

    e = _windows(spark, sf_dir)
    e = e.withColumn("rate", frame_rate(*(F.col(c) for c in ("first_frame", "last_frame", "first_us", "last_us"))))
    c = run.clip_plan(e)
    return c.select("pass_id", F.col("clip_first").cast("long").alias("clip_first"), F.col("clip_last").cast("long").alias("clip_last"), "retained")


@query(
    "perception_report",
    """WITH f AS (SELECT o_custkey AS source_id, o_orderkey AS fr FROM orders), d AS (SELECT o_custkey AS source_id, l_orderkey AS fr, l_tax < 0.03 AS low FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 30),
t AS (SELECT o_custkey AS source_id, o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT o_custkey AS source_id, l_orderkey AS pose_id, bool_or(l_tax < 0.01) AS low, count(*) AS k, count(*) FILTER (WHERE l_discount < 0.02) AS hidden FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT fa.source_id, frames, coalesce(empty, 0) AS frames_without_detection, coalesce(detections, 0) AS detections, coalesce(low_detections, 0) AS low_detections, tracklets, terminations, coalesce(poses, 0) AS poses, coalesce(low_poses, 0) AS low_poses, coalesce(keypoints, 0) AS keypoints, coalesce(hidden, 0) AS keypoints_not_visible
FROM (SELECT source_id, count(*) AS frames, count(*) FILTER (WHERE fr NOT IN (SELECT fr FROM d)) AS empty FROM f GROUP BY 1) fa LEFT JOIN (SELECT source_id, count(*) AS detections, count(*) FILTER (WHERE low) AS low_detections FROM d GROUP BY 1) USING (source_id)
LEFT JOIN (SELECT source_id, sum(n)::BIGINT AS tracklets, array_to_string(list(reason || '=' || n ORDER BY reason), ',') AS terminations FROM t GROUP BY 1) USING (source_id)
LEFT JOIN (SELECT source_id, count(*) AS poses, count(*) FILTER (WHERE low) AS low_poses, sum(k)::BIGINT AS keypoints, sum(hidden)::BIGINT AS hidden FROM p GROUP BY 1) USING (source_id)""",
)
def perception_report(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"), "o_orderstatus")
    li = views.read(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    frames = o.select("source_id", F.col("o_orderkey").alias("frame_index"))
    det = li.filter("l_quantity > 30").select("source_id", F.col("l_orderkey").alias("frame_index"), (F.col("l_tax") < 0.03).alias("low_confidence"))
    tr = o.select("source_id", F.col("o_orderkey").alias("tracklet_id"), F.col("o_orderstatus").alias("reason"))
    pts = li.select("source_id", F.col("l_orderkey").alias("pose_id"), (F.col("l_tax") < 0.01).alias("low_confidence"), (F.col("l_discount") >= 0.02).alias("visible"))
    r = run.perception_report(frames, det, tr, pts)
    ends = F.concat_ws(",", F.transform(F.map_entries("terminations"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return r.withColumn("terminations", ends)


@query(
    "held_out_rows",
    "WITH t AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT k FROM t)",
)
def held_out_rows(spark, sf_dir):
    """The orders of customers that ever had an urgent one."""
    o = views.read(spark, sf_dir, "orders")
    return run.hold_out(o.select("o_orderkey", "o_custkey"), "o_custkey", o.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


_RUN = _EVENTS.replace("FROM events)", "FROM ar WHERE area = 'observations')", 1).replace("value, CAST(", "CASE WHEN event_id % 6 != 0 THEN value END AS value, CAST(", 1)
_RUN = _RUN.replace("WITH obs AS", f"WITH {REC}, obs AS", 1)


def _run(spark, sf_dir):
    """Records into the series, the series into assessments, assessments into delivered events."""
    s = series.Series(spark, files.scratch(spark, "run"), FEATURES)
    r = records(spark, sf_dir)
    s.append(r)
    o = s.scan().select("pass_id", "animal_id", "site_key", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("us"), F.col("f_value").alias("value"), F.col("f_k").alias("k"))
    a = baseline.assess(baseline.deviations(baseline.own_history(baseline.long_form(baseline.history_counts(o), FEATURES)), ["k"]))
    e = events.build(a, "digest")
    d = Delivery(spark, f"{s.root}-export")
    d.export(e.select("idempotency_key", "us", "level", "pass_id"), "run")
    return r, a, e, d


@query("run_events", f"{_RUN} SELECT idempotency_key, pass_id::VARCHAR AS pass_id, level FROM keyed")
def run_events(spark, sf_dir):
    """End to end: what the consumer has after a run."""
    _, _, _, d = _run(spark, sf_dir)
    return spark.read.schema("idempotency_key string, pass_id string, level string").json(f"{d.root}/events").select("idempotency_key", "pass_id", "level")


@query(
    "run_counters",
    f"""{_RUN}, c AS (SELECT count(*) AS passes, count(*) FILTER (WHERE valid) AS valid_passes, count(*) FILTER (WHERE area = 'observations') AS observations, count(*) FILTER (WHERE area = 'unattributed') AS unattributed, count(*) FILTER (WHERE area = 'audit') AS audited FROM ar)
SELECT any_value(c.passes) AS passes, any_value(valid_passes) AS valid_passes, any_value(observations) AS observations, any_value(unattributed) AS unattributed, any_value(audited) AS audited, count(*) AS assessments, count(*) FILTER (WHERE state = 'scored') AS scored,
  count(*) FILTER (WHERE state != 'scored') AS insufficient_history, count(*) AS events, count(*) FILTER (WHERE level = 'alert') AS alerts, count(*) AS delivered FROM keyed, c""",
)
def run_counters(spark, sf_dir):
    r, a, e, d = _run(spark, sf_dir)
    return run.run_counters(r, r, a, e).withColumn("delivered", F.lit(d.report.delivered).cast("long"))




@query("record_payloads", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority FROM orders")
def record_payloads(spark, sf_dir):
    """Records to JSON and back."""
    o = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    back = stages.from_payload(stages.payload(o, "order", "1"), o.schema, "order")
    return back.withColumn("o_totalprice", F.round("o_totalprice", 2))


_FAMILIES = {"detection": ("detection_metrics", ""), "tracking": ("tracking_metrics", ""), "identity": ("identity_accuracy", "method = 'external_anchor'"), "operational": ("alarm_burden", "")}
_COLUMNS = {
    "detection": ["tp", "fp", "fn", "precision", "recall", "f1", "mean_iou"], "tracking": ["switches", "purity", "mostly_tracked", "fragmentation", "tracks", "tracklets"],
    "identity": ["n", "resolved", "correct", "accuracy", "resolution_rate"], "operational": ["alerts", "animal_days", "alarm_burden"],
}


@query(
    "evaluation_report",
    " UNION ALL ".join(
        f"SELECT '{f}' AS family, metric, value FROM (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in _COLUMNS[f])} FROM ({ORACLES[q]}) x {'WHERE ' + w if w else ''}) ON COLUMNS(*) INTO NAME metric VALUE value)"
        for f, (q, w) in _FAMILIES.items()
    ),
)
def evaluation_report(spark, sf_dir):
    """All families of one report; poses have no labels here, which the report says."""
    made = {"detection": metrics.detection_metrics, "tracking": metrics.tracking_metrics, "identity": who.identity_accuracy, "operational": history.alarm_burden}
    rows = {f: made[f](spark, sf_dir).filter(w) if w else made[f](spark, sf_dir) for f, (_, w) in _FAMILIES.items()}
    inputs = {"dataset_name": "driver", "dataset_version": "1", "model_identities": {}, "config_digest": "digest", "feature_set_version": "1", "skeleton": "none", "site_keys": ["a", "b"]}
    r = report.evaluate(inputs, views.obs(spark, sf_dir).select("pass_id", "animal_id"), "animal_id", {**{f: x.select(_COLUMNS[f]) for f, x in rows.items()}, "pose": None})
    got = [(f["name"], k, float(v)) for f in r.families for k, v in (f["metrics"] | f["counts"]).items()]
    return spark.createDataFrame(got, "family string, metric string, value double")
