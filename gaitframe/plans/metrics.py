"""Matching, detection, tracking and pose metrics, repeatability, agreement, splits, recording rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, matching, power, recording
from ..operators.baseline import long_form
from . import views
from .registry import query, r6
from .views import BOXES, LONG, OBS

_BEST = f"{BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, pi ORDER BY iou DESC, ti) AS k FROM pairs WHERE iou >= 0.5)"


@query("best_overlap", f"WITH {_BEST} SELECT frame, pi, ti, round(iou, 6) AS iou FROM r WHERE k = 1")
def best_overlap(spark, sf_dir):
    p, t = views.boxes(spark, sf_dir)
    return matching.best_overlap(matching.frame_pairs(p, t, ["frame"]), ["frame"]).select("frame", "pi", "ti", *r6("iou"))


#: Takes the best pair that is left, frame by frame, until none is.
_GREEDY = BOXES.replace("li AS", "RECURSIVE li AS", 1) + """, l0 AS (SELECT frame, list({'k': -iou, 'pi': pi, 'ti': ti} ORDER BY -iou, pi, ti) AS l FROM pairs WHERE iou >= 0.5 GROUP BY frame),
gr AS (SELECT frame, l, 0 AS step, NULL::STRUCT(k DOUBLE, pi INT, ti INT) AS m FROM l0
  UNION ALL SELECT frame, list_filter(l, lambda x: x.pi != l[1].pi AND x.ti != l[1].ti), step + 1, {'k': l[1].k, 'pi': l[1].pi, 'ti': l[1].ti} FROM gr WHERE len(l) > 0)"""


@query("greedy_matches", f"WITH {_GREEDY} SELECT frame, m.pi AS pi, m.ti AS ti, round(-m.k, 6) AS iou FROM gr WHERE step > 0")
def greedy_matches(spark, sf_dir):
    p, t = views.boxes(spark, sf_dir)
    m = matching.greedy(matching.frame_pairs(p, t, ["frame"]), ["frame"]).select("frame", F.explode("matches").alias("m"))
    return m.select("frame", "m.pi", "m.ti", F.round(-F.col("m.k"), 6).alias("iou"))


@query(
    "detection_metrics",
    f"""WITH {_GREEDY}, m1 AS (SELECT count(*) AS tp, sum(-m.k) AS s FROM gr WHERE step > 0), c AS (SELECT tp, s, (SELECT count(*) FROM p) - tp AS fp, (SELECT count(*) FROM t) - tp AS fn FROM m1)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(s / tp, 6) AS mean_iou FROM c""",
)
def detection_metrics(spark, sf_dir):
    p, t = views.boxes(spark, sf_dir)
    return matching.detection_metrics(matching.detection_counts(p, t, ["frame"])).select("tp", "fp", "fn", *r6("precision", "recall", "f1", "mean_iou"))


@query(
    "tracking_metrics",
    f"""WITH {_BEST}, h AS (SELECT tracklet_id, track_id, frame * 10 + pi AS o FROM r WHERE k = 1), l AS (SELECT *, lag(track_id) OVER (PARTITION BY tracklet_id ORDER BY o) AS pv FROM h),
g AS (SELECT tracklet_id, track_id, count(*) AS c FROM h GROUP BY ALL), x AS (SELECT max(c) / sum(c) AS purity FROM g GROUP BY tracklet_id), k2 AS (SELECT track_id, count(*) AS pieces, max(c) AS most FROM g GROUP BY 1),
tr AS (SELECT track_id, count(*) AS length FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM l WHERE pv != track_id) AS switches, round((SELECT avg(purity) FROM x), 6) AS purity, round(avg((coalesce(most, 0) / length >= 0.8)::INT), 6) AS mostly_tracked, round(avg(pieces), 6) AS fragmentation,
  count(*) AS tracks, (SELECT count(DISTINCT tracklet_id) FROM p) AS tracklets FROM tr LEFT JOIN k2 USING (track_id)""",
)
def tracking_metrics(spark, sf_dir):
    p, t = views.boxes(spark, sf_dir)
    best = matching.best_overlap(matching.frame_pairs(p, t, ["frame"]), ["frame"]).select("frame", "pi", "track_id")
    hits = p.join(best, ["frame", "pi"], "left").select("tracklet_id", "track_id", (F.col("frame") * 10 + F.col("pi")).alias("order"))
    return matching.tracking_metrics(hits, t).select("switches", *r6("purity", "mostly_tracked", "fragmentation"), "tracks", "tracklets")


_POINTS = """q AS (SELECT l_orderkey AS frame, 'p' || l_linenumber AS name, max(CASE WHEN l_linenumber % 4 != 0 THEN l_quantity END) AS px FROM lineitem GROUP BY ALL),
lb AS (SELECT l_orderkey AS frame, 'p' || (l_linenumber % 5) AS name, l_linenumber AS pos, l_quantity + l_partkey % 20 AS lx, l_partkey % 6 != 0 AS visible FROM lineitem),
la AS (SELECT frame, name, arg_max({'x': lx, 'v': visible}, pos) AS l FROM (SELECT frame, name, pos, max(lx) AS lx, bool_or(visible) AS visible FROM lb GROUP BY ALL) GROUP BY ALL),
j AS (SELECT px, l.x AS lx, l.v AS visible FROM q JOIN la USING (frame, name))"""


@query(
    "pose_metrics",
    f"""WITH {_POINTS}, s AS (SELECT count(*) AS compared, count(*) FILTER (WHERE visible AND px IS NOT NULL) AS evaluated, count(*) FILTER (WHERE visible AND px IS NOT NULL AND abs(px - lx) <= 10) AS correct,
  count(px) AS claimed_visible, count(*) FILTER (WHERE visible) AS labelled_visible, count(*) FILTER (WHERE NOT visible AND px IS NOT NULL) AS claimed_but_occluded, count(*) FILTER (WHERE (px IS NOT NULL) = visible) AS agree FROM j)
SELECT compared, evaluated, correct, claimed_visible, labelled_visible, claimed_but_occluded, round(correct / evaluated, 6) AS pck, round(agree / compared, 6) AS visibility_agreement FROM s""",
)
def pose_metrics(spark, sf_dir):
    """Five labelled points a frame: of the items that share one, the last counts; points without a label are left out."""
    li = views.read(spark, sf_dir, "lineitem")
    pts = li.groupBy(F.col("l_orderkey").alias("frame"), F.concat(F.lit("p"), "l_linenumber").alias("name")).agg(F.max(F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity"))).alias("x"))
    pts = pts.withColumn("y", F.when(F.col("x").isNotNull(), 0.0))
    lab = li.groupBy(F.col("l_orderkey").alias("frame"), F.concat(F.lit("p"), F.col("l_linenumber") % 5).alias("name"), F.col("l_linenumber").alias("position"))
    lab = lab.agg(F.max(F.col("l_quantity") + F.col("l_partkey") % 20).alias("x"), F.bool_or(F.col("l_partkey") % 6 != 0).alias("visible")).withColumn("y", F.lit(0.0))
    m = matching.pose_metrics(matching.pose_pairs(pts, lab, ["frame"]), 0.1, 100.0)
    return m.select("compared", "evaluated", "correct", "claimed_visible", "labelled_visible", "claimed_but_occluded", *r6("pck", "visibility_agreement"))


@query(
    "repeatability",
    f"""WITH {LONG}, g AS (SELECT animal_id, feature, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT feature, count(*) AS animals, avg(CASE WHEN m != 0 THEN s / abs(m) END) AS within_cv, stddev_samp(m) AS between_sd, avg(s) AS within_sd FROM g GROUP BY 1)
SELECT feature, animals, round(within_cv, 6) AS within_cv, round(between_sd, 6) AS between_sd, round(between_sd ** 2 / (between_sd ** 2 + within_sd ** 2), 6) AS icc FROM f""",
)
def repeatability(spark, sf_dir):
    return evaluation.repeatability(long_form(views.obs(spark, sf_dir), ["value", "k"])).select("feature", "animals", *r6("within_cv", "between_sd", "icc"))


@query(
    "rater_agreement",
    """WITH s AS (SELECT avg((quality = toxic)::INT) AS o, avg(quality) AS a, avg(toxic) AS b FROM labels), e AS (SELECT *, a * b + (1 - a) * (1 - b) AS k, 2 * ((a + b) / 2) * (1 - (a + b) / 2) AS g FROM s)
SELECT round(o, 6) AS observed, round(CASE WHEN k < 1 THEN (o - k) / (1 - k) ELSE 0 END, 6) AS kappa, round(CASE WHEN g < 1 THEN (o - g) / (1 - g) ELSE 0 END, 6) AS ac1 FROM e""",
)
def rater_agreement(spark, sf_dir):
    return evaluation.agreement(views.read(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))).select(*r6("observed", "kappa", "ac1"))


def _scores(spark, sf_dir):
    """Three raters and a model: quality, its complement of toxic, and two that follow the id."""
    lab = views.read(spark, sf_dir, "labels")
    raters = (F.col("quality"), 1 - F.col("toxic"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1))
    r = F.explode(F.array(*[F.struct(F.lit(i).alias("rater"), c.cast("int").alias("score")) for i, c in enumerate(raters)]))
    return lab.select(F.col("doc_id").alias("item"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("model"), r.alias("r")).select("item", "model", "r.*")


@query(
    "leave_one_out",
    """WITH c AS (SELECT doc_id, [quality::INT, 1 - toxic::INT, (doc_id % 4 != 0)::INT] AS s, (doc_id % 5 != 0)::INT AS model FROM labels),
l AS (SELECT i AS rater, s[i] AS own, model, list_filter(list_transform([1, 2, 3], lambda j: CASE WHEN j != i THEN s[j] END), lambda x: x IS NOT NULL) AS o FROM c, (VALUES (1), (2), (3)) v(i)),
u AS (SELECT *, o[1] AS v FROM l WHERE o[1] = o[2]),
g AS (SELECT rater, avg((own = v)::INT) AS ho, avg(own) AS ha, avg((model = v)::INT) AS mo, avg(model) AS ma, avg(v) AS va FROM u GROUP BY rater HAVING count(*) >= 10),
k AS (SELECT (ho - (ha * va + (1 - ha) * (1 - va))) / (1 - (ha * va + (1 - ha) * (1 - va))) AS human, (mo - (ma * va + (1 - ma) * (1 - va))) / (1 - (ma * va + (1 - ma) * (1 - va))) AS model FROM g)
SELECT count(*) AS raters, round(avg(model), 6) AS model_agreement, round(avg(human), 6) AS rater_agreement, round(avg(model) - avg(human), 6) AS difference FROM k""",
)
def leave_one_out(spark, sf_dir):
    return evaluation.leave_one_out(_scores(spark, sf_dir)).select("raters", *r6("model_agreement", "rater_agreement", "difference"))


@query("agreement_bootstrap")
def agreement_bootstrap(spark, sf_dir):
    return evaluation.bootstrap_bound(_scores(spark, sf_dir))


@query("power_study")
def power_study(spark, sf_dir):
    return power.power_study(spark)


_SPLIT = f"""WITH {OBS}, ky AS (SELECT DISTINCT {{key}} AS kk FROM obs), o AS (SELECT *, row_number() OVER (ORDER BY sha256('0|' || kk)) AS n, count(*) OVER () AS c FROM ky),
t AS (SELECT kk, CASE WHEN c = 1 OR n <= least(greatest(1, round_even(c * 0.3, 0)), c - 1) THEN 'test' ELSE 'train' END AS part FROM o)
SELECT pass_id, part FROM obs JOIN t ON {{key}} = kk"""


@query("animal_split", _SPLIT.format(key="animal_id"))
def animal_split(spark, sf_dir):
    return evaluation.split(views.obs(spark, sf_dir), "animal_id").select("pass_id", "part")


@query("site_split", _SPLIT.format(key="site_key"))
def site_split(spark, sf_dir):
    return evaluation.split(views.obs(spark, sf_dir), "site_key").select("pass_id", "part")


@query("frame_split", _SPLIT.format(key="pass_id"))
def frame_split(spark, sf_dir):
    return evaluation.split(views.obs(spark, sf_dir), "pass_id").select("pass_id", "part")


@query(
    "split_leakage",
    f"WITH {OBS}, x AS (SELECT animal_id, CASE WHEN pass_id % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM obs) SELECT animal_id FROM x WHERE part = 'train' INTERSECT SELECT animal_id FROM x WHERE part = 'test'",
)
def split_leakage(spark, sf_dir):
    """Keys shared by the parts of a split by rows, which the check must report."""
    return evaluation.overlapping_keys(views.obs(spark, sf_dir).withColumn("part", F.when(F.col("pass_id") % 3 == 0, "test").otherwise("train")), "animal_id")


# --- recording -------------------------------------------------------------------------------------


def _recordings(spark, sf_dir):
    """A supplier is a recording, an order its frame, an item of more than 35 a detection, a part's last digit a tracklet."""
    li = views.read(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey").alias("recording")
    frames = li.groupBy(k, F.col("l_orderkey").alias("frame_index")).agg(F.count_if(F.col("l_quantity") > 35).alias("boxes"))
    sizes = li.filter("l_quantity > 35").select(k, ((F.col("l_quantity") - 10 - F.col("l_suppkey") % 20) / 100).alias("size"))
    centres = li.filter("l_quantity > 35").groupBy(k, (F.col("l_partkey") % 10).alias("tracklet_id"), (F.floor(F.col("l_orderkey") / 10)).alias("frame_index")).agg(F.max(F.col("l_partkey") % 97).cast("double").alias("x"))
    s = views.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("recording"), (F.col("s_suppkey") % 30).cast("double").alias("frame_rate"), F.when(F.col("s_nationkey") > 4, F.col("s_nationkey") > 8).alias("constant"),
        F.when(F.col("s_acctbal") > 0, F.lit("t")).alias("captured_at"), F.lit(100).alias("long_side"),
    )
    t = recording.transits(centres.withColumn("y", F.lit(0.0)), s)
    return s.join(recording.shares(frames, sizes), "recording", "left").join(t, "recording", "left")


_RECORDINGS = """c AS (SELECT l_suppkey AS recording, l_orderkey AS f, count(*) FILTER (WHERE l_quantity > 35) AS boxes FROM lineitem GROUP BY ALL),
sh AS (SELECT recording, avg((boxes > 0)::INT) AS detected, count(*) FILTER (WHERE boxes = 1)::DOUBLE / nullif(count(*) FILTER (WHERE boxes > 0), 0) AS single, count(*) AS frames FROM c GROUP BY 1),
sz AS (SELECT l_suppkey AS recording, list_sort(list((l_quantity - 10 - l_suppkey % 20) / 100)) AS l FROM lineitem WHERE l_quantity > 35 GROUP BY 1),
su AS (SELECT s_suppkey AS recording, (s_suppkey % 30)::DOUBLE AS rate, CASE WHEN s_nationkey > 4 THEN s_nationkey > 8 END AS constant, s_acctbal > 0 AS timed FROM supplier),
ce AS (SELECT l_suppkey AS recording, l_partkey % 10 AS t, l_orderkey // 10 AS f, max(l_partkey % 97)::DOUBLE AS x FROM lineitem WHERE l_quantity > 35 GROUP BY ALL),
en AS (SELECT recording, t, count(*) AS n, min(f) AS f0, max(f) AS f1, abs(arg_max(x, f) - arg_min(x, f)) / 100 AS moved FROM ce GROUP BY ALL),
tr AS (SELECT recording, count(*) AS tracklets, count(*) FILTER (WHERE n >= 2 AND moved >= 0.4) AS traverses, list_sort(list({'s': (f1 - f0 + 1.0) / nullif(rate, 0), 'm': moved}) FILTER (WHERE n >= 2 AND moved >= 0.4)) AS q
  FROM en JOIN su USING (recording) GROUP BY 1),
a AS (SELECT su.*, detected, single, frames, sz.l[len(sz.l) // 2 + 1] AS box_size, tracklets, traverses, q[len(q) // 2 + 1].s AS transit_seconds FROM su LEFT JOIN sh USING (recording) LEFT JOIN sz USING (recording) LEFT JOIN tr USING (recording))"""


@query("recording_shares", f"WITH {_RECORDINGS} SELECT recording, round(detected, 6) AS detected, round(single, 6) AS single, round(box_size, 6) AS box_size, frames, traverses, round(transit_seconds, 6) AS transit_seconds FROM a")
def recording_shares(spark, sf_dir):
    return _recordings(spark, sf_dir).select("recording", *r6("detected", "single", "box_size"), "frames", "traverses", *r6("transit_seconds"))


_CHECKS = f"""{_RECORDINGS}, b AS (SELECT *, coalesce(detected > 0, false) AS anything FROM a), ch AS (
SELECT recording, 'R2' AS requirement, 'frame rate' AS rule, CASE WHEN rate > 0 AND rate < 25 OR constant = false THEN 'fail' WHEN NOT rate > 0 OR constant IS NULL THEN 'unknown' ELSE 'pass' END AS status FROM b
UNION ALL SELECT recording, 'R6', 'capture time', CASE WHEN timed THEN 'unknown' ELSE 'fail' END FROM b
UNION ALL SELECT recording, 'R1', 'animal visibility', CASE WHEN NOT anything THEN 'fail' WHEN detected < 0.3 THEN 'unknown' ELSE 'pass' END FROM b
UNION ALL SELECT recording, 'R3', 'one animal at a time', CASE WHEN NOT anything THEN 'unknown' WHEN single >= 0.9 THEN 'pass' ELSE 'fail' END FROM b
UNION ALL SELECT recording, 'R4', 'framing', CASE WHEN NOT anything THEN 'unknown' WHEN box_size BETWEEN 0.25 AND 0.5 THEN 'pass' ELSE 'fail' END FROM b
UNION ALL SELECT recording, 'R4', 'transit', CASE WHEN NOT anything OR rate <= 0 OR coalesce(tracklets, 0) = 0 THEN 'unknown' WHEN coalesce(traverses, 0) = 0 THEN 'fail' WHEN transit_seconds >= 30 THEN 'pass' ELSE 'fail' END FROM b
UNION ALL SELECT recording, 'R5', 'identity feed', 'unknown' FROM b)"""


def _checks(spark, sf_dir):
    return recording.rules(_recordings(spark, sf_dir), detected=0.3, single=0.9, transit=30.0)


@query("recording_rules", f"WITH {_CHECKS} SELECT * FROM ch")
def recording_rules(spark, sf_dir):
    return _checks(spark, sf_dir)


@query(
    "recording_checks",
    f"""WITH {_CHECKS} SELECT recording, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'unknown') THEN 'unknown' ELSE 'pass' END AS status, NOT bool_or(status = 'fail') AS ok,
  coalesce(array_to_string(list_sort(list(requirement || ' ' || rule) FILTER (WHERE status = 'fail')), ','), '') AS failed, coalesce(array_to_string(list_sort(list(requirement || ' ' || rule) FILTER (WHERE status = 'unknown')), ','), '') AS unknown FROM ch GROUP BY 1""",
)
def recording_checks(spark, sf_dir):
    return recording.combined(_checks(spark, sf_dir)).select("recording", "status", "ok", *[F.concat_ws(",", c).alias(c) for c in ("failed", "unknown")])


@query(
    "recording_windows",
    """WITH c AS (SELECT l_suppkey AS recording, l_orderkey AS f FROM lineitem GROUP BY ALL), m AS (SELECT recording, max(f) + 1 AS n, 1.0 + recording % 3 AS rate FROM c GROUP BY 1)
SELECT c.recording, count(*) AS frames FROM c JOIN m USING (recording) WHERE n <= floor(30 * rate) * 4 OR (f < n // 4 * 4 AND f % (n // 4) < floor(30 * rate)) GROUP BY 1""",
)
def recording_windows(spark, sf_dir):
    """Frames of the four stretches of 30 s of each recording."""
    c = views.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recording"), F.col("l_orderkey").alias("frame_index")).distinct()
    m = c.groupBy("recording").agg((F.max("frame_index") + 1).alias("frames")).withColumn("frame_rate", 1.0 + F.col("recording") % 3)
    return recording.sampled(c, m).groupBy("recording").agg(F.count("*").alias("frames"))


@query(
    "filename_times",
    r"""WITH n AS (SELECT doc_id, 'lane_' || (2020 + doc_id % 5) || '-' || lpad((doc_id % 14)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || CASE WHEN doc_id % 3 = 0 THEN 'T' ELSE '_' END || lpad((doc_id % 24)::VARCHAR, 2, '0') || '-04-28.mp4' AS name FROM documents)
SELECT doc_id, strftime(try_strptime(regexp_extract(name, '(\d{4})[-_]?(\d{2})[-_]?(\d{2})', 1) || regexp_extract(name, '(\d{4})[-_]?(\d{2})[-_]?(\d{2})', 2) || regexp_extract(name, '(\d{4})[-_]?(\d{2})[-_]?(\d{2})', 3)
  || regexp_extract(name, '[T_](\d{2})-04-28', 1) || '0428', '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS captured_at FROM n""",
)
def filename_times(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = F.concat(F.lit("lane_"), (2020 + i % 5).cast("string"), F.lit("-"), two(i % 14), F.lit("-"), two(1 + i % 28), F.when(i % 3 == 0, "T").otherwise("_"), two(i % 24), F.lit("-04-28.mp4"))
    return d.select("doc_id", F.date_format(recording.filename_time(name), "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


@query(
    "constant_rates",
    """WITH r AS (SELECT s_suppkey, CASE WHEN s_nationkey % 7 = 0 THEN '0/0' ELSE (30000 + s_suppkey * 10) || '/1001' END AS a, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE '30/1' END AS n FROM supplier)
SELECT s_suppkey, CASE WHEN a != '0/0' AND n IS NOT NULL THEN abs(split_part(a, '/', 1)::DOUBLE / split_part(a, '/', 2)::DOUBLE - 30) / 30 <= 0.01 END AS constant FROM r""",
)
def constant_rates(spark, sf_dir):
    s = views.read(spark, sf_dir, "supplier")
    a = F.when(F.col("s_nationkey") % 7 == 0, "0/0").otherwise(F.concat((30000 + F.col("s_suppkey") * 10).cast("string"), F.lit("/1001")))
    return s.select("s_suppkey", recording.constant_rate(a, F.when(F.col("s_nationkey") % 5 != 0, "30/1")).alias("constant"))
