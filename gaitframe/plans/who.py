"""Identity: anchors, regions, nearest neighbours, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, identity, sightings
from ..sources import files
from . import views
from .registry import query, r6
from .views import PAIRS


def _pairs(spark, sf_dir):
    return identity.interval_join(views.tracklets(spark, sf_dir), views.anchors(spark, sf_dir))


@query("anchor_interval_join", f"WITH {PAIRS} SELECT tracklet_id, animal_id, f AS from_us FROM pairs")
def anchor_interval_join(spark, sf_dir):
    return _pairs(spark, sf_dir).select("tracklet_id", "animal_id", "from_us")


@query(
    "anchor_region",
    f"""WITH {PAIRS}, i AS (SELECT *, greatest(least(pos, 40.0) + 30 - greatest(pos, 40.0), 0)::DOUBLE AS w FROM pairs), j AS (SELECT *, w * 10 / (600 - w * 10) AS iou FROM i),
b AS (SELECT *, max(iou) OVER (PARTITION BY tracklet_id) AS best FROM j) SELECT tracklet_id, animal_id, f AS from_us FROM b WHERE best <= 0 OR iou >= 0.9 * best""",
)
def anchor_region(spark, sf_dir):
    box = lambda x: F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 30).alias("x2"), F.lit(10.0).alias("y2"))
    t, n = views.tracklets(spark, sf_dir).withColumn("footprint", box(F.lit(40.0))), views.anchors(spark, sf_dir).withColumn("region", box(F.col("pos")))
    return sightings.in_region(t, n)


#: Every tracklet has a look, too: a similarity and a margin that depend on its id.
_RESOLVED = f"""WITH {PAIRS}, c AS (SELECT tracklet_id, count(DISTINCT animal_id) AS n, min(animal_id) AS one, arg_min(conf, f) AS conf, array_to_string(list_sort(list(DISTINCT animal_id)), ',') AS many FROM pairs GROUP BY 1),
v AS (SELECT tracklet_id, true_animal AS visual, 0.5 + (tracklet_id % 50) / 100.0 AS similarity, (tracklet_id % 10) / 100.0 AS margin FROM t),
j AS (SELECT t.tracklet_id, t.a, t.b, t.site, true_animal, coalesce(n, 0) AS n, one, conf, many, visual, similarity, similarity >= 0.6 AND margin >= 0.02 AS looks FROM t LEFT JOIN c USING (tracklet_id) JOIN v USING (tracklet_id)),
res AS (SELECT tracklet_id, a, b, site, true_animal, CASE WHEN n = 1 THEN 'external_anchor' WHEN n = 0 AND looks THEN 'visual_fallback' ELSE 'unresolved' END AS method,
  CASE WHEN n = 1 THEN one WHEN n = 0 AND looks THEN visual END AS animal_id, round(CASE WHEN n = 1 THEN conf WHEN n = 0 THEN similarity ELSE 0 END, 6) AS confidence,
  CASE WHEN n = 1 OR n = 0 AND looks THEN NULL WHEN n > 1 THEN 'ambiguous_anchor' ELSE 'below_confidence_floor' END AS unresolved_reason,
  CASE WHEN n > 1 THEN many WHEN n = 0 AND NOT looks THEN visual ELSE '' END AS candidates FROM j)"""


def _resolved(spark, sf_dir, names=False):
    """Tracklets and what they are resolved to; the candidates only where names are asked for."""
    t = views.tracklets(spark, sf_dir)
    look = t.select("tracklet_id", F.col("true_animal").alias("animal_id"), (0.5 + F.col("tracklet_id") % 50 / 100.0).alias("similarity"), (F.col("tracklet_id") % 10 / 100.0).alias("margin"))
    return t, identity.resolve(t, sightings.seen(t, views.anchors(spark, sf_dir), names), look, margin_floor=0.02)


@query("identity_resolution", _RESOLVED + " SELECT tracklet_id, method, animal_id, confidence, unresolved_reason, candidates FROM res")
def identity_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir, True)[1].select("tracklet_id", "method", "animal_id", *r6("confidence"), "unresolved_reason", F.concat_ws(",", "candidate_animal_ids").alias("candidates"))


@query("unresolved_reasons", _RESOLVED + " SELECT coalesce(unresolved_reason, 'resolved') AS reason, count(*) AS tracklets FROM res GROUP BY 1")
def unresolved_reasons(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].groupBy(F.coalesce("unresolved_reason", F.lit("resolved")).alias("reason")).agg(F.count("*").alias("tracklets"))


@query(
    "identity_accuracy",
    _RESOLVED
    + """, k AS (SELECT *, CASE WHEN site != 's7' THEN true_animal END AS truth FROM res)
SELECT method, count(*) AS n, count(animal_id) AS resolved, count(*) FILTER (WHERE animal_id = truth) AS correct,
  round(coalesce(count(*) FILTER (WHERE animal_id = truth)::DOUBLE / nullif(count(animal_id), 0), 0), 6) AS accuracy, round(count(animal_id)::DOUBLE / count(*), 6) AS resolution_rate FROM k GROUP BY method""",
)
def identity_accuracy(spark, sf_dir):
    """One site keeps no truth; its tracklets count all the same."""
    t, res = _resolved(spark, sf_dir)
    truth = t.filter("site_key != 's7'").select("tracklet_id", F.col("true_animal").alias("animal_id"))
    return evaluation.identity_accuracy(res, truth).select("method", "n", "resolved", "correct", *r6("accuracy", "resolution_rate"))


_CONFLICTS = ", cf AS (SELECT x.animal_id, x.tracklet_id, y.tracklet_id AS other_id FROM res x JOIN res y ON x.animal_id = y.animal_id AND x.site = y.site AND x.tracklet_id < y.tracklet_id AND x.a <= y.b AND y.a <= x.b)"


def _claimed(spark, sf_dir, names=False):
    """Resolved tracklets with their spans, written once: the conflicts read them several times."""
    t, res = _resolved(spark, sf_dir, names)
    spans = t.select("tracklet_id", F.col("site_key").alias("source_id"), F.col("start_us").alias("first_frame"), F.col("end_us").alias("last_frame"))
    rows = res.join(spans, "tracklet_id")
    rows.write.parquet(path := files.scratch(spark, "claimed"))
    return spark.read.schema(rows.schema).parquet(path)


@query("identity_conflicts", _RESOLVED + _CONFLICTS + " SELECT * FROM cf")
def identity_conflicts(spark, sf_dir):
    return identity.conflicts(_claimed(spark, sf_dir), identity.HOUR_US).select("animal_id", "tracklet_id", "other_id")


@query(
    "identity_withheld",
    _RESOLVED
    + _CONFLICTS
    + """, h AS (SELECT tracklet_id FROM cf UNION SELECT other_id FROM cf) SELECT tracklet_id, CASE WHEN h.tracklet_id IS NULL THEN method ELSE 'unresolved' END AS method,
  CASE WHEN h.tracklet_id IS NULL THEN animal_id END AS animal_id, CASE WHEN h.tracklet_id IS NULL THEN unresolved_reason ELSE 'identity_conflict' END AS unresolved_reason,
  CASE WHEN h.tracklet_id IS NULL THEN candidates ELSE animal_id END AS candidates FROM res LEFT JOIN h USING (tracklet_id)""",
)
def identity_withheld(spark, sf_dir):
    a = _claimed(spark, sf_dir, True)
    out = identity.withhold(a, identity.conflicts(a, identity.HOUR_US))
    return out.select("tracklet_id", "method", "animal_id", "unresolved_reason", F.concat_ws(",", "candidate_animal_ids").alias("candidates"))


@query(
    "nearest_animal",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, g.label AS animal_id, max((list_cosine_similarity(q.v, g.v) + 1) / 2) AS sim FROM e q, e g WHERE q.vec_id % 5 = 0 AND g.vec_id % 5 != 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rk, lead(sim) OVER w AS nx FROM s WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, animal_id))
SELECT query_id, animal_id, round(sim, 6) AS similarity, rk AS rank, round(coalesce(sim - nx, 0), 6) AS margin FROM r WHERE rk <= 2""",
)
def nearest_animal(spark, sf_dir):
    e = views.read(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the view's crops and gallery
    g = e.filter("vec_id % 5 != 0").select(F.col("label").alias("animal_id"), "embedding")
    return identity.nearest(q, g).select("query_id", "animal_id", *r6("similarity"), F.col("rank").cast("long").alias("rank"), *r6("margin"))
