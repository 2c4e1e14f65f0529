"""Baselines, risk, injection, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import DAY_US
from ..operators import baseline, events
from ..operators.baseline import Injection
from ..sources import files
from ..sources.delivery import Delivery
from . import views
from .registry import query, r6
from .views import LONG, OBS

FEATURES = ["value", "k"]

#: An animal's prior passes count whatever features they have; a feature's values are its own.
_OWN = f"""
hr AS (SELECT *, count(*) OVER (PARTITION BY animal_id ORDER BY us RANGE BETWEEN {21 * DAY_US} PRECEDING AND 1 PRECEDING) AS own_rows FROM obs),
w AS (SELECT l.*, h.own_rows, count(*) OVER v AS own_count, median(l.value) OVER v AS c, mad(l.value) OVER v * 1.4826 AS m, stddev_pop(l.value) OVER v AS sd
  FROM long l JOIN hr h USING (pass_id) WINDOW v AS (PARTITION BY l.animal_id, l.feature ORDER BY l.us RANGE BETWEEN {21 * DAY_US} PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN own_count < 2 THEN 0 WHEN m > 0 THEN m ELSE sd END AS s FROM w),
d AS (SELECT *, CASE WHEN s > 0 THEN (value - c) / s END AS own_z FROM z),
d2 AS (SELECT *, CASE WHEN feature = 'k' THEN -own_z ELSE own_z END AS directed_z FROM d),
a AS (SELECT pass_id, animal_id, site_key, us, max(own_rows) AS observations_available, avg(directed_z) AS risk, avg(own_z) AS own, stddev_pop(directed_z) AS sd, count(directed_z) AS n FROM d2 GROUP BY ALL),
r AS (SELECT *, CASE WHEN observations_available >= 5 AND n > 0 THEN 'scored' ELSE 'insufficient_history' END AS state FROM a)"""


def _history(spark, sf_dir):
    return baseline.own_history(baseline.long_form(baseline.history_counts(views.obs(spark, sf_dir)), FEATURES))


def _assessed(spark, sf_dir):
    return baseline.assess(baseline.deviations(_history(spark, sf_dir), ["k"]))


@query(
    "risk_levels",
    f"""WITH {LONG}, {_OWN} SELECT pass_id, animal_id, state, observations_available, greatest(5 - observations_available, 0) AS shortfall, round(CASE WHEN state = 'scored' THEN risk END, 6) AS risk_score,
  round(CASE WHEN state = 'scored' THEN own END, 6) AS own_deviation, round(CASE WHEN state = 'scored' AND n > 1 THEN sd / sqrt(n) END, 6) AS uncertainty,
  CASE WHEN state != 'scored' THEN 'observation' WHEN risk >= 3 THEN 'alert' WHEN risk >= 2 THEN 'watch' ELSE 'observation' END AS level FROM r""",
)
def risk_levels(spark, sf_dir):
    a = _assessed(spark, sf_dir)
    lev = F.when(F.col("state") == "scored", baseline.level(F.col("risk_score"))).otherwise("observation")
    u = F.when(~F.col("uncertainty").isin(float("inf")), F.round("uncertainty", 6)).alias("uncertainty")
    return a.select("pass_id", "animal_id", "state", "observations_available", "shortfall", *r6("risk_score", "own_deviation"), u, lev.alias("level"))


@query(
    "own_baseline",
    f"""WITH {LONG}, {_OWN} SELECT pass_id, feature, own_count, round(c, 6) AS own_centre, round(s, 6) AS own_spread,
  CASE WHEN own_count < 2 THEN 'undefined' WHEN m > 0 THEN 'mad' ELSE 'stdev' END AS own_kind, round(own_z, 6) AS own_z FROM d""",
)
def own_baseline(spark, sf_dir):
    d = baseline.deviations(_history(spark, sf_dir))
    return d.select("pass_id", "feature", F.col("own_count").cast("long").alias("own_count"), *r6("own_centre", "own_spread"), "own_kind", *r6("own_z"))


_HERD = f"PARTITION BY site_key, feature ORDER BY us RANGE BETWEEN {3 * DAY_US} PRECEDING AND 999999 FOLLOWING EXCLUDE CURRENT ROW"


@query(
    "herd_baseline",
    f"""WITH {LONG}, w AS (SELECT *, count(value) OVER v AS n, median(value) OVER v AS c, mad(value) OVER v * 1.4826 AS m, stddev_pop(value) OVER v AS sd FROM long WINDOW v AS ({_HERD})),
s AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN m > 0 THEN m ELSE sd END AS sp FROM w)
SELECT pass_id, feature, site_key, n AS herd_count, round(c, 6) AS herd_centre, round(sp, 6) AS herd_spread, round(CASE WHEN sp > 0 THEN (value - c) / sp END, 6) AS herd_z FROM s""",
)
def herd_baseline(spark, sf_dir):
    h = baseline.herd(baseline.long_form(views.obs(spark, sf_dir), FEATURES))
    z = baseline.robust_z(F.col("value"), F.col("herd_centre"), F.col("herd_spread"))
    return h.withColumn("herd_z", z).select("pass_id", "feature", "site_key", "herd_count", *r6("herd_centre", "herd_spread", "herd_z"))


@query(
    "window_counts",
    f"""WITH {OBS}, o AS (SELECT *, count(*) OVER (PARTITION BY animal_id ORDER BY us RANGE BETWEEN {21 * DAY_US} PRECEDING AND 1 PRECEDING) AS own_rows FROM obs),
h AS (SELECT x.pass_id, count(*) AS herd_rows, count(DISTINCT y.animal_id) AS herd_animals FROM obs x JOIN obs y ON x.site_key = y.site_key AND y.us >= x.us - {3 * DAY_US} AND y.us < x.us + 1000000 AND x.pass_id != y.pass_id GROUP BY 1)
SELECT pass_id, own_rows, coalesce(herd_rows, 0) AS herd_rows, coalesce(herd_animals, 0) AS herd_animals FROM o LEFT JOIN h USING (pass_id)""",
)
def window_counts(spark, sf_dir):
    return baseline.herd_counts(baseline.history_counts(views.obs(spark, sf_dir))).select("pass_id", "own_rows", "herd_rows", "herd_animals")


@query(
    "recompute",
    f"""WITH {LONG}, {_OWN}, hw AS (SELECT *, count(value) OVER v AS hn, median(value) OVER v AS hc, mad(value) OVER v * 1.4826 AS hm, stddev_pop(value) OVER v AS hsd FROM long WINDOW v AS ({_HERD})),
hs AS (SELECT *, CASE WHEN hn < 2 THEN 0 WHEN hm > 0 THEN hm ELSE hsd END AS sp FROM hw),
hd AS (SELECT pass_id, avg(CASE WHEN sp > 0 THEN (value - hc) / sp END) AS herd FROM hs GROUP BY pass_id)
SELECT pass_id, state, observations_available, round(CASE WHEN state = 'scored' THEN risk END, 6) AS risk_score, round(CASE WHEN state = 'scored' THEN own END, 6) AS own_deviation,
  round(CASE WHEN state = 'scored' THEN herd END, 6) AS herd_deviation, round(CASE WHEN state = 'scored' AND n > 1 THEN sd / sqrt(n) END, 6) AS uncertainty FROM r JOIN hd USING (pass_id)""",
)
def recompute(spark, sf_dir):
    """Own and herd summary and score of every pass, from recorded windows alone."""
    o = views.obs(spark, sf_dir)
    us = F.col("us")
    recorded = {"own_start_us": us - 21 * DAY_US, "own_end_us": us, "herd_start_us": us - 3 * DAY_US, "herd_end_us": us + 1_000_000}
    a = baseline.recomputed_scores(o, o.select("pass_id", *[c.alias(n) for n, c in recorded.items()]), FEATURES, ["k"])
    u = F.when(~F.col("uncertainty").isin(float("inf")), F.round("uncertainty", 6)).alias("uncertainty")
    return a.select("pass_id", "state", F.col("observations_available").cast("long").alias("observations_available"), *r6("risk_score", "own_deviation", "herd_deviation"), u)


#: spec_id, animal, feature, first and last day (from the first observation), shape, magnitude; without animal all, without end for good.
_SPECS = [
    (1, 3, "value", 5, 15, "step", 10.0), (2, 3, "value", 10, 20, "ramp", 4.0), (3, 7, "value", 5, 25, "transient", 8.0), (4, 9, "k", 0, 9, "spike", -2.0), (5, None, "k", 12, 14, "transient", 3.0),
    (6, 4, "value", 20, None, "ramp", 6.0), (7, 5, "gait", 2, 6, "step", 1.0),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in s) + ")" for s in _SPECS)


@query(
    "injection",
    f"""WITH {LONG}, base AS (SELECT min(us) AS m FROM obs), sp AS (SELECT * FROM (VALUES {_VALUES}) v(spec_id, animal_id, feature, d0, d1, shape, magnitude)),
x AS (SELECT l.pass_id, sp.feature, sp.magnitude, shape, d1, l.us >= m + d0 * {DAY_US} AS begun, l.us <= m + d1 * {DAY_US} AS open, (l.us - m - d0 * {DAY_US})::DOUBLE / ((d1 - d0) * {DAY_US}) AS share
  FROM (SELECT DISTINCT pass_id, animal_id, us FROM long) l JOIN sp ON sp.animal_id IS NULL OR l.animal_id = sp.animal_id, base),
w AS (SELECT pass_id, feature, magnitude, CASE WHEN NOT begun THEN 0 WHEN d1 IS NULL THEN 1 WHEN shape IN ('step', 'spike') THEN open::INT WHEN shape = 'ramp' THEN least(share, 1) WHEN open THEN 1 - abs(2 * share - 1) ELSE 0 END AS w FROM x),
g AS (SELECT pass_id, feature, sum(w * magnitude) AS add FROM w WHERE w != 0 GROUP BY ALL)
SELECT l.pass_id, l.feature, round(l.value + coalesce(g.add, 0), 6) AS value, l.pass_id IN (SELECT pass_id FROM g) AS injected FROM long l LEFT JOIN g USING (pass_id, feature)""",
)
def injection(spark, sf_dir):
    o = views.obs(spark, sf_dir)
    m = o.agg(F.min("us")).first()[0] or 0
    specs = [Injection(f, g, s, m + a * DAY_US, None if b is None else m + b * DAY_US, i) for _, i, f, a, b, s, g in _SPECS]
    return baseline.injected(baseline.long_form(o, FEATURES), specs).select("pass_id", "feature", *r6("value"), "injected")


_EVENTS = f"""WITH {LONG}, {_OWN}, ev AS (SELECT pass_id, animal_id, us, state, observations_available, CASE WHEN state != 'scored' THEN 'observation' WHEN risk >= 3 THEN 'alert' WHEN risk >= 2 THEN 'watch' ELSE 'observation' END AS level,
  CASE WHEN state = 'scored' AND n > 1 THEN greatest(0, 1 - least(sd / sqrt(n), 1)) ELSE 0 END AS confidence FROM r),
iso AS (SELECT *, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 != 0 THEN '.' || lpad((us % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS t FROM ev),
keyed AS (SELECT *, substr(sha256(animal_id || '|' || t || '|' || pass_id || '|p0-default@1|digest|' || level), 1, 32) AS idempotency_key FROM iso)"""


def _events(spark, sf_dir):
    return events.build(_assessed(spark, sf_dir), "digest")


@query(
    "health_events",
    _EVENTS
    + """ SELECT pass_id, level, round(confidence, 6) AS confidence, idempotency_key, pass_id || ':risk:event' AS event_id, 'P0: health inference is stubbed. This event is not clinical evidence.' ||
  CASE WHEN state = 'scored' THEN '' WHEN observations_available < 5 THEN '|No risk score: ' || observations_available || ' prior observation(s) within 21 days; 5 required'
  ELSE '|No risk score: no feature had a usable baseline spread' END AS notes FROM keyed""",
)
def health_events(spark, sf_dir):
    return _events(spark, sf_dir).select("pass_id", "level", *r6("confidence"), "idempotency_key", "event_id", F.concat_ws("|", "notes").alias("notes"))


@query("undelivered_events", _EVENTS + " SELECT idempotency_key, pass_id, level FROM keyed WHERE level = 'observation'")
def undelivered_events(spark, sf_dir):
    """What is left to deliver once alerts and watches went out."""
    e = _events(spark, sf_dir)
    return events.undelivered(e, e.filter("level != 'observation'")).select("idempotency_key", "pass_id", "level")


@query("delivered_events", _EVENTS + " SELECT idempotency_key, level FROM keyed")
def delivered_events(spark, sf_dir):
    """Alerts go out first, then everything: what the consumer has got, each key once."""
    e = _events(spark, sf_dir).select("idempotency_key", "us", "level", "pass_id")
    d = Delivery(spark, files.scratch(spark, "delivery"))
    d.export(e.filter("level = 'alert'"), "first")
    d.export(e, "second")
    return spark.read.schema("idempotency_key string, us long, level string, pass_id long").json(f"{d.root}/events").select("idempotency_key", "level")


@query(
    "alarm_burden",
    _EVENTS
    + f""", n AS (SELECT count(DISTINCT (animal_id, us // {DAY_US})) AS animal_days FROM obs) SELECT count(*) FILTER (WHERE level = 'alert') AS alerts, any_value(animal_days) AS animal_days,
  round(count(*) FILTER (WHERE level = 'alert') * 1000.0 / any_value(animal_days), 6) AS alarm_burden FROM ev, n""",
)
def alarm_burden(spark, sf_dir):
    return events.alarm_burden(_events(spark, sf_dir), views.obs(spark, sf_dir)).select("alerts", "animal_days", *r6("alarm_burden"))


@query(
    "lead_time",
    _EVENTS
    + f""", f AS (SELECT animal_id, min(us) AS f FROM ev WHERE level = 'alert' GROUP BY 1), ref AS (SELECT animal_id, max(us) AS u FROM obs GROUP BY 1)
SELECT count(*) AS animals, round(median((u - f)::DOUBLE / {DAY_US}), 6) AS median_lead_days FROM ref JOIN f USING (animal_id)""",
)
def lead_time(spark, sf_dir):
    """Against every animal's last observation."""
    ref = views.obs(spark, sf_dir).groupBy("animal_id").agg(F.max("us").alias("reference_us"))
    return events.lead_time(_events(spark, sf_dir), ref).select("animals", *r6("median_lead_days"))
