"""What the findings of the rounds were about: work that grows with a window, rows that meet in coarse bins."""

import itertools
import random

import pytest

from gaitframe.functions import DAY_US
from gaitframe.operators import baseline, identity, passes, report

OBS = "pass_id long, animal_id long, site_key string, us long, v double, k double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_herd_counts_keep_no_set_of_animals_and_count_what_is_not_known(spark):
    r = random.Random(3)
    rows = [(i, r.choice([1, 2, 3, None]), r.choice(["a", "b", None]), r.randrange(12) * DAY_US // 2 + r.choice([0, 0, 999_999, 1_000_000]), 1.0, None) for i in range(150)]
    rows += [(500, None, "c", 0, 1.0, None), (501, 4, "c", 3 * DAY_US, 1.0, None), (502, 5, "d", 0, 1.0, None), (503, 6, "d", 3 * DAY_US + 1, 1.0, None), (504, 6, "d", None, 1.0, None)]
    df = baseline.herd_counts(baseline.history_counts(spark.createDataFrame(rows, OBS)))
    got = {x.pass_id: (x.herd_rows, x.herd_animals) for x in df.collect()}
    assert len(got) == len(rows)
    for p, _, site, t, *_ in rows:
        near = [x[1] for x in rows if None not in (t, x[3], site) and x[2] == site and x[0] != p and t - 3 * DAY_US <= x[3] < t + 1_000_000]
        assert got[p] == (len(near), len({x for x in near if x is not None})), p
    assert "collect_set" not in plan(df)  # held and written for every row, it filled the disk


def made(df, name):
    """Rows that df's operators of a name made in a run."""
    df.collect()

    def walk(p):
        if "AdaptiveSparkPlan" in p.getClass().getName():
            return walk(p.executedPlan())
        if "QueryStageExec" in p.getClass().getName():
            return walk(p.plan())
        own = p.metrics().apply("numOutputRows").value() if p.nodeName().startswith(name) else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().length()))

    return walk(df._jdf.queryExecution().executedPlan())


SIDES = ("site string, l long, a long, b long", "site string, r long, f long, u long")


def overlapping(spark, left, right):
    return identity.overlaps(spark.createDataFrame(left, SIDES[0]), spark.createDataFrame(right, SIDES[1]), ["site"], ("a", "b"), ("f", "u"))


def test_short_intervals_are_not_dealt_to_coarse_bins(spark):
    hour = identity.HOUR_US
    df = overlapping(spark, [("s", i, i * hour, i * hour + 9) for i in range(300)], [("s", i, i * hour + 9, i * hour + 19) for i in range(300)])
    assert made(df, "Generate") <= 4 * 300  # a row's level and bin, on two sides; all levels made 9600, and 90000 candidates each for the last ones
    assert sorted((x.l, x.r) for x in df.collect()) == [(i, i) for i in range(300)]


def test_intervals_of_all_lengths_meet_once(spark):
    r, hour = random.Random(5), identity.HOUR_US
    side = lambda: [(r.choice("st"), i, a := r.randrange(-9000, 9000) * hour // 4, a + int(hour * 16 ** r.uniform(-2, 5))) for i in range(90)]
    for left, right in ((side(), side()), (side(), [(s, i, a, a) for s, i, a, _ in side()]), ([(s, i, a, a) for s, i, a, _ in side()], side()), (side(), [])):
        left, right = [*left, ("s", 900, 5, 4), ("s", 901, None, 4)], [*right, ("s", 900, 4, None), (None, 901, 0, hour)]
        got = sorted((x.l, x.r) for x in overlapping(spark, left, right).collect())
        assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and None not in (*x, *y) and x[2] <= x[3] and y[2] <= y[3] and y[2] <= x[3] and x[2] <= y[3])


def test_recomputation_makes_no_pairs_of_passes(spark):
    rows = [(i, i % 7, "s", i * 60_000_000, float(i % 13), float(i % 5)) for i in range(400)]
    o = spark.createDataFrame(rows, OBS)
    w = o.selectExpr("pass_id", "us - 86400000000 own_start_us", "us own_end_us", "us - 86400000000 herd_start_us", "us + 1000000 herd_end_us")
    df = baseline.recomputed_scores(o, w, ["v", "k"])
    assert sum(made(df, f"{kind}Join") for kind in ("SortMerge", "BroadcastHash", "ShuffledHash")) <= 6 * 400  # pairs of a site and day made over 80000
    assert df.count() == 400


def test_windows_of_all_lengths_equal_brute_force(spark):
    r, day = random.Random(8), DAY_US
    value = lambda: r.choice([None, 0.1, 0.1, 0.1, 2.5, r.random()])
    rows = [(i, r.choice([1, 2, None]), "s", r.choice([None, *[r.randrange(-30 * day, 30 * day)] * 9]), value(), value()) for i in range(200)]
    recorded = [(i, a := r.randrange(-40 * day, 40 * day), a + int(day * r.choice([-1, 0, 1e-6, 0.5, 1, 2, 3.3, 8, 70]))) for i in range(0, 200, 2)]
    o, w = spark.createDataFrame(rows, OBS), spark.createDataFrame(recorded, "pass_id long, a long, b long")
    got = {x.pass_id: x for x in baseline.in_windows(o.join(w, "pass_id", "left"), "animal_id", "a", "b", ["v", "k"], "own").collect()}
    assert got.keys() == {p for p, a, b in recorded if a < b}
    for p, a, b in recorded:
        near = [x for x in rows if x[0] != p and x[1] == rows[p][1] and x[3] is not None and a <= x[3] < b]
        assert p not in got and not near or got[p].own_rows == len(near)
        for k, f in ((4, "v"), (5, "k")):
            s = sorted(x[k] for x in near if x[k] is not None)
            if s:
                centre, spread, *_ = baseline._summary(s)
                assert got[p][f"own_centre_{f}"] == centre and got[p][f"own_spread_{f}"] == pytest.approx(spread if s[0] < s[-1] else 0.0, abs=1e-12)
            elif p in got:
                assert got[p][f"own_centre_{f}"] is None and got[p][f"own_spread_{f}"] == 0.0


def test_a_family_without_a_row_is_absent_from_the_report(spark):
    inputs = {"dataset_name": "d", "dataset_version": "1", "model_identities": {}, "config_digest": "c", "feature_set_version": "1", "skeleton": "s", "site_keys": ["a"]}
    r = report.Report(inputs | {"split": "s"}).add("identity", spark.createDataFrame([(1, 0.5)], "n long, accuracy double").filter("n > 1"))
    assert r.families == [] and "identity was not computed" in r.declared()[-1]


def test_the_direction_does_not_depend_on_the_order_of_rows(spark):
    path = [(0, 4.7, 9.0), (1, 4.2, 8.0), (2, 3.7, 9.0)]  # ends at a right angle to its main axis: the side hangs on the last bit of a sum
    rows = [(p, i, x, y + 20, x, y - 20) for p, order in enumerate(itertools.permutations(path)) for i, x, y in order]
    f = spark.createDataFrame(rows, "pass_id int, idx int, ax double, ay double, bx double, by double").coalesce(1)
    assert {(round(r.ux, 6) + 0.0, round(r.uy, 6)) for r in passes.geometry(f).collect()} == {(0.0, -1.0)}
