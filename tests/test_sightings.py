"""What is said of a tracklet by its anchors needs no row for every pair of them."""

import datetime
import random

import numpy as np
import pytest
from test_findings import made

from gaitframe.operators import identity, sightings
from gaitframe.plans import ORACLES, QUERIES

QUERIES_HERE = ["anchor_region", "identity_resolution", "identity_conflicts", "identity_withheld", "identity_accuracy", "unresolved_reasons"]


def test_the_sweep_finds_every_overlap_once_in_blocks(monkeypatch):
    r = np.random.default_rng(1)
    span = lambda n, most: (a := r.integers(-500, 500, n), a + (most ** r.random(n)).astype(int) - 1)
    for block in (1, 40, 1 << 20):
        monkeypatch.setattr(sightings, "BLOCK", block)
        for n, m in ((60, 80), (60, 0), (0, 80)):
            (a, b), (f, u) = span(n, 30), span(m, 2000)
            blocks = list(sightings.sweep(a, b, f, u))
            assert [x for i, _ in blocks for x in i] == sorted(x for i, _ in blocks for x in i)
            assert len({x for i, _ in blocks for x in i}) == sum(len(set(i)) for i, _ in blocks)
            got = [(x, y) for i, j in blocks for x, y in zip(i, j)]
            assert sorted(got) == [(x, y) for x in range(n) for y in range(m) if f[y] <= b[x] and a[x] <= u[y]]


def sides(spark, longest):
    """Tracklets and anchors of all lengths up to longest hours; some without site, time, camera, animal, footprint or region."""
    r, hour = random.Random(longest), identity.HOUR_US
    box = lambda: r.choice([None, (x := r.randrange(9) * 1.0, 0.0, x + 4, r.choice([0.0, 4.0, None]))])
    span = lambda: r.choice([(None, 4), (5, 4), *[(a := r.randrange(-90 * hour, 90 * hour), a + int(hour * longest ** r.uniform(-1, 1)))] * 9])
    t = [(i, r.choice(["s", "s", "t", None]), r.choice(["c", "d", "", None]), *span(), box()) for i in range(120)]
    n = [(r.choice(["x", "é", "z", "Z", None]), r.choice(["s", "t", None]), r.choice(["c", "", None]), *span(), box(), (i % 3) / 2 if i % 4 else None) for i in range(120)]
    shape = "x1 double, y1 double, x2 double, y2 double"
    return (
        spark.createDataFrame(t, f"tracklet_id int, site_key string, camera_id string, start_us long, end_us long, footprint struct<{shape}>"),
        spark.createDataFrame(n, f"animal_id string, site_key string, camera_id string, from_us long, to_us long, region struct<{shape}>, confidence double"),
    )


@pytest.mark.parametrize("longest", [3, 9_000])
def test_regions_equal_the_pairs_refined(spark, longest):
    t, n = sides(spark, longest)
    rows = lambda df: sorted(tuple(map(str, x)) for x in df.select("tracklet_id", "animal_id", "from_us").collect())
    want = rows(identity.refine_by_region(identity.interval_join(t, n)))
    assert want and rows(sightings.in_region(t, n)) == want == rows(sightings.in_region(t, n, bin_us=identity.HOUR_US // 4))


@pytest.mark.parametrize("longest", [3, 9_000])
def test_animals_seen_equal_those_of_the_pairs(spark, longest):
    t, n = sides(spark, longest)
    got = {x.tracklet_id: x for x in sightings.seen(t, n).collect()}
    pairs = {}
    for x in identity.interval_join(t, n).collect():
        pairs.setdefault(x.tracklet_id, []).append(x)
    assert pairs and got.keys() == pairs.keys()
    for k, found in pairs.items():
        animals = sorted({x.animal_id for x in found if x.animal_id}, key=str.encode)
        assert got[k]._anchored == animals and (got[k]._low, got[k]._high) == ((animals[0], animals[-1]) if animals else (None, None))
        assert got[k]._conf in {x.confidence for x in found if x.from_us == min(y.from_us for y in found)}
    assert {(x.tracklet_id, x._low, x._high, x._conf) for x in sightings.seen(t, n, names=False, bin_us=identity.HOUR_US // 4).collect()} == {(k, x._low, x._high, x._conf) for k, x in got.items()}


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Events of one hour at one site, whose tracklets meet most anchors, others on other days, one without time, an anchor without user."""
    r, start, d = random.Random(7), datetime.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("dense"))
    kinds = ["view", "click", "signup", "purchase", "error"]
    rows = [(i, start + datetime.timedelta(seconds=i * 9), 50 * r.randrange(30), kinds[i % 5], 1.0, "{}") for i in range(400)]
    rows += [(i, start + datetime.timedelta(days=i, seconds=r.randrange(999)), r.randrange(60), kinds[i * 7 % 5], 1.0, "{}") for i in range(400, 700)]
    rows += [(i, start + datetime.timedelta(days=900, minutes=i), 57, "signup", 1.0, "{}") for i in range(700, 720)]
    rows += [(800, None, 50, "error", 1.0, "{}"), (802, start, None, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES_HERE)
def test_queries_make_no_row_for_every_pair(spark, dense, name):
    import duckdb

    df = QUERIES[name](spark, dense)
    tracklets = 400 * 3 // 5 + 300  # with the anchors of the hour they make over 15,000 pairs
    assert sum(made(df, f"{kind}Join") for kind in ("SortMerge", "BroadcastHash", "ShuffledHash")) <= 5 * tracklets
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{dense}/events.parquet/*.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    assert want and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
