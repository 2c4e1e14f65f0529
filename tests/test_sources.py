from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaitframe import config, errors, profiles
from gaitframe.operators import identity, perception, report, run
from gaitframe.sources import delivery, files, isolation, layout, series, stages
from gaitframe.sources.stages import StageStore


def record(i, animal="a", day="pilot", valid=True, at=datetime(2024, 3, 1, 6, 30), value=1.0, quality="good"):
    return (animal, f"p{i}", f"t{i}", at, valid, False, "site", day, [("v", value, quality)])


SCHEMA = "animal_id string, pass_id string, tracklet_id string, observed_at timestamp_ntz, valid boolean, injected boolean, site_key string, day_key string, features array<struct<name string, value double, quality string>>"


def test_series_reads_days_of_any_name(spark, tmp_path):
    s = series.Series(spark, str(tmp_path / "s"), ["v", "k"])
    assert s.read().count() == 0 and s.animals().count() == 0
    rows = [record(1), record(2, day="", at=None), record(3, None), record(4, valid=False), record(5, at=datetime(2024, 3, 2)), record(6, "b", quality="unusable")]
    s.append(spark.createDataFrame(rows, SCHEMA))
    got = [r.pass_id for r in s.read(start="2024-03-01 00:00:00", end="2024-03-02 00:00:00").collect()]
    assert got == ["p1", "p6"]  # the day is called pilot; the end is left out
    assert s.read(animal_ids=[]).count() == 0 and [r.pass_id for r in s.read(animal_ids=["b"]).collect()] == ["p6"]
    assert [r.pass_id for r in s.read(exclude_pass_ids=["p1", "p6"]).collect()] == ["p5"]
    assert {r.pass_id: r.features for r in s.observations().collect()} == {"p1": {"v": 1.0}, "p5": {"v": 1.0}, "p6": {}}
    assert sorted(r.pass_id for r in s.read(area="unattributed").collect()) == ["p2", "p3"] and s.read(area="audit").first().f_v is None
    assert s.read(area="unattributed").filter("pass_id = 'p2'").first().day_key == "unknown"
    assert [r.animal_id for r in s.animals().collect()] == ["a", "b"]
    plan = s.scan(site_key="site", start="2024-03-01 00:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(area" in plan and "GreaterThanOrEqual(observed_at" in plan
    s.append(spark.createDataFrame([record(9)], SCHEMA))
    assert s.read().count() == 4
    s.clear()
    assert s.read().count() == 0


def test_stage_store(spark, tmp_path):
    st = StageStore(spark, str(tmp_path))
    assert st.read("passes") is None and st.stages() == []
    d = spark.createDataFrame([(f"p{i}", "t0", ["", "x", None][i % 3], f"d{i % 2}", 9 - i, f"s{i % 4}") for i in range(9)], "pass_id string, tracklet_id string, site_key string, day_key string, first int, source_id string")
    assert not st.write("passes", d.limit(0)) and st.read("passes") is None
    for _ in range(2):
        assert st.write("passes", d, "first", "lane_pass", "1")
    got = st.read("passes").collect()
    assert [r.sort_key for r in got] == list(range(1, 10)) and {r.record_id for r in got} == {"t0"} and {r.site_key for r in got} == {"x", "unknown"}
    assert sorted(r.pass_id for r in st.read("passes", "x", "d0").collect()) == ["p4"] and st.read("passes", day_key="d0").count() == 9  # a day alone is not looked at
    assert st.read("passes", source_id="s1").count() == 2 and st.stages() == ["passes"]
    assert "PartitionFilters: [isnotnull(site_key" in st.read("passes", "x")._jdf.queryExecution().toString()
    plain = spark.createDataFrame([(1, "a"), (2, "a")], "n int, site_key string")
    st.write("features", plain)
    first = sorted(r.record_id for r in st.read("features").collect())
    st.write("features", plain)
    assert len(set(first)) == 2 and sorted(r.record_id for r in st.read("features").collect()) == first


def events_of(spark, keys, day=0):
    return spark.createDataFrame([(f"k{i}", day * 86_400_000_000 + i, "alert") for i in keys], "idempotency_key string, us long, level string")


def test_delivery_retains_retries_and_knows_duplicates(spark, tmp_path):
    sent, down = [], [2]

    def send(df, batch):
        if down[0]:
            down[0] -= 1
            raise delivery.ConsumerUnavailable
        sent.append(sorted(r.idempotency_key for r in df.collect()))

    d = delivery.Delivery(spark, str(tmp_path), send)
    r = d.export(events_of(spark, [1, 2, 2]), "a")
    assert sent == [["k1", "k2"]] and (r.attempted, r.delivered, r.duplicates, r.retries, r.undelivered) == (3, 3, 1, 2, 0) and d.pending() == []
    down[0] = 3
    r = d.export(events_of(spark, [2, 3]), "b")
    assert r.undelivered == 2 and d.pending() == ["b"] and len(sent) == 1
    again = delivery.Delivery(spark, str(tmp_path), send)  # another run
    r = again.retry_pending()
    assert sent[-1] == ["k3"] and (r.delivered, r.duplicates) == (2, 1) and again.pending() == []
    assert sorted(x.idempotency_key for x in again.delivered().collect()) == ["k1", "k2", "k3"]
    again.export(events_of(spark, [1, 2, 3]), "c")
    assert len(sent) == 2


def test_layouts_are_checked(spark):
    for bad in ({"kind": "video"}, {"path": "{a}", "kind": "tape"}, {"path": "{a}", "colour": 1}, {"path": "{a}/{b}", "order_by": "c"}, {"path": "{a}", "group_by": ["z"]}, {"path": "plain"}):
        with pytest.raises(errors.LayoutError):
            layout.checked_layout(bad)
    paths = spark.createDataFrame([("videos/cam9/2024-03-05/20240305T130428.mp4",), ("videos/cam9/2024-03-05/nonsense.mp4",), ("other.txt",)], "path string")
    spec = {"path": "videos/{camera}/{day}/{stamp}.mp4", "kind": "video", "group_by": ["camera", "day", "stamp"], "timestamp_field": "stamp", "timestamp_format": "yyyyMMdd'T'HHmmss"}
    data = {"name": "d", "version": "1", "site_key": "s", "camera_ids": ["cam9"], "animal_set_keys": ["h"]}
    got = {r.source_id: r for r in layout.registered_sources(paths, spec, data).collect()}
    assert got["d/cam9/2024-03-05/20240305T130428"].start_timestamp == datetime(2024, 3, 5, 13, 4, 28) and got["d/cam9/2024-03-05/nonsense"].start_timestamp is None
    with pytest.raises(errors.RegistrationError, match="not declared"):
        layout.registered_sources(paths, spec, {**data, "camera_ids": ["cam1"]})
    s = spark.createDataFrame([("a", "c", "s", "h", "m", "", None, "video")], "source_id string, camera_id string, site_key string, animal_set_key string, media_path string, day_key string, start_timestamp timestamp, kind string")
    with pytest.raises(errors.RegistrationError) as e:
        layout.checked_sources(s)
    assert e.value.field == "day_key"
    with pytest.raises(errors.RegistrationError):
        layout.checked_sources(s.withColumn("kind", F.lit("tape")).withColumn("day_key", F.lit("d")))


def test_files_on_disk(spark, tmp_path):
    import zipfile

    for p in ("day1/a/2.jpg", "day1/a/1.jpg", "day1/b/1.png", "day2/x.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("in/1.jpg", "a")
        z.writestr("in/2.txt", "b")
    found = files.listing(spark, str(tmp_path), contents=True)
    assert sorted(r.path for r in found.collect()) == ["all.zip", "day1/a/1.jpg", "day1/a/2.jpg", "day1/b/1.png", "day2/x.txt"]
    specs = [{"name": "z", "kind": "archive_members", "archive": "all.zip", "pattern": ".*[.]jpg"}, {"name": "d", "kind": "dirs", "pattern": "day1/.*"}, {"name": "f", "kind": "files", "pattern": ".*[.]jpg"}]
    assert {r.name: r.counted for r in layout.count_contents(found, specs).collect()} == {"z": 1, "d": 2, "f": 2}
    data = {"name": "d", "version": "7", "site_key": "s", "camera_ids": ["c"], "animal_set_keys": ["h"]}
    s = layout.folder_sources(found, data)
    assert sorted((r.source_id, r.day_key) for r in s.collect()) == [("d/day1/a", "day1"), ("d/day1/b", "day1")]
    s = s.withColumn("media_paths", F.when(F.col("source_id") == "d/day1/b", F.array(F.lit("day1/b/1.png"), F.lit("day1/a/1.jpg"))))
    got = sorted((r.source_id, r.frame_index, r.path, r.offset_seconds) for r in layout.source_frames(s, found, 2.0).collect())
    assert got == [("d/day1/a", 0, "day1/a/1.jpg", 0.0), ("d/day1/a", 1, "day1/a/2.jpg", 0.5), ("d/day1/b", 0, "day1/b/1.png", 0.0), ("d/day1/b", 1, "day1/a/1.jpg", 0.5)]
    with pytest.raises(FileNotFoundError):
        layout.source_frames(s.withColumn("media_paths", F.array(F.lit("gone.jpg"))), found)


def test_config_digest_covers_what_decides_results():
    base = {"species_profile": "cattle", "species_profile_version": "1", "dataset_name": "d", "dataset_version": "1"}
    one = config.resolved(base)
    assert config.digest(one) == config.digest(config.resolved({**base, "run": {"workers": 9}, "notes": "x", "perception": {"device": "cpu"}}))
    assert config.digest(one) != config.digest(config.resolved({**base, "baseline": {"herd_min_animals": 4}})) and len(config.digest(one)) == 64
    assert config.from_yaml("species_profile: cattle\nspecies_profile_version: '1'\ndataset_name: d\ndataset_version: '1'") == one
    for bad in ({}, {**base, "colour": 1}, {**base, "baseline": {"x": 1}}, {**base, "models": {"pose": {"name": "x"}}}, {**base, "perception": {"pose_backend": "magic"}}):
        with pytest.raises(errors.ConfigError):
            config.resolved(bad)


PROFILE = {
    "species": "cow", "version": 1, "skeleton": {"identifier": "s", "version": 0, "view": "lateral", "roles": {"front": "w"}, "keypoints": [{"name": "w"}, {"name": "t"}]},
    "weights": {"pose": {"licence": "unknown", "runtime": "mmpose", "placeholder": True, "placeholder_reason": "other animals"}, "detector": {"licence": "MIT"}},
    "feature_set": {"version": 1, "features": [{"name": "speed", "unit": "u", "depends_on": ["w", "t"], "view": "lateral", "higher_is_worse": False}, {"name": "stance", "unit": "s", "available": False}]},
}


def test_profiles(spark, tmp_path):
    import yaml

    p = profiles.checked(PROFILE)
    profiles.check_features(p, ["speed"])
    profiles.check_views(p, "lateral")
    assert profiles.unlicensed(p) == ["pose"] and profiles.placeholders(p) == {"pose": "other animals"} and profiles.role(p, "front") == "w"
    assert [(r.feature, r.available, r.higher_is_worse) for r in profiles.dimension(spark, p).orderBy("position").collect()] == [("speed", True, False), ("stance", False, True)]
    for call in (lambda: profiles.check_views(p, ""), lambda: profiles.check_views(profiles.checked({**PROFILE, "skeleton": {**PROFILE["skeleton"], "view": "top"}}))):
        with pytest.raises(errors.ViewMismatchError):
            call()
    with pytest.raises(errors.UndeclaredFeatureError):
        profiles.check_features(p, ["wings"])
    with pytest.raises(errors.UnimplementedFeatureError):
        profiles.check_features(profiles.checked({**PROFILE, "feature_set": {"version": 1, "features": [{"name": "wings"}]}}))
    for bad in ({"species": "x"}, {**PROFILE, "feature_set": {"version": 1, "features": [{"name": "speed", "depends_on": ["nose"]}]}}):
        with pytest.raises(errors.ProfileError):
            profiles.checked(bad)
    with pytest.raises(errors.ProfileError):
        profiles.check_runtime(p, "pose")
    with pytest.raises(errors.ProfileError):
        profiles.default_name(str(tmp_path))
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(PROFILE))
    assert profiles.default_name(str(tmp_path)) == "a" and profiles.load(str(tmp_path), "a")["species"] == "cow"
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(PROFILE))
    with pytest.raises(errors.ProfileError):
        profiles.default_name(str(tmp_path))
    (tmp_path / "b.yaml").write_text(yaml.safe_dump({**PROFILE, "default": True}))
    assert profiles.default_name(str(tmp_path)) == "b"


def test_report_fingerprint_and_limitations(spark):
    inputs = {"dataset_name": "d", "dataset_version": "1", "model_identities": {"pose": "p@1"}, "split": "s", "config_digest": "c", "feature_set_version": "1", "skeleton": "k", "site_keys": ["a"], "unavailable_features": {"stance": "no contact"}, "feature_names": ["speed", "stance"], "placeholder_weights": {"pose": "x"}}
    row = spark.createDataFrame([(0.123456789012, 4)], "precision double, tp long")
    a, b = (report.Report(inputs).add("detection", row.withColumn("precision", F.col("precision") + d)) for d in (0.0, 1e-12))
    assert a.fingerprint() == b.fingerprint() and a.fingerprint() != report.Report(inputs).fingerprint()
    text = " ".join(a.declared())
    assert "1 distinct site" in text and "No site-disjoint" in text and "1 of 2 declared" in text and "placeholder" in text
    a.injections.append("speed: -0.3")
    assert a.declared()[-1].startswith("Injected") and "## detection" in a.render() and a.families[0]["counts"] == {"tp": 4}
    assert report.served_labels({"pose": {"dataset-label@1"}, "detection": {"yolo@1"}})[0].startswith("The pose family")


def test_held_out_perception(spark):
    t = spark.createDataFrame([("t1",), ("t2",)], "tracklet_id string")
    a = spark.createDataFrame([("t1", "x"), ("t2", "y")], "tracklet_id string, animal_id string")
    boxes = spark.createDataFrame([(1, "x"), (1, "y")], "frame int, instance string")
    poses = spark.createDataFrame([("q1", "t1"), ("q2", "t2")], "pose_id string, tracklet_id string")
    test = lambda *k: spark.createDataFrame([(x,) for x in k], "animal_id string")
    kept, b, _, p = run.held_out_perception(t, a, boxes, boxes, poses, test("x"))
    assert [r.tracklet_id for r in kept.collect()] == ["t1"] and [r.instance for r in b.collect()] == ["x"] and [(r.pose_id, r.instance) for r in p.collect()] == [("q1", "x")]
    assert run.held_out_perception(t, a, boxes, boxes, poses, test("z")) is None


def test_pictures(spark):
    import numpy as np

    g = np.zeros((60, 80), np.uint8)
    g[5:25, 10:30] = 200
    g[25:40, 30:50] = 161  # touches the first at a corner
    g[50:55, 60:70] = 255  # too small
    d = spark.createDataFrame([("s", 1, 80, 60, bytearray(g.tobytes()))], "source_id string, frame_index long, width int, height int, pixels binary")
    got = [tuple(r)[2:] for r in perception.blobs(d).collect()]
    assert got == [(0, 10.0, 5.0, 50.0, 40.0, 1.0)]
    px = np.array([[0, 0, 0], [255, 255, 255], [255, 255, 255], [31, 32, 64]], np.uint8)
    h = spark.createDataFrame([(1, bytearray(px.tobytes())), (2, None)], "id int, pixels binary")
    e = {r.id: np.array(r.embedding) for r in identity.colour_histogram(h).collect()}
    assert e[1][0] == 0.25 and e[1][511] == 0.5 and e[1][0 * 64 + 1 * 8 + 2] == 0.25 and e[2].sum() == 0


def test_served_points_follow_the_best_box(spark):
    box = lambda x: (float(x), 0.0, float(x) + 10, 10.0)
    kind = "box struct<x1 double, y1 double, x2 double, y2 double>"
    d = spark.createDataFrame([("s", 1, "d1", box(1)), ("s", 1, "d2", box(50))], f"source_id string, frame_index int, detection_id string, {kind}")
    b = spark.createDataFrame([("s", 1, 0, "a", box(2)), ("s", 1, 1, "b", box(0)), ("s", 1, 2, "c", box(59))], f"source_id string, frame_index int, position int, track_id string, {kind}")
    p = spark.createDataFrame([("s", 1, t, "nose", 1.0, 2.0, t == "a") for t in "abc"], "source_id string, frame_index int, track_id string, name string, x double, y double, visible boolean")
    assert [(r.detection_id, r.track_id, r.confidence) for r in perception.served_points(d, b, p).collect()] == [("d1", "a", 1.0)]  # of equals the first


def test_output_must_not_be_tracked(tmp_path):
    import subprocess

    assert isolation.checked_root(str(tmp_path / "out")) == str(tmp_path / "out") and isolation.checked_root("s3a://b/x") == "s3a://b/x"
    tree = tmp_path / "tree"
    tree.mkdir()
    subprocess.run(["git", "init", "-q", str(tree)], check=True)
    (tree / ".gitignore").write_text("data/\n")
    assert isolation.checked_root(str(tree / "data" / "runs"))
    with pytest.raises(errors.IsolationError):
        isolation.checked_root(str(tree / "runs"))


def test_payloads_name_what_is_missing(spark):
    from pyspark.sql import types as T

    d = spark.createDataFrame([("p1", 1.5, None, ["a", "b"]), ("p2", float("nan"), "x", [])], "pass_id string, v double, note string, l array<string>")
    p = stages.payload(d, "thing", "2")
    assert sorted(r.record_id for r in p.collect()) == ["p1", "p2"] and '"schema_name":"thing","schema_version":"2"' in p.first().payload
    need = T.StructType([T.StructField("pass_id", T.StringType(), False), T.StructField("l", T.ArrayType(T.StringType()))])
    assert sorted(map(tuple, stages.from_payload(p, need).collect())) == [("p1", ["a", "b"]), ("p2", [])]
    with pytest.raises(errors.MissingFieldError) as e:
        stages.from_payload(p, T.StructType([T.StructField("note", T.StringType(), False)]), "thing")
    assert e.value.field == "note"


def test_evaluation_says_what_it_lacks(spark):
    items = spark.createDataFrame([(f"p{i}", f"a{i % 5}") for i in range(20)], "pass_id string, animal string")
    inputs = {"dataset_name": "d", "dataset_version": "1", "model_identities": {}, "config_digest": "c", "feature_set_version": "1", "skeleton": "k", "site_keys": ["a", "b"]}
    r = report.evaluate(inputs, items, "animal", {"detection": spark.createDataFrame([(0.5,)], "precision double"), "pose": None})
    assert [f["name"] for f in r.families] == ["detection"] and "pose was not computed" in r.limitations[0] and r.inputs["split"].endswith("train=3:test=2")
    assert not any("site-disjoint" in x for x in r.declared())
