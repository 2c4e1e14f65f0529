"""Series, stages, layouts, labels, declared counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, layout, series
from ..sources.stages import StageStore
from . import views
from .registry import query, r6

FEATURES = ["value", "k"]


def records(spark, sf_dir):
    """Feature records of all kinds: invalid ones, some without animal or time, features of unusable quality."""
    e = views.read(spark, sf_dir, "events")
    f = lambda n, v, q: F.struct(F.lit(n).alias("name"), v.alias("value"), q.alias("quality"))
    low = F.when(F.col("event_id") % 6 == 0, "unusable").otherwise("good")
    return e.select(
        F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).alias("animal_id"), F.col("event_id").cast("string").alias("pass_id"), F.col("event_id").cast("string").alias("tracklet_id"),
        F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("observed_at"), (F.col("event_id") % 10 != 0).alias("valid"), F.lit(False).alias("injected"),
        F.col("event_type").alias("site_key"), F.date_format("ts", "yyyy-MM-dd").alias("day_key"),
        F.array(f("value", F.col("value"), low), f("k", F.get_json_object("props", "$.k").cast("double"), F.lit("good"))).alias("features"),
    )


REC = """rec AS (SELECT *, event_id % 10 != 0 AS valid, event_id % 7 != 0 AS has_animal, event_id % 11 != 0 AS has_time FROM events),
ar AS (SELECT *, CASE WHEN NOT valid THEN 'audit' WHEN NOT has_animal OR NOT has_time THEN 'unattributed' ELSE 'observations' END AS area,
  CASE WHEN NOT valid THEN 'invalid' WHEN NOT has_animal THEN 'no_animal' WHEN NOT has_time THEN 'no_timestamp' ELSE '' END AS reason FROM rec)"""


@query("series_routing", f"WITH {REC} SELECT area, reason, count(*) AS count FROM ar GROUP BY ALL")
def series_routing(spark, sf_dir):
    return series.routing(records(spark, sf_dir))


@query(
    "series_wide",
    f"""WITH {REC} SELECT area, event_id::VARCHAR AS pass_id, event_type AS site_key, strftime(ts, '%Y-%m-%d') AS day_key, round(CASE WHEN valid AND event_id % 6 != 0 THEN value END, 6) AS f_value,
  CASE WHEN valid AND event_id % 6 != 0 THEN 'good' END AS q_value, round(CASE WHEN valid THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 6) AS f_k FROM ar""",
)
def series_wide(spark, sf_dir):
    return series.wide(records(spark, sf_dir), FEATURES).select("area", "pass_id", "site_key", "day_key", *r6("f_value"), "q_value", *r6("f_k"))


def _series(spark, sf_dir) -> series.Series:
    s = series.Series(spark, files.scratch(spark, "series"), FEATURES)
    s.append(records(spark, sf_dir))
    return s


@query(
    "series_read",
    f"""WITH {REC} SELECT user_id::VARCHAR AS animal_id, event_id::VARCHAR AS pass_id, ts AS observed_at, event_type AS site_key, strftime(ts, '%Y-%m-%d') AS day_key, round(CASE WHEN event_id % 6 != 0 THEN value END, 6) AS f_value FROM ar
WHERE area = 'observations' AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_id NOT IN (1, 2, 3)""",
)
def series_read(spark, sf_dir):
    """Written to the store and read back with every kind of filter."""
    s = _series(spark, sf_dir).read(site_key="click", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", exclude_pass_ids=["1", "2", "3"])
    return s.select("animal_id", "pass_id", "observed_at", "site_key", "day_key", *r6("f_value"))


@query(
    "series_observations",
    f"""WITH {REC} SELECT event_id::VARCHAR AS pass_id, NOT has_animal AS nobody, (event_id % 6 != 0)::BIGINT + 1 AS features, round(CASE WHEN event_id % 6 != 0 THEN value END, 6) AS value, NOT true AS injected FROM ar WHERE area = 'unattributed'""",
)
def series_observations(spark, sf_dir):
    """The map form of what could not be attributed."""
    o = _series(spark, sf_dir).observations(area="unattributed")
    return o.select("pass_id", F.col("animal_id").isNull().alias("nobody"), F.size("features").cast("long").alias("features"), F.round(F.try_element_at("features", F.lit("value")), 6).alias("value"), "injected")


@query("series_animals", f"WITH {REC} SELECT DISTINCT user_id::VARCHAR AS animal_id FROM ar WHERE area = 'observations'")
def series_animals(spark, sf_dir):
    return _series(spark, sf_dir).animals()


@query(
    "stage_read",
    f"""WITH {REC} SELECT event_id::VARCHAR AS record_id, 'feature_record' AS schema_name, event_id AS sort_key, event_type AS site_key, strftime(ts, '%Y-%m-%d') AS day_key, valid FROM ar
WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10'""",
)
def stage_read(spark, sf_dir):
    """A stage written twice and read for one site and day."""
    store = StageStore(spark, files.scratch(spark, "stages"))
    r = records(spark, sf_dir).withColumn("n", F.col("pass_id").cast("long"))
    for _ in range(2):
        store.write("features", r, "n", "feature_record")
    return store.read("features", "view", "2024-01-09").select("record_id", "schema_name", "sort_key", "site_key", "day_key", "valid")


@query("stage_records", "SELECT coalesce(nullif(o_orderstatus, ''), 'unknown') AS site_key, 'unknown' AS day_key, count(*) AS records, count(DISTINCT o_orderkey) AS ids FROM orders GROUP BY ALL")
def stage_records(spark, sf_dir):
    """Records without any id or day: the id is a digest of the record."""
    store = StageStore(spark, files.scratch(spark, "stages"))
    store.write("passes", views.read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "site_key"))
    return store.read("passes").groupBy("site_key", "day_key").agg(F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"))


# --- layouts ---------------------------------------------------------------------------------------

_PATH = "'herd/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '_cam' || doc_id % 3 || '.jpg'"


def _paths(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents")
    path = F.concat(F.lit("herd/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("_cam"), (F.col("doc_id") % 3).cast("string"), F.lit(".jpg"))
    return d.select(path.alias("path"), "n_chars")


@query(
    "layout_sources",
    f"""WITH p AS (SELECT {_PATH} AS path, source, lang, doc_id FROM documents)
SELECT source AS day, lang AS animal, 'cam' || doc_id % 3 AS camera, count(*) AS frames, array_to_string(list(path ORDER BY path), ',') AS paths FROM p GROUP BY ALL""",
)
def layout_sources(spark, sf_dir):
    s = layout.sources_from_layout(_paths(spark, sf_dir), "herd/{day}/{animal}/{frame}_{camera}.jpg", ["day", "animal", "camera"], "frame")
    return s.select("day", "animal", "camera", "frames", F.concat_ws(",", "media_paths").alias("paths"))


DATASET = {"name": "herd", "version": "1", "site_key": "farm", "camera_ids": ["north", "cam1", "cam2"], "animal_set_keys": ["cows"], "view": "lateral"}
LAYOUT = {
    "path": "herd/{day}/{animal}/{frame}_{camera}.jpg", "group_by": ["day", "animal", "camera"], "order_by": "frame", "identity_field": "animal", "camera_map": {"cam0": "north"},
    "start_timestamps": {"src1/en/cam0": "2024-03-01 06:00:00"},
}


@query(
    "registered_sources",
    f"""WITH p AS (SELECT {_PATH} AS path, source, lang, doc_id % 3 AS cam FROM documents)
SELECT 'herd/' || source || '/' || lang || '/cam' || cam AS source_id, CASE cam WHEN 0 THEN 'north' ELSE 'cam' || cam END AS camera_id, 'farm' AS site_key, source AS day_key, lang AS animal_id, min(path) AS media_path, count(*) AS frames,
  CASE WHEN source = 'src1' AND lang = 'en' AND cam = 0 THEN '2024-03-01 06:00:00' END AS start_timestamp FROM p GROUP BY source, lang, cam""",
)
def registered_sources(spark, sf_dir):
    s = layout.registered_sources(_paths(spark, sf_dir), LAYOUT, DATASET)
    stamp = F.date_format("start_timestamp", "yyyy-MM-dd HH:mm:ss").alias("start_timestamp")
    return s.select("source_id", "camera_id", "site_key", "day_key", "animal_id", "media_path", F.size("media_paths").cast("long").alias("frames"), stamp)


@query(
    "folder_sources",
    f"""WITH p AS (SELECT {_PATH} AS path FROM documents), d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir FROM p) SELECT 'herd/' || dir AS source_id, dir AS media_path, split_part(dir, '/', 1) AS day_key, 'image_sequence' AS kind FROM d""",
)
def folder_sources(spark, sf_dir):
    return layout.folder_sources(_paths(spark, sf_dir), DATASET).select("source_id", "media_path", "day_key", "kind")


@query(
    "source_frames",
    f"""WITH p AS (SELECT {_PATH} AS path FROM documents), d AS (SELECT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) - 1 AS i FROM d)
SELECT 'herd/' || dir AS source_id, i AS frame_index, path, round(i / 10.0, 6) AS offset_seconds FROM n""",
)
def source_frames(spark, sf_dir):
    """The pictures of every folder in order, at ten a second."""
    p = _paths(spark, sf_dir)
    s = layout.folder_sources(p, DATASET).withColumn("media_paths", F.array().cast("array<string>"))
    return layout.source_frames(s, p, 10.0).select("source_id", F.col("frame_index").cast("long").alias("frame_index"), "path", *r6("offset_seconds"))


@query(
    "verify_counts",
    """WITH f AS (SELECT source AS name, count(*) AS counted FROM documents GROUP BY 1), d AS (SELECT name, counted + (CASE WHEN name = 'src1' THEN 1 ELSE 0 END) AS expected FROM f UNION ALL SELECT 'absent', 3)
SELECT d.name, expected, coalesce(counted, 0) AS counted, coalesce(counted, 0) = expected AS ok FROM d LEFT JOIN f USING (name)""",
)
def verify_counts(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    declared = d.groupBy("name").agg((F.count("*") + F.max(F.when(F.col("name") == "src1", 1).otherwise(0))).alias("expected"))
    declared = declared.union(spark.createDataFrame([("absent", 3)], "name string, expected long"))
    return layout.verify_counts(d, declared)


@query(
    "content_counts",
    f"""WITH p AS (SELECT {_PATH} AS path FROM documents) SELECT 'pictures' AS name, count(*) AS counted FROM p WHERE path LIKE '%.jpg' UNION ALL SELECT 'days', count(DISTINCT split_part(path, '/', 2)) FROM p UNION ALL SELECT 'cam1', count(*) FROM p WHERE path LIKE '%cam1.jpg'""",
)
def content_counts(spark, sf_dir):
    specs = [{"name": "pictures", "kind": "files", "pattern": r".*\.jpg"}, {"name": "days", "kind": "dirs", "pattern": "herd/[^/]+"}, {"name": "cam1", "kind": "files", "pattern": ".*cam1[.]jpg"}]
    return layout.count_contents(_paths(spark, sf_dir), specs)


# --- labels ----------------------------------------------------------------------------------------


def _annotations(spark, sf_dir):
    li = views.read(spark, sf_dir, "lineitem")
    k = F.array(F.col("l_quantity"), F.col("l_tax") * 100, (F.col("l_partkey") % 3).cast("double"), F.col("l_quantity") + 1, F.col("l_tax") * 50, F.lit(2.0))
    k = F.when(F.col("l_returnflag") == "R", F.slice(k, 1, 3)).otherwise(k)  # too few values
    name = F.concat(F.lit("seq"), F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, ".mp4/").otherwise("/"), F.lpad(F.col("l_linenumber").cast("string"), 6, "0"), F.lit(".jpg"))
    box = F.array(F.col("l_quantity"), F.lit(1.0), F.lit(10.0), F.lit(20.0))
    return li.select(name.alias("file_name"), F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("instance_id"), k.alias("keypoints"), box.alias("bbox"))


@query(
    "keypoint_labels",
    """WITH a AS (SELECT l_orderkey AS o, l_linenumber AS n, [l_quantity, l_tax * 100, (l_partkey % 3)::DOUBLE, l_quantity + 1, l_tax * 50, 2.0] AS k FROM lineitem WHERE l_returnflag != 'R'),
e AS (SELECT o, n, i, k[i * 3 + 1] AS x, k[i * 3 + 2] AS y, k[i * 3 + 3] AS f FROM a, (VALUES (0), (1)) v(i))
SELECT 'seq' || o AS source_id, (n - 1)::INT AS frame_index, n AS instance_id, CASE i WHEN 0 THEN 'nose' ELSE 'withers' END AS name, round(x, 6) AS x, round(y, 6) AS y, f = 2 AS visible FROM e WHERE f > 0""",
)
def keypoint_labels(spark, sf_dir):
    return layout.keypoint_labels(_annotations(spark, sf_dir), ["nose", "withers"]).select("source_id", "frame_index", "instance_id", "name", *r6("x", "y"), "visible")


@query(
    "image_labels",
    "SELECT 'd/customer' || o_custkey AS source_id, 4 AS frame_index, l_linenumber::VARCHAR AS track_id, l_quantity AS x1, l_quantity + 10 AS x2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE 'customer' || o_custkey LIKE '%7'",
)
def image_labels(spark, sf_dir):
    """Boxes that find their file through the image's id; of some sequences only."""
    images = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("/0005.png")).alias("file_name"))
    b = layout.box_labels(layout.by_image(_annotations(spark, sf_dir), images), "d")
    wanted = b.filter(F.col("source_id").rlike("7$")).select(F.substring_index("source_id", "/", -1).alias("s")).distinct()
    b = b.join(wanted, F.substring_index("source_id", "/", -1) == F.col("s"), "left_semi")
    return b.select("source_id", "frame_index", "track_id", F.col("box.x1").alias("x1"), F.col("box.x2").alias("x2"))


@query("frame_labels", "SELECT 'seq' || l_orderkey AS source_id, (l_linenumber - 1)::INT AS frame_index, count(*) AS boxes, min(l_quantity) AS first_x FROM lineitem GROUP BY ALL")
def frame_labels(spark, sf_dir):
    g = layout.boxes_by_frame(layout.box_labels(_annotations(spark, sf_dir)))
    return g.select("source_id", "frame_index", F.size("boxes").cast("long").alias("boxes"), F.array_min(F.transform("boxes", lambda b: b["box"]["x1"])).alias("first_x"))


@query("track_identity", "SELECT DISTINCT l_linenumber::VARCHAR AS track_id, l_linenumber::VARCHAR AS animal_id FROM lineitem")
def track_identity(spark, sf_dir):
    return layout.identity_by_track(layout.box_labels(_annotations(spark, sf_dir)))
