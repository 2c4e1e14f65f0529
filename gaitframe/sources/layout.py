"""Sources from path templates, keypoint label documents, declared counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LayoutError, RegistrationError


def template_regex(template: str) -> tuple[str, list[str]]:
    """An anchored pattern and the captured fields of a template such as root/{day}/{animal}/{frame}.jpg."""
    names = re.findall(r"\{(\w+)\}", template)
    if not names or len(set(names)) != len(names):
        raise LayoutError(f"template needs distinct fields: {template}")
    parts = re.split(r"\{\w+\}", template)
    return "^" + "([^/]+)".join(re.escape(p).replace("\\-", "-").replace("\\ ", " ") for p in parts) + "$", names


def captures(path: Column, template: str) -> dict[str, Column]:
    pattern, names = template_regex(template)
    return {n: F.regexp_extract(path, pattern, i + 1) for i, n in enumerate(names)}


def sources_from_layout(paths: DataFrame, template: str, group: list[str], order: str) -> DataFrame:
    """One source per group of fields with its files in order; paths off the template are left out."""
    pattern, names = template_regex(template)
    for need in (*group, order):
        if need not in names:
            raise LayoutError(f"{need} is not captured by {template}")
    rows = paths.filter(F.col("path").rlike(pattern)).select("path", *[c.alias(n) for n, c in captures(F.col("path"), template).items()])
    files = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "path")))
    return rows.groupBy(*group).agg(F.transform(files, lambda x: x["path"]).alias("media_paths"), F.count("*").alias("frames"))


ROLES = {"path", "kind", "group_by", "order_by", "camera_field", "day_field", "identity_field", "camera_map", "timestamp_field", "timestamp_format", "start_timestamps"}


def checked_layout(layout: dict) -> dict:
    """layout, if its kind and keys are known and every role it names is captured by its path."""
    if "path" not in layout:
        raise LayoutError("layout is missing 'path'", "path")
    if unknown := sorted(set(layout) - ROLES):
        raise LayoutError(f"unknown layout keys {unknown}")
    if layout.get("kind", "image_sequence") not in ("image_sequence", "video"):
        raise LayoutError(f"unknown layout kind {layout['kind']!r}", "kind")
    names = template_regex(layout["path"])[1]
    named = {"group_by": layout.get("group_by") or (), **{r: [layout[r]] for r in ("order_by", "identity_field", "timestamp_field") if layout.get(r)}}
    for role, fields in named.items():
        for f in fields:
            if f not in names:
                raise LayoutError(f"{role} names {f!r}, which {layout['path']!r} does not capture", role)
    return layout


def registered_sources(paths: DataFrame, layout: dict, dataset: dict) -> DataFrame:
    """Sources of a dataset (name, site_key, camera_ids, animal_set_keys, view) from the paths its layout matches.

    Camera, day, identity and time come from what the path captures: cameras through camera_map, times by the
    layout's pattern or, by group, from start_timestamps. Without a camera the first declared one counts, one
    that is not declared is refused. A missing day is the day of the time.
    """
    layout = checked_layout(layout)
    pattern, names = template_regex(layout["path"])
    group = list(layout.get("group_by") or [n for n in names if n != layout.get("order_by")])
    order = layout.get("order_by") or None
    cap = captures(F.col("path"), layout["path"])
    rows = paths.filter(F.col("path").rlike(pattern)).select("path", *[c.alias(n) for n, c in cap.items()])
    files = F.array_sort(F.collect_list(F.struct(F.col(order or "path").alias("k"), "path")))
    first = lambda n: F.min_by(n, F.struct(F.col(order or "path"), "path")).alias(f"_{n}")
    s = rows.groupBy(*group).agg(F.transform(files, lambda x: x["path"]).alias("_files"), *[first(n) for n in names if n not in group])
    field = lambda role, default="": (lambda n: (F.col(n) if n in group else F.col(f"_{n}")) if n in names else F.lit(""))(layout.get(role, default))
    camera = field("camera_field", "camera")
    for raw, name in (layout.get("camera_map") or {}).items():
        camera = F.when(field("camera_field", "camera") == raw, name).otherwise(camera)
    key = F.concat_ws("/", *group)
    time = F.try_to_timestamp(field("timestamp_field"), F.lit(layout.get("timestamp_format") or "yyyy")) if layout.get("timestamp_field") else F.lit(None).cast("timestamp")
    for name, value in (layout.get("start_timestamps") or {}).items():
        time = F.coalesce(time, F.when(key == name, F.try_to_timestamp(F.lit(value))))
    time = time.cast("timestamp_ntz")
    video = layout.get("kind") == "video"
    out = s.select(
        F.concat(F.lit(f"{dataset['name']}/"), key).alias("source_id"), F.coalesce(F.nullif(camera, F.lit("")), F.lit(dataset["camera_ids"][0])).alias("camera_id"),
        F.lit(dataset["site_key"]).alias("site_key"), F.lit(dataset["animal_set_keys"][0]).alias("animal_set_key"), F.get("_files", F.lit(0)).alias("media_path"),
        (F.slice("_files", 1, 0) if video else F.col("_files")).alias("media_paths"), time.alias("start_timestamp"),
        F.coalesce(F.nullif(field("day_field", "day"), F.lit("")), F.date_format(time, "yyyy-MM-dd"), F.lit("")).alias("day_key"), F.lit("video" if video else "image_sequence").alias("kind"),
        field("identity_field").alias("animal_id"), F.lit(dataset.get("view", "")).alias("view"),
    )
    odd = out.filter(~F.col("camera_id").isin(list(dataset["camera_ids"]))).select("camera_id").limit(1).collect()
    if odd:
        raise RegistrationError(f"{dataset['name']}: the layout gives camera {odd[0][0]!r}, which is not declared", "camera_ids")
    return checked_sources(out)


REQUIRED = ("source_id", "camera_id", "site_key", "animal_set_key", "media_path")


def checked_sources(sources: DataFrame) -> DataFrame:
    """sources with day_key filled from start_timestamp; refused, by the field, where a later stage would lack something."""
    for c in REQUIRED:
        if c not in sources.columns:
            raise RegistrationError(f"sources lack {c!r}", c)
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    opt = lambda c, kind: F.col(c) if c in sources.columns else F.lit(None).cast(kind)
    out = sources.withColumns({"day_key": F.coalesce(F.nullif(opt("day_key", "string"), F.lit("")), F.date_format(opt("start_timestamp", "timestamp"), "yyyy-MM-dd")), "kind": F.coalesce(opt("kind", "string"), F.lit("video"))})
    rules = {**{c: blank(c) for c in REQUIRED if c != "media_path"}, "day_key": F.col("day_key").isNull(), "kind": ~F.col("kind").isin("video", "image_sequence")}
    found = out.select(F.array_compact(F.array(*[F.when(r, F.lit(c)) for c, r in rules.items()])).alias("bad"), "source_id").filter(F.size("bad") > 0).limit(1).collect()
    if found:
        raise RegistrationError(f"source {found[0][1]!r}: {found[0][0][0]!r} is missing or not known", found[0][0][0])
    return out


VIDEO, IMAGE = ("mp4", "avi", "mkv", "mov"), ("jpg", "jpeg", "png")


def folder_sources(files: DataFrame, dataset: dict, extensions: tuple[str, ...] = (*VIDEO, *IMAGE)) -> DataFrame:
    """One source per video below a folder; without any video one per folder of pictures.

    files: path, relative to the folder. The first folder of a path is its day, else the dataset's version.
    """
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    media = files.withColumn("_e", ext).filter(F.col("_e").isin(list(extensions)))
    videos = media.filter(F.col("_e").isin(list(VIDEO)))
    kind = "image_sequence" if videos.isEmpty() else "video"
    one = videos.select("path") if kind == "video" else media.select(F.regexp_extract("path", r"^(.*?)/?[^/]+$", 1).alias("path")).distinct()
    day = F.when(F.col("path").contains("/") if kind == "video" else F.col("path") != "", F.split("path", "/")[0]).otherwise(dataset["version"])
    name = F.when(F.col("path") == "", ".").otherwise(F.col("path"))
    out = one.select(
        F.concat(F.lit(f"{dataset['name']}/"), name).alias("source_id"), F.lit(dataset["camera_ids"][0]).alias("camera_id"), F.lit(dataset["site_key"]).alias("site_key"),
        F.lit(dataset["animal_set_keys"][0]).alias("animal_set_key"), F.col("path").alias("media_path"), day.alias("day_key"), F.lit(kind).alias("kind"), F.lit(dataset.get("view", "")).alias("view"),
    )
    return checked_sources(out)


def source_frames(sources: DataFrame, files: DataFrame, frame_rate: float = 0.0) -> DataFrame:
    """source_id, frame_index, path and offset_seconds of every picture of the sources.

    An explicit list (media_paths) gives a source's frames in its order; other picture sources have the files
    right below media_path in the order of their names. offset is index / frame_rate, null without a rate.
    Videos are left to a decoder. A listed file that is not there is an error.
    """
    listed = F.coalesce(F.size("media_paths"), F.lit(0)) > 0
    a = sources.filter(listed).select("source_id", F.posexplode("media_paths").alias("frame_index", "path"))
    lost = a.join(files.select("path"), "path", "left_anti").select("path").limit(1).collect()
    if lost:
        raise FileNotFoundError(f"missing file: {lost[0][0]}")
    b = sources.filter(~listed & (F.col("kind") == "image_sequence")).select("source_id", F.col("media_path").alias("_d"))
    pictures = files.filter(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(list(IMAGE))).select("path", F.regexp_extract("path", r"^(.*?)/?[^/]+$", 1).alias("_p"))
    b = b.join(pictures, F.col("_d") == F.col("_p")).select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy("path")) - 1).alias("frame_index"), "path")
    offset = F.col("frame_index") / frame_rate if frame_rate > 0 else F.lit(None).cast("double")
    return a.unionByName(b).withColumn("offset_seconds", offset)


def count_contents(files: DataFrame, specs: list[dict]) -> DataFrame:
    """name, counted of declared contents: files or folders (dirs) whose path matches a pattern, members of an archive.

    specs: name, kind (files, dirs, archive_members), pattern (a regular expression of the whole path), archive.
    files: path and, for archives, content.
    """
    import io
    import tarfile
    import zipfile

    def members(batches):
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
                else:
                    names = [m.name for m in tarfile.open(fileobj=io.BytesIO(data)).getmembers() if m.isfile()]
                yield pa.record_batch([pa.array([path] * len(names)), pa.array(names)], names=["path", "member"])

    out = None
    for s in specs:
        if s["kind"] == "archive_members":
            rows = files.filter(F.col("path") == s["archive"]).select("path", "content").mapInArrow(members, "path string, member string").filter(F.col("member").rlike(f"^(?:{s['pattern']})$"))
        elif s["kind"] == "dirs":
            parts = F.split("path", "/")
            dirs = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
            rows = files.filter(F.col("path").contains("/")).select(dirs.alias("path")).distinct().filter(F.col("path").rlike(f"^(?:{s['pattern']})$"))
        else:
            rows = files.filter(F.col("path").rlike(f"^(?:{s['pattern']})$"))
        one = rows.agg(F.lit(s["name"]).alias("name"), F.count("*").alias("counted"))
        out = one if out is None else out.union(one)
    return out


def verify_counts(found: DataFrame, declared: DataFrame) -> DataFrame:
    """declared (name, expected) beside the counted rows of found (name), or found's own counts (name, counted).

    Nothing declared (null) matches any count.
    """
    n = found if "counted" in found.columns else found.groupBy("name").agg(F.count("*").alias("counted"))
    out = declared.join(n, "name", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return out.withColumn("ok", F.col("expected").isNull() | (F.col("counted") == F.col("expected")))


_FRAME = r"^([^/]+?)(?:\.mp4)?/(\d+)\.(?:jpg|jpeg|png)$"


def by_image(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """annotations (image_id, ...) with the file_name of their image, for documents that join on the image's id."""
    return annotations.drop("file_name").join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")


def _addressed(annotations: DataFrame, dataset: str, frame_offset: int) -> DataFrame:
    seq, frame = (F.regexp_extract("file_name", _FRAME, i) for i in (1, 2))
    name = F.concat(F.lit(f"{dataset}/"), seq) if dataset else seq
    out = annotations.filter(F.col("file_name").rlike(_FRAME)).withColumns({"source_id": name, "frame_index": frame.cast("int") + frame_offset})
    return out.filter("frame_index >= 0").withColumn("track_id", F.col("instance_id").cast("string"))


def box_labels(annotations: DataFrame, dataset: str = "", frame_offset: int = -1) -> DataFrame:
    """source_id, frame_index, track_id and box of every annotation with a box (x, y, width, height).

    file_name is sequence/frame.jpg, the sequence with or without .mp4; frames are moved by frame_offset.
    """
    b = F.col("bbox")
    box = F.struct(b[0].cast("double").alias("x1"), b[1].cast("double").alias("y1"), (b[0] + b[2]).cast("double").alias("x2"), (b[1] + b[3]).cast("double").alias("y2"))
    return _addressed(annotations, dataset, frame_offset).filter(F.size("bbox") == 4).select("source_id", "frame_index", "track_id", box.alias("box"))


def keypoint_labels(annotations: DataFrame, names: list[str], frame_offset: int = -1, dataset: str = "") -> DataFrame:
    """annotations (file_name, instance_id, keypoints flat triplets) as labelled points; flag 0 is no label, 2 is visible.

    Annotations whose list has another length than three times the names are left out.
    """
    n = len(names)
    k = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.slice("keypoints", i * 3 + 1, 3).alias("v"))))
    out = _addressed(annotations, dataset, frame_offset).filter(F.size("keypoints") == 3 * n).select("source_id", "frame_index", "instance_id", k.alias("k"))
    name = F.array(*[F.lit(x) for x in names])
    return out.select(
        "source_id", "frame_index", "instance_id", F.get(name, F.col("k.i")).alias("name"), F.col("k.v")[0].cast("double").alias("x"), F.col("k.v")[1].cast("double").alias("y"),
        (F.col("k.v")[2] == 2).alias("visible"), F.col("k.v")[2].alias("flag"),
    ).filter("flag != 0").drop("flag")


def for_sequences(labels: DataFrame, sequences: list[str]) -> DataFrame:
    """Labels whose source ends in one of the sequences."""
    return labels.filter(F.substring_index("source_id", "/", -1).isin(list(sequences)))


def boxes_by_frame(boxes: DataFrame) -> DataFrame:
    """Each frame's boxes as one list, in the order of their tracks."""
    return boxes.groupBy("source_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("track_id", "box"))).alias("boxes"))


def identity_by_track(boxes: DataFrame) -> DataFrame:
    """track_id and animal_id: in this kind of label a track is an animal's appearance in one sequence."""
    return boxes.filter("track_id != ''").select("track_id", F.col("track_id").alias("animal_id")).distinct()
