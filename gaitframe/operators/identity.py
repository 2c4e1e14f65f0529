"""Which animal a tracklet shows: anchor intervals, regions, nearest neighbours, conflicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box_iou

CONFIDENCE_FLOOR, SIMILARITY_FLOOR, MARGIN_FLOOR, REGION_RATIO = 0.60, 0.55, 0.0, 0.90
HOUR_US = 3_600_000_000
#: An interval lies in at most WIDTH + 1 bins of its level; bins grow by WIDTH from level to level.
WIDTH, LEVELS = 16, 8


def _owned(rows: DataFrame, start: str, end: str, bin_us: int) -> DataFrame:
    """rows that are intervals, with _own, the level whose bins fit their length."""
    length = F.col(end) - F.col(start)
    own = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        own = F.when(length <= min(WIDTH * bin_us * WIDTH**k, 2**63 - 1), k).otherwise(own)
    return rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))).withColumn("_own", own)


def levels(rows: DataFrame, start: str, end: str, bin_us: int) -> list[int]:
    """The levels, LEVELS at most, that the intervals of rows own."""
    return sorted(r[0] for r in _owned(rows, start, end, bin_us).select("_own").distinct().collect())


def _binned(rows: DataFrame, start: str, end: str, bin_us: int, at: Column) -> DataFrame:
    """rows in every bin of the levels in the array at: _level, _size, _bin."""
    size = F.lit(float(bin_us)) * F.pow(F.lit(float(WIDTH)), F.col("_level"))
    rows = rows.withColumn("_level", F.explode(at)).withColumn("_size", size)
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("_size")), F.floor(F.col(end) / F.col("_size")))))


def overlaps(
    left: DataFrame, right: DataFrame, keys: list[str], lspan: tuple[str, str], rspan: tuple[str, str], bin_us: int = HOUR_US, held: tuple[list[int], list[int]] | None = None
) -> DataFrame:
    """Pairs of left and right rows with equal keys whose closed intervals overlap; column names must differ beyond keys.

    Intervals are dealt into time bins of a size that fits their length, so the join has equality keys, a hot
    key is spread over its bins, and an interval makes a bounded number of rows however long it is. A pair is
    met at the coarser of its two levels, in the first bin both lie in: rows of a level meet the other side's
    copies of that level only, and copies are made only for levels that the other side owns (held: the levels
    of left and right, or more; else they are looked up). Rows without an end never match.
    """
    held = held or (levels(left, *lspan, bin_us), levels(right, *rspan, bin_us))
    a, b = _owned(left, *lspan, bin_us), _owned(right, *rspan, bin_us)
    on = (F.col("_level") == F.col("_rlevel")) & (F.col("_bin") == F.col("_rbin"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    on = on & (F.col(rspan[0]) <= F.col(lspan[1])) & (F.col(lspan[0]) <= F.col(rspan[1]))
    on = on & (F.col("_bin") == F.floor(F.greatest(F.col(lspan[0]), F.col(rspan[0])) / F.col("_size")))
    own, copies = F.array("_own"), lambda ks, least: F.filter(F.array(*map(F.lit, ks)).cast("array<int>"), least)

    def met(at_left: Column, at_right: Column) -> DataFrame:
        x = _binned(a, *lspan, bin_us, at_left).drop("_own")
        y = _binned(b, *rspan, bin_us, at_right).drop("_own", "_size").withColumnsRenamed({k: f"_{k}" for k in keys} | {"_level": "_rlevel", "_bin": "_rbin"})
        return x.join(y, on).drop("_level", "_bin", "_size", "_rlevel", "_rbin", *[f"_{k}" for k in keys])

    out = met(own, copies(held[0], lambda k: k >= F.col("_own")))
    if held[0] and held[1] and min(held[0]) < max(held[1]):
        out = out.unionByName(met(copies(held[1], lambda k: k > F.col("_own")), own))
    return out


def interval_join(tracklets: DataFrame, anchors: DataFrame, bin_us: int = HOUR_US, tolerance_us: int = 0) -> DataFrame:
    """Pairs of one site whose closed intervals overlap, cameras equal where both are set.

    tracklets: tracklet_id, site_key, camera_id, start_us, end_us; anchors: animal_id, site_key, camera_id,
    from_us, to_us, ... A tracklet without reliable times (null) has no anchor.
    """
    a = anchors.withColumnsRenamed({"camera_id": "_camera"}).withColumns({"_from": F.col("from_us") - tolerance_us, "_to": F.col("to_us") + tolerance_us})
    out = overlaps(tracklets, a, ["site_key"], ("start_us", "end_us"), ("_from", "_to"), bin_us)
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return out.filter(~set_("camera_id") | ~set_("_camera") | (F.col("camera_id") == F.col("_camera"))).drop("_camera", "_from", "_to")


def footprint(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """tracklet_id and footprint: the extent of a tracklet's boxes as shares of the frame."""
    side = lambda f, c, n: (f(c) / F.lit(float(n))).alias(c)
    extent = F.struct(side(F.min, "x1", width), side(F.min, "y1", height), side(F.max, "x2", width), side(F.max, "y2", height))
    return boxes.groupBy("tracklet_id").agg(extent.alias("footprint"))


def refine_by_region(pairs: DataFrame, ratio: float = REGION_RATIO) -> DataFrame:
    """pairs (footprint, region structs) without located rows below ratio of the tracklet's best overlap."""
    iou = F.when(F.col("region").isNotNull() & F.col("footprint").isNotNull(), box_iou(F.col("footprint"), F.col("region")))
    w = Window.partitionBy("tracklet_id")
    out = pairs.withColumn("_iou", iou).withColumn("_best", F.max("_iou").over(w))
    return out.filter(F.col("_best").isNull() | (F.col("_best") <= 0) | F.col("_iou").isNull() | (F.col("_iou") >= ratio * F.col("_best"))).drop("_iou", "_best")


def resolve(
    tracklets: DataFrame, pairs: DataFrame, visual: DataFrame | None = None, floor: float = CONFIDENCE_FLOOR, similarity_floor: float = SIMILARITY_FLOOR, margin_floor: float = MARGIN_FLOOR
) -> DataFrame:
    """method, animal_id, confidence, reason and candidates per tracklet: one anchored animal, else the visual match, else unresolved.

    An anchor counts whatever its confidence. Several anchored animals are ambiguous and do not fall through to
    the visual match (tracklet_id, animal_id, similarity, margin), which must reach both floors and the margin.
    pairs may be what sightings.seen makes of tracklets and anchors; without its names there are no candidates.
    """
    if "_low" not in pairs.columns:
        first = F.min_by("confidence", F.struct("from_us")) if "from_us" in pairs.columns else F.max("confidence")
        animal = F.col("animal_id").cast("string")
        pairs = pairs.groupBy("tracklet_id").agg(F.min(animal).alias("_low"), F.max(animal).alias("_high"), first.alias("_conf"), F.array_sort(F.collect_set(animal)).alias("_anchored"))
    out = tracklets.select("tracklet_id").join(pairs, "tracklet_id", "left")
    if visual is not None:
        out = out.join(visual.select("tracklet_id", F.col("animal_id").cast("string").alias("_visual"), "similarity", "margin"), "tracklet_id", "left")
    else:
        out = out.withColumns({"_visual": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "margin": F.lit(None).cast("double")})
    n = F.when(F.col("_low").isNull(), 0).when(F.col("_low") == F.col("_high"), 1).otherwise(2)
    anchored, shown = n == 1, (n == 0) & F.col("_visual").isNotNull()
    looks = shown & (F.col("similarity") >= max(floor, similarity_floor)) & (F.col("margin") >= margin_floor)
    method = F.when(anchored, "external_anchor").when(looks, "visual_fallback").otherwise("unresolved")
    reason = F.when(anchored | looks, F.lit(None)).when(n > 1, "ambiguous_anchor").when(shown, "below_confidence_floor").otherwise("no_candidate")
    none = F.array().cast("array<string>")
    candidates = [F.when(n > 1, F.col("_anchored")).when(shown & ~looks, F.array("_visual")).otherwise(none).alias("candidate_animal_ids")] if "_anchored" in pairs.columns else []
    return out.select(
        "tracklet_id", method.alias("method"), F.when(anchored, F.col("_low")).when(looks, F.col("_visual")).alias("animal_id"),
        F.when(anchored, F.col("_conf")).when(shown, F.col("similarity")).otherwise(0.0).alias("confidence"), reason.alias("unresolved_reason"), *candidates,
    )


#: References and queries multiplied at once.
GALLERY_BLOCK, QUERY_BLOCK = 32_768, 4_096


def nearest(queries: DataFrame, gallery: DataFrame, top: int = 2) -> DataFrame:
    """Best animals of each query by their most similar reference, and the margin to the next animal.

    queries: query_id, embedding; gallery: animal_id, embedding, any number of references an animal. Similarity
    is the cosine mapped to [0, 1], 0 where a vector has no length. Both sides are dealt into blocks and each
    pair of blocks is one matrix product, of which only the best animals of each query leave; so there is no
    table of pairs. Ties go to the smaller id; a single candidate has margin 0.
    """
    n_q, n_g = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (gallery, GALLERY_BLOCK)))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("_q"), all_(n_g).alias("_g"))
    g = gallery.select("animal_id", "embedding", F.pmod(F.xxhash64("animal_id", "embedding"), F.lit(n_g)).cast("int").alias("_g"), all_(n_q).alias("_q"))
    kinds = [queries.schema["query_id"].dataType.simpleString(), gallery.schema["animal_id"].dataType.simpleString()]

    keep, top = top, top + 1  # the margin needs the next animal

    def unit(table: pa.Table) -> np.ndarray:
        v = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
        size = np.sqrt((v**2).sum(axis=1, keepdims=True))
        return np.where(size > 0, v / np.where(size > 0, size, 1), np.nan)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([("query_id", left.schema.field("query_id").type), ("animal_id", right.schema.field("animal_id").type), ("similarity", pa.float64())])
        if not len(left) or not len(right):
            return names.empty_table()
        right = right.sort_by("animal_id")
        animals, first = np.unique(right.column("animal_id").to_numpy(zero_copy_only=False), return_index=True)
        sim = np.nan_to_num((unit(left) @ unit(right).T + 1) / 2, nan=0.0)
        sim = np.maximum.reduceat(sim, first, axis=1)
        order = np.lexsort((np.broadcast_to(np.arange(len(animals)), sim.shape), -sim), axis=1)[:, :top]
        row = np.repeat(np.arange(len(sim)), order.shape[1])
        cols = [left.column("query_id").take(pa.array(row)), pa.array(animals[order.ravel()], names.field(1).type), pa.array(sim[row, order.ravel()])]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in cols], schema=names)

    got = q.groupBy("_q", "_g").cogroup(g.groupBy("_q", "_g")).applyInArrow(best, f"query_id {kinds[0]}, animal_id {kinds[1]}, similarity double")
    got = got.groupBy("query_id", "animal_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "animal_id")
    ranked = got.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead("similarity").over(w))
    out = ranked.withColumn("margin", F.coalesce(F.col("similarity") - F.col("_next"), F.lit(0.0))).drop("_next")
    return out.filter(F.col("rank") <= keep)


def conflicts(assigned: DataFrame, bin_us: int = 1 << 10, spans: DataFrame | None = None) -> DataFrame:
    """Pairs of tracklets of one animal and source whose closed frame ranges overlap: one animal at two places.

    spans (first_frame, last_frame): the ranges of assigned, or more, where those are cheaper to read.
    """
    a = assigned.filter("animal_id IS NOT NULL").select("animal_id", "source_id", "tracklet_id", "first_frame", "last_frame")
    b = a.withColumnsRenamed({"tracklet_id": "other_id", "first_frame": "o_first", "last_frame": "o_last"})
    own = levels(a if spans is None else spans, "first_frame", "last_frame", bin_us)
    pairs = overlaps(a, b, ["animal_id", "source_id"], ("first_frame", "last_frame"), ("o_first", "o_last"), bin_us, (own, own))
    return pairs.filter("tracklet_id < other_id").select("animal_id", "source_id", "tracklet_id", "other_id")


def withhold(assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """assigned with both sides of every conflict unresolved; the claimed animal stays as a candidate.

    A tracklet without an animal is in no conflict, so its row, which may hold many candidates, is not moved.
    assigned is read twice.
    """
    hit = pairs.select("tracklet_id").union(pairs.select("other_id")).distinct().withColumnRenamed("tracklet_id", "_hit")
    out = assigned.filter("animal_id IS NOT NULL").join(hit, F.col("tracklet_id") == F.col("_hit"), "left")
    gone = F.col("_hit").isNotNull()

    def changed(name: str, value: Column) -> dict[str, Column]:
        return {name: F.when(gone, value).otherwise(F.col(name))} if name in assigned.columns else {}

    candidates = changed("candidate_animal_ids", F.array(F.col("animal_id").cast("string")))
    out = out.withColumns(candidates | changed("method", F.lit("unresolved")) | changed("unresolved_reason", F.lit("identity_conflict")))
    out = out.withColumn("animal_id", F.when(~gone, F.col("animal_id"))).drop("_hit")
    return out.unionByName(assigned.filter("animal_id IS NULL"))


def colour_histogram(boxes: DataFrame, colours: int = 8) -> DataFrame:
    """boxes (id, width, height, pixels: interleaved 8-bit BGR) with embedding: the colour histogram, adding up to 1.

    A picture without pixels has the zero vector. Pixels are counted in numpy, a batch at a time.
    """

    def run(batches):
        for b in batches:
            out = []
            for x in b.column("pixels").to_pylist():
                p = np.frombuffer(x or b"", dtype=np.uint8).reshape(-1, 3).astype(np.int64) * colours // 256
                h = np.bincount((p[:, 0] * colours + p[:, 1]) * colours + p[:, 2], minlength=colours**3)
                out.append((h / max(1, h.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    from pyspark.sql import types as T

    return boxes.mapInArrow(run, T.StructType([*boxes.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
