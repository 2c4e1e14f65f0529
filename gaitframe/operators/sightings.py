"""What the anchors say of every tracklet, without a row for every pair: numpy sweeps over a site's stretches of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY_US
from .identity import LEVELS, REGION_RATIO, WIDTH, _owned

GROUP = ("site_key", "_level", "_bin")
#: Pairs looked at together.
BLOCK = 1 << 20


def sweep(a: np.ndarray, b: np.ndarray, f: np.ndarray, u: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of closed intervals [a, b] and [f, u] that overlap, by i; all of an i come in one block.

    Intervals [f, u] are searched by lengths that differ by 4 at most, so a long one widens no search but its own.
    """
    if not len(f):
        return
    kind, found = np.frexp((u - f).astype(np.float64))[1] // 2, []
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(f[at], kind="stable")]
        low = np.searchsorted(f[at], a - (u[at] - f[at]).max(), "left")
        found.append((at, low, np.searchsorted(f[at], b, "right") - low))
    total, start = np.cumsum(sum(n for *_, n in found)), 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, BLOCK + (total[start - 1] if start else 0), "right")))
        rows = []
        for at, low, n in found:
            n = n[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = at[np.arange(len(i)) + np.repeat(low[start:stop] - np.cumsum(n) + n, n)]
            met = u[j] >= a[i]
            rows.append((i[met], j[met]))
        i, j = (np.concatenate(x) for x in zip(*rows))
        if len(rows) > 1:
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
        yield i, j
        start = stop


def _dealt(tracklets: DataFrame, anchors: DataFrame, bin_us: int, left: dict[str, Column], right: dict[str, Column]) -> tuple[DataFrame, bool]:
    """Both sides as rows of one table sorted by GROUP, with left (of tracklets) and right (of anchors); and if a tracklet may lie in two groups.

    A tracklet lies in the bin of its start, an anchor in all bins where a tracklet that it meets may start. They
    meet at the coarser of their two levels, as in identity.overlaps; the levels in use are looked up.
    """
    camera = F.when(F.col("camera_id") != "", F.col("camera_id").cast("string"))
    t = _owned(tracklets.filter("site_key IS NOT NULL").withColumns({"_from": F.col("start_us"), "_to": F.col("end_us")}), "_from", "_to", bin_us)
    n = _owned(anchors.filter("site_key IS NOT NULL").withColumns({"_from": F.col("from_us"), "_to": F.col("to_us")}), "_from", "_to", bin_us)
    sides = [x.select("_own", F.lit(k).alias("_left"), (F.col("_to") - F.col("_from")).alias("_n")) for k, x in ((True, t), (False, n))]
    held: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for own, side, longest in sides[0].unionByName(sides[1]).groupBy("_own", "_left").agg(F.max("_n")).collect():
        held[side][own] = longest
    reach = F.array(*[F.lit(max([0, *[v for k, v in held[True].items() if k <= at]])).cast("long") for at in range(LEVELS)])

    def at(other: dict[int, int], lowest: int) -> Column:
        """Levels of a row: its own, if the other side has a row of that or (lowest) a finer level, and the other side's coarser ones."""
        return F.filter(F.array(*[F.lit(k) for k in range(LEVELS)]), lambda k: ((k == F.col("_own")) & (k >= lowest)) | ((k > F.col("_own")) & k.isin(*other, -1)))

    size = F.lit(float(bin_us)) * F.pow(F.lit(float(WIDTH)), F.col("_level"))
    bin_ = lambda us: F.floor(us / size)
    t = t.withColumn("_level", F.explode(at(held[False], min(held[False], default=LEVELS)))).withColumn("_bin", bin_(F.col("_from")))
    n = n.withColumn("_level", F.explode(at(held[True], min(held[True], default=LEVELS)))).withColumn("_bin", F.explode(F.sequence(bin_(F.col("_from") - reach[F.col("_level")]), bin_(F.col("_to")))))
    same = [*GROUP, "_own", "_from", "_to", camera.alias("_camera")]
    t = t.select(F.lit(True).alias("_left"), *same, *[c.alias(k) for k, c in left.items()])
    n = n.select(F.lit(False).alias("_left"), *same, *[c.alias(k) for k, c in right.items()])
    rows = t.unionByName(n, allowMissingColumns=True)
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP), any(k > min(held[True], default=LEVELS) for k in held[False])


def _in_groups(each):
    """Kernel: each(tracklets, anchors, i, j) on the blocks of every group's pairs; cameras are equal where both are set."""

    def met(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        side = t.column("_left").to_numpy()
        if side.all() or not side.any():
            return
        camera = t.column("_camera").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        level, own, start, end = (t.column(c).to_numpy() for c in ("_level", "_own", "_from", "_to"))
        # those whose level this is meet all anchors, others meet only anchors whose level it is
        for x, y in ((side & (own == level), ~side), (side & (own < level), ~side & (own == level))):
            x, y = np.flatnonzero(x), np.flatnonzero(y)
            if not len(x) or not len(y):
                continue
            one, two = t.take(pa.array(x)), t.take(pa.array(y))
            for i, j in sweep(start[x], end[x], start[y], end[y]):
                p, q = camera[x][i], camera[y][j]
                fits = (p < 0) | (q < 0) | (p == q)
                if fits.any():
                    yield each(one, two, i[fits], j[fits])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in GROUP]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                key = tuple(b.column(c)[start].as_py() for c in GROUP)
                if waiting and key != last:
                    yield from met(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(b.slice(start, stop - start))
                last = key
        if waiting:
            yield from met(pa.Table.from_batches(waiting))

    return run


def _first(i: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of i begin."""
    return np.flatnonzero(np.append(True, i[1:] != i[:-1]))


def _seen(names: bool):
    def each(t: pa.Table, n: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        animal = n.column("animal_id").combine_chunks().dictionary_encode()
        order = pc.sort_indices(animal.dictionary).to_numpy()
        place = np.full(len(order) + 1, -1)
        place[order] = np.arange(len(order))
        code = place[animal.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]  # by name; -1: without
        animals, many = animal.dictionary.take(pa.array(order)), len(order) + 1
        starts = _first(i)
        rows = i[starts]
        # of the earliest anchors the one of least confidence, so that a tie has one answer
        early = pc.sort_indices(n, sort_keys=[("from_us", "ascending"), ("confidence", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(early), dtype=np.int64)
        rank[early] = np.arange(len(early))
        earliest = pa.array(early[np.minimum.reduceat(rank[j], starts)])
        known = code[j] >= 0
        pairs = i[known] * many + code[j[known]]
        pairs.sort()
        pairs = pairs[_first(pairs)] if len(pairs) else pairs
        of, which = pairs // many, pairs % many
        begin, end = np.searchsorted(of, rows, "left"), np.searchsorted(of, rows, "right")
        none, which = begin == end, np.append(which, 0)
        name = lambda at: animals.take(pa.array(which[at], mask=none))
        cols = {"tracklet_id": t.column("tracklet_id").combine_chunks().take(pa.array(rows)), "_low": name(np.minimum(begin, len(pairs))), "_high": name(np.maximum(end - 1, 0))}
        cols |= {"_from": n.column("from_us").combine_chunks().take(earliest), "_conf": n.column("confidence").combine_chunks().take(earliest)}
        if names:
            cols["_anchored"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(pairs)), pa.int32()), animals.take(pa.array(which[:-1])))
        return pa.RecordBatch.from_pydict(cols)

    return each


def seen(tracklets: DataFrame, anchors: DataFrame, names: bool = True, bin_us: int = DAY_US) -> DataFrame:
    """The animals of the anchors that interval_join pairs with each tracklet: tracklet_id, _low and _high, the first and the last of them by name,
    _conf, the confidence of the earliest anchor, and, if names, _anchored, all of them. Tracklets without an anchor have no row.
    """
    kind = tracklets.schema["tracklet_id"].dataType.simpleString()
    right = {"animal_id": F.col("animal_id").cast("string"), "from_us": F.col("from_us").cast("long"), "confidence": F.col("confidence").cast("double")}
    rows, _ = _dealt(tracklets, anchors, bin_us, {"tracklet_id": F.col("tracklet_id")}, right)
    shape = f"tracklet_id {kind}, _low string, _high string, _from long, _conf double"
    got = rows.mapInArrow(_in_groups(_seen(names)), shape + (", _anchored array<string>" if names else ""))
    lists = F.collect_list("_anchored")  # a tracklet beside long anchors has one from each level
    merged = [F.when(F.size(lists) == 1, lists[0]).otherwise(F.sort_array(F.array_distinct(F.flatten(lists)))).alias("_anchored")] if names else []
    return got.groupBy("tracklet_id").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min_by("_conf", F.struct("_from", "_conf")).alias("_conf"), *merged)


SIDES = ("x1", "y1", "x2", "y2")


def _iou(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """functions.box_iou, a missing side as NaN."""
    w, h = (np.fmax(np.fmin(a[k + 2], b[k + 2]) - np.fmax(a[k], b[k]), 0.0) for k in (0, 1))
    area = lambda x: np.fmax(x[2] - x[0], 0.0) * np.fmax(x[3] - x[1], 0.0)
    union = area(a) + area(b) - w * h
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union > 0, w * h / union, 0.0)


def _located(ratio: float, kept: list[str]):
    def each(t: pa.Table, n: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        sides = lambda x, at: [x.column(f"_{s}").to_numpy()[at] for s in SIDES]
        has = lambda x: x.column("_located").fill_null(False).to_numpy()
        iou = np.where(has(t)[i] & has(n)[j], _iou(sides(t, i), sides(n, j)), np.nan)
        starts = _first(i)
        best = np.repeat(np.fmax.reduceat(iou, starts), np.diff(np.append(starts, len(i))))
        stays = np.isnan(best) | (best <= 0) | np.isnan(iou) | (iou >= ratio * best)
        i, j = pa.array(i[stays]), pa.array(j[stays])
        cols = {"tracklet_id": t.column("tracklet_id").combine_chunks().take(i), "animal_id": n.column("animal_id").combine_chunks().take(j), "from_us": n.column("from_us").combine_chunks().take(j)}
        if "_iou" in kept:
            cols["_iou"] = pa.array(iou[stays], pa.float64(), from_pandas=True)
        return pa.RecordBatch.from_pydict(cols)

    return each


def in_region(tracklets: DataFrame, anchors: DataFrame, ratio: float = REGION_RATIO, bin_us: int = DAY_US) -> DataFrame:
    """tracklet_id, animal_id and from_us of the pairs of interval_join that refine_by_region leaves.

    tracklets have a footprint, anchors a region (structs of x1, y1, x2, y2, numbers). A tracklet's pairs meet in one
    group, where its best overlap is known; only beside anchors longer than its level's bins they meet in several,
    and what these leave is compared once more.
    """
    box = lambda c: {"_located": F.col(c).isNotNull()} | {f"_{s}": F.col(c)[s].cast("double") for s in SIDES}
    right = {"animal_id": F.col("animal_id"), "from_us": F.col("from_us")} | box("region")
    rows, several = _dealt(tracklets, anchors, bin_us, {"tracklet_id": F.col("tracklet_id")} | box("footprint"), right)
    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    shape = [kind(tracklets, "tracklet_id"), kind(anchors, "animal_id"), kind(anchors, "from_us"), *(["_iou double"] if several else [])]
    out = rows.mapInArrow(_in_groups(_located(ratio, [x.split()[0] for x in shape])), ", ".join(shape))
    if not several:
        return out
    out = out.withColumn("_best", F.max("_iou").over(Window.partitionBy("tracklet_id")))
    return out.filter(F.col("_best").isNull() | (F.col("_best") <= 0) | F.col("_iou").isNull() | (F.col("_iou") >= ratio * F.col("_best"))).drop("_iou", "_best")
