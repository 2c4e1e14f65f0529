"""Column helpers: medians of arrays, box geometry, vectors."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826
DAY_US = 86_400_000_000


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def middle(s: Column) -> Column:
    """Median of a sorted array; null when empty."""
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def array_median(a: Column) -> Column:
    return let(F.array_sort(a), middle)


def robust_stats(a: Column) -> Column:
    """Struct of centre, spread, kind and count of an array, each step computed once.

    The spread is MAD * 1.4826, or the population standard deviation where that is 0; 0 below two values.
    """

    def with_centre(s: Column, c: Column) -> Column:
        def with_mad(m: Column) -> Column:
            n = F.size(s)
            spread = F.when(n < 2, F.lit(0.0)).when(m > 0, m * MAD_SCALE).otherwise(array_stddev_pop(s))
            kind = F.when(n < 2, "undefined").when(m > 0, "mad").otherwise("stdev")
            return F.struct(c.alias("centre"), spread.alias("spread"), kind.alias("kind"), n.cast("long").alias("count"))

        return let(array_median(F.transform(s, lambda v: F.abs(v - c))), with_mad)

    return let(F.array_sort(a), lambda s: let(middle(s), lambda c: with_centre(s, c)))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def array_stddev_pop(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, let(array_sum(a) / n, lambda m: F.sqrt(array_sum(F.transform(a, lambda x: (x - m) * (x - m))) / n)))


def box_area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where they have no area."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def touches_border(b: Column, width: Column, height: Column, margin: float = 4.0) -> Column:
    return (b["x1"] <= margin) | (b["y1"] <= margin) | (b["x2"] >= width - margin) | (b["y2"] >= height - margin)


def box_centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def lane_position(b: Column, axis: str, extent: Column) -> Column:
    """Box centre as a share of the frame along an axis; a frame of extent 0 counts as 1."""
    return box_centre(b)[0 if axis == "x" else 1] / F.coalesce(F.nullif(extent.cast("double"), F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine similarity mapped to [0, 1]; 0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, (dot(a, b) / n + 1) / 2).otherwise(0.0)


def iso_utc(ts: Column) -> Column:
    """ISO form with microseconds only where there are any, and a UTC offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def iso_text(us: int) -> str:
    """iso_utc of microseconds since 1970, on the driver."""
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)).isoformat()


def event_key(*parts: Column) -> Column:
    """Idempotency key: the first 32 hex digits of the SHA-256 of the parts joined by pipes."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
