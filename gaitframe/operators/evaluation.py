"""Phenotype repeatability, identity accuracy, rater agreement, leakage-checked splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LeakageError, MissingFieldError
from . import power


def repeatability(long: DataFrame) -> DataFrame:
    """Per feature: mean within-animal CV, between-animal spread of means, and their variance ratio (ICC).

    Only animals with two values of the feature count.
    """
    per = long.filter("value IS NOT NULL").groupBy("animal_id", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    per = per.filter("n >= 2")
    out = per.groupBy("feature").agg(
        F.count("*").alias("animals"),
        F.avg(F.when(F.col("m") != 0, F.col("s") / F.abs("m"))).alias("within_cv"),
        F.stddev_samp("m").alias("between_sd"),
        F.avg("s").alias("within_sd"),
    )
    b, w = F.col("between_sd") ** 2, F.col("within_sd") ** 2
    return out.withColumn("icc", F.try_divide(b, b + w))


def identity_accuracy(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """Per method: assignments, resolved share and share of resolved ones that name the true animal.

    A resolved tracklet whose truth is not known counts as wrong.
    """
    t = truth.select("tracklet_id", F.col("animal_id").alias("_true"))
    rows = assigned.join(t, "tracklet_id", "left")
    out = rows.groupBy("method").agg(F.count("*").alias("n"), F.count("animal_id").alias("resolved"), F.count_if(F.col("animal_id") == F.col("_true")).alias("correct"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct") * 1.0, F.col("resolved") * 1.0), F.lit(0.0))).withColumn("resolution_rate", F.col("resolved") / F.col("n"))


def chance_corrected(observed: Column, pa: Column, pb: Column) -> dict[str, Column]:
    """Cohen's kappa and Gwet's AC1 from the observed agreement and both raters' shares; 0 where chance alone agrees always."""
    q = (pa + pb) / 2
    one = lambda e: F.when(e < 1, (observed - e) / (1 - e)).otherwise(0.0)
    return {"kappa": one(pa * pb + (1 - pa) * (1 - pb)), "ac1": one(2 * q * (1 - q))}


def _shares(a: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.avg(F.when(a == b, 1.0).otherwise(0.0)), F.avg(a * 1.0), F.avg(b * 1.0)


def agreement(raters: DataFrame) -> DataFrame:
    """Cohen's kappa and Gwet's AC1 of two binary raters a and b, from three averages."""
    o, pa, pb = _shares(F.col("a"), F.col("b"))
    s = raters.agg(o.alias("observed"), pa.alias("pa"), pb.alias("pb"))
    return s.select("observed", *[c.alias(n) for n, c in chance_corrected(F.col("observed"), F.col("pa"), F.col("pb")).items()])


SETTLED = 10


def leave_one_out(scores: DataFrame, statistic: str = "kappa") -> DataFrame:
    """scores: item, rater, score (0/1), model (0/1). The model's mean agreement minus the raters'.

    Each rater is held out in turn; on the items where all others agree (at least 10), the rater and the
    model are compared with that verdict by the same statistic. One row; 0 without a rater to judge.
    """
    s = scores.groupBy("item", "model").agg(F.collect_list(F.struct("rater", "score")).alias("r"))
    out = s.withColumn("left", F.explode("r"))
    others = F.transform(F.filter("r", lambda x: x["rater"] != F.col("left")["rater"]), lambda x: x["score"])
    out = out.withColumn("verdict", F.when((F.size(others) > 0) & (F.array_min(others) == F.array_max(others)), F.array_min(others))).filter("verdict IS NOT NULL")
    cols = {}
    for name, c in (("human", F.col("left.score")), ("model", F.col("model"))):
        for part, value in zip(("o", "pa", "pb"), _shares(c, F.col("verdict"))):
            cols[f"{name}_{part}"] = value
    per = out.groupBy(F.col("left.rater").alias("rater")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in cols.items()]).filter(F.col("n") >= SETTLED)
    each = {n: chance_corrected(*(F.col(f"{n}_{p}") for p in ("o", "pa", "pb")))[statistic] for n in ("human", "model")}
    mean = lambda n: F.coalesce(F.avg(each[n]), F.lit(0.0))
    return per.agg(F.count("*").alias("raters"), mean("model").alias("model_agreement"), mean("human").alias("rater_agreement"), (mean("model") - mean("human")).alias("difference"))


def bootstrap_bound(scores: DataFrame, statistic: str = "kappa", replicates: int = 250, share: float = 0.05, seed: int = 7) -> DataFrame:
    """One row: the lower quantile of leave_one_out's difference over resamples of the items, and their number.

    The statistic depends only on how often each pattern of scores occurs, so the items are counted by pattern
    (2 ^ (raters + 1) at most) and the counts are resampled, which is the same as drawing items with replacement.
    """
    spark = scores.sparkSession
    rows = scores.groupBy("item", "model").agg(F.array_sort(F.collect_list(F.struct("rater", "score"))).alias("r"))
    got = rows.groupBy(F.transform("r", lambda x: x["score"]).alias("s"), "model").count().collect()  # a row a pattern
    bound = None
    if got:
        pattern = np.array([[*r["s"], r["model"]] for r in got])
        order = np.lexsort(pattern.T[::-1])
        bound = float(np.quantile(power.differences(pattern[order], np.array([r["count"] for r in got])[order], replicates, np.random.default_rng(seed), statistic), share))
    return spark.createDataFrame([(bound, replicates)], "lower_bound double, replicates long")


KINDS = {"frame": "item_id", "animal": "animal_key", "day": "day_key", "site": "site_key"}


def split(items: DataFrame, key: str, test_fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """items with part, train or test: whole keys go to one side, in the order of a seeded hash.

    max(1, round half even of n * fraction) keys are test keys, at most n - 1; a single key is a test key. The
    hash of the last test key is found by counting keys in ranges of their hash, narrower from round to round,
    so the keys are never put in order in one place.
    """
    bad = items.filter(F.col(key).isNull() | (F.col(key).cast("string") == "")).select(items.columns[0]).limit(5).collect()
    if bad:
        raise MissingFieldError("split", key, sorted(str(r[0]) for r in bad))
    place = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    keys = items.select(F.col(key).alias("_k"), place.alias("_o")).distinct()
    n = keys.count()
    target = max(1, round(n * test_fraction))
    target = min(target, n - 1) if n > 1 else target
    prefix, left = "", target
    while n:  # the target-th hash begins with prefix; each round adds three hex digits
        size = len(prefix) + 3
        counts = keys.filter(F.col("_o").startswith(prefix)).groupBy(F.substring("_o", 1, size).alias("p")).count().orderBy("p").collect()  # 4096 rows
        for r in counts:
            if left <= r["count"]:
                prefix, here = r["p"], r["count"]
                break
            left -= r["count"]
        if here == left or size >= 63:
            break
    last = F.substring("_o", 1, max(1, len(prefix)))
    out = items.withColumn("_o", place)
    return out.withColumn("part", F.when(last <= prefix, "test").otherwise("train")).drop("_o")


def overlapping_keys(parts: DataFrame, key: str) -> DataFrame:
    side = lambda p: parts.filter(F.col("part") == p).select(key)
    return side("train").intersect(side("test"))


def assert_no_leakage(parts: DataFrame, key: str) -> None:
    hit = overlapping_keys(parts, key).limit(5).collect()
    if hit:
        raise LeakageError(key, sorted(str(r[0]) for r in hit))
