"""Power of a study that compares a model with raters: how many animals show non-inferiority."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the study's design.
HUMAN_KAPPA, PREVALENCE, SCORERS, MARGINS = 0.50, (0.10, 0.15, 0.20, 0.30), 3, (0.05, 0.10, 0.15)
POWER_TARGET, SIMULATIONS, BOOTSTRAPS, HERD_SIZES = 0.80, 120, 250, (40, 60, 80, 120, 160, 240, 320, 480)
SETTLED = 10


def statistics(observed: np.ndarray, a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """kappa or ac1 from agreement and shares; 0 where chance alone agrees always."""
    q = (a + b) / 2
    chance = a * b + (1 - a) * (1 - b) if name == "kappa" else 2 * q * (1 - q)
    safe = np.where(chance < 1, 1 - chance, 1.0)
    return np.where(chance < 1, (observed - chance) / safe, 0.0)


def matched(pattern: np.ndarray, counts: np.ndarray, name: str) -> np.ndarray:
    """The leave-one-out difference of each row of counts; pattern: scores of all raters, then the model's."""
    raters = pattern.shape[1] - 1
    human, model, judged = (np.zeros(len(counts)) for _ in range(3))
    for i in range(raters):
        others = np.delete(pattern[:, :raters], i, axis=1)
        settled = (others == others[:, :1]).all(axis=1)
        n = counts[:, settled].sum(axis=1)
        part, verdict = counts[:, settled] / np.maximum(n, 1)[:, None], others[settled, 0]
        value = [statistics(part @ (own == verdict), part @ own, part @ verdict, name) for own in (pattern[settled, i], pattern[settled, raters])]
        enough = n >= SETTLED
        human, model, judged = human + np.where(enough, value[0], 0), model + np.where(enough, value[1], 0), judged + enough
    return np.where(judged > 0, (model - human) / np.maximum(judged, 1), 0.0)


def differences(pattern: np.ndarray, counts: np.ndarray, replicates: int, rng: np.random.Generator, name: str) -> np.ndarray:
    """The difference on resamples of the items, drawn as counts of their patterns."""
    n = int(counts.sum())
    return matched(pattern, rng.multinomial(n, counts / n, replicates), name)


def calibrate_noise(prevalence: float, target: float = HUMAN_KAPPA, seed: int = 0, size: int = 60_000) -> float:
    """The noise at which two raters of one latent severity agree with kappa `target`, by bisection."""
    rng = np.random.default_rng(seed)
    edge = float(np.quantile(rng.standard_normal(200_000), 1 - prevalence))
    severity, one, two = (rng.standard_normal(size) for _ in range(3))
    low, high = 0.01, 6.0
    for _ in range(40):
        mid = (low + high) / 2
        a, b = (severity + mid * x > edge for x in (one, two))
        if statistics(np.mean(a == b), np.mean(a), np.mean(b), "kappa") > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def one_study(n: int, prevalence: float, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """Scores of all raters and of a model exactly as good as one, an animal a row."""
    edge = float(np.quantile(rng.standard_normal(20_000), 1 - prevalence))
    severity = rng.standard_normal(n)
    return np.column_stack([severity + sigma * rng.standard_normal(n) > edge for _ in range(SCORERS + 1)]).astype(int)


def lower_bound(n: int, prevalence: float, sigma: float, rng: np.random.Generator, name: str, bootstraps: int = BOOTSTRAPS) -> float:
    pattern, counts = np.unique(one_study(n, prevalence, sigma, rng), axis=0, return_counts=True)
    return float(np.quantile(differences(pattern, counts, bootstraps, rng, name), 0.05))


def power_study(
    spark: SparkSession, prevalences=PREVALENCE, sizes=HERD_SIZES, simulations: int = SIMULATIONS, bootstraps: int = BOOTSTRAPS, seed: int = 20260907, names=("kappa", "ac1")
) -> DataFrame:
    """statistic, prevalence, animals and, per margin, the share of simulated studies that show non-inferiority.

    Simulations are independent and each draws from its own seed, so they run as rows in any order.
    """
    noise = {p: calibrate_noise(p, seed=seed) for p in prevalences}
    grid = [(s, p, noise[p], n) for s in names for p in prevalences for n in sizes]
    cells = spark.createDataFrame(grid, "statistic string, prevalence double, sigma double, animals int")
    runs = cells.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).repartition(spark.sparkContext.defaultParallelism, "animals", "prevalence", "sim")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            bounds = [lower_bound(r["animals"], r["prevalence"], r["sigma"], np.random.default_rng([seed, r["animals"], int(r["prevalence"] * 1000), r["sim"]]), r["statistic"], bootstraps) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bounds)], names=[*b.schema.names, "bound"])

    got = runs.mapInArrow(run, "statistic string, prevalence double, sigma double, animals int, sim int, bound double")
    return got.groupBy("statistic", "prevalence", "animals").agg(*[F.avg(F.when(F.col("bound") > -m, 1.0).otherwise(0.0)).alias(f"power_{int(m * 100):02d}") for m in MARGINS])


def animals_needed(study: DataFrame, margin: float, target: float = POWER_TARGET) -> DataFrame:
    """Per statistic and prevalence the least herd size that reaches the target, null if none does."""
    return study.groupBy("statistic", "prevalence").agg(F.min(F.when(F.col(f"power_{int(margin * 100):02d}") >= target, F.col("animals"))).alias("animals"))
