"""Append-only series of observations, partitioned by area, site and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

KEYS = ["animal_id", "pass_id", "tracklet_id", "observed_at", "valid", "injected"]


def area() -> Column:
    """Where a record belongs: invalid ones to audit, those without animal or time to unattributed."""
    return F.when(~F.col("valid"), "audit").when(F.col("animal_id").isNull() | (F.col("animal_id") == "") | F.col("observed_at").isNull(), "unattributed").otherwise("observations")


def measurements() -> Column:
    """The features that may be used: none of an invalid record, else those of usable quality."""
    good = F.filter("features", lambda f: ~f["quality"].isin("unusable", "unavailable"))
    return F.when(F.col("valid"), good).otherwise(F.slice("features", 1, 0))


def wide(records: DataFrame, names: list[str]) -> DataFrame:
    """One f_ and one q_ column per declared feature."""
    m = records.withColumn("_m", F.map_from_entries(F.transform(measurements(), lambda f: F.struct(f["name"], f))))
    cols = [c for n in names for c in (F.try_element_at("_m", F.lit(n))["value"].alias(f"f_{n}"), F.try_element_at("_m", F.lit(n))["quality"].alias(f"q_{n}"))]
    part = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)
    return m.select(area().alias("area"), part("site_key"), part("day_key"), *KEYS, *cols)


def routing(records: DataFrame) -> DataFrame:
    reason = F.when(~F.col("valid"), "invalid").when(F.col("animal_id").isNull() | (F.col("animal_id") == ""), "no_animal").when(F.col("observed_at").isNull(), "no_timestamp").otherwise("")
    return records.groupBy(area().alias("area"), reason.alias("reason")).count()


class Series:
    """A root folder with one sub-folder per area, site and day."""

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self.spark, self.root, self.names = spark, root, names

    @property
    def schema(self) -> T.StructType:
        s = T.StructType([T.StructField(c, T.StringType()) for c in ("animal_id", "pass_id", "tracklet_id")])
        s = s.add("observed_at", T.TimestampNTZType()).add("valid", "boolean").add("injected", "boolean")
        for n in self.names:
            s = s.add(f"f_{n}", "double").add(f"q_{n}", "string")
        return s.add("area", "string").add("site_key", "string").add("day_key", "string")

    def append(self, records: DataFrame) -> None:
        """Add records to the area each belongs to; `routing` counts them."""
        wide(records, self.names).repartition("area", "site_key", "day_key").write.partitionBy("area", "site_key", "day_key").mode("append").parquet(self.root)

    def clear(self) -> None:
        files.delete(self.spark, self.root)

    def scan(
        self, area: str = "observations", animal_ids: list[str] | None = None, site_key: str | None = None, start=None, end=None, exclude_pass_ids: list[str] | None = None
    ) -> DataFrame:
        """Filtered observations; an empty list of animals gives no rows, a missing folder neither.

        Area and site choose folders; times (from start, before end; a missing time is in no range) reach the
        Parquet scan. Day keys are free text, so they bound nothing.
        """
        if not files.exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).parquet(self.root).filter(F.col("area") == area)
        if animal_ids is not None:
            df = df.filter(F.col("animal_id").isin(list(animal_ids)) if animal_ids else F.lit(False))
        if site_key is not None:
            df = df.filter(F.col("site_key") == site_key)
        if start is not None:
            df = df.filter(F.col("observed_at") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            df = df.filter(F.col("observed_at") < F.lit(end).cast("timestamp_ntz"))
        if exclude_pass_ids:
            df = df.filter(~F.col("pass_id").isin(list(exclude_pass_ids)))
        return df

    def read(self, **filters) -> DataFrame:
        """scan by (observed_at, pass_id)."""
        return self.scan(**filters).orderBy(F.asc_nulls_last("observed_at"), "pass_id")

    def observations(self, **filters) -> DataFrame:
        """read with the features as one map of those that have a value; injected and tracklet_id are never null."""
        df = self.read(**filters)
        entries = F.map_from_arrays(F.array(*[F.lit(n) for n in self.names]), F.array(*[F.col(f"f_{n}") for n in self.names]))
        kept = ["animal_id", "pass_id", "observed_at", "site_key", "day_key"]
        return df.select(
            *kept, F.coalesce("injected", F.lit(False)).alias("injected"), F.coalesce("tracklet_id", F.lit("")).alias("tracklet_id"),
            F.map_filter(entries, lambda k, v: v.isNotNull()).alias("features"),
        )

    def animals(self, site_key: str | None = None) -> DataFrame:
        return self.scan(site_key=site_key).select("animal_id").distinct().orderBy("animal_id")


def long_features(obs: DataFrame, names: list[str]) -> DataFrame:
    """Wide observations as rows (feature, value); null values are left out."""
    ids = [c for c in obs.columns if not c.startswith(("f_", "q_"))]
    out = obs.unpivot(ids, [f"f_{n}" for n in names], "feature", "value")
    return out.withColumn("feature", F.expr("substring(feature, 3)")).filter("value IS NOT NULL")
