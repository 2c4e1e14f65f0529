"""Stage tables of one run: records partitioned by site and day, written as a whole and read with pruning."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MissingFieldError
from . import files

STAGES = ("detections", "tracklets", "poses", "identity_assignments", "passes", "features", "assessments", "events")
#: The columns that may name a record, the first that is set.
IDS = ("detection_id", "tracklet_id", "pose_id", "pass_id", "assessment_id", "event_id", "source_id")
KEYS = ("site_key", "day_key")


def record_id(df: DataFrame) -> Column:
    """The first id that is set, else a digest of the whole record, so that a second run gives the same."""
    ids = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in IDS if c in df.columns]
    return F.coalesce(*ids, F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 32))


def payload(df: DataFrame, name: str, version: str) -> DataFrame:
    """record_id and payload: each record as JSON with the name and version of its schema."""
    body = F.struct(F.lit(name).alias("schema_name"), F.lit(version).alias("schema_version"), *df.columns)
    return df.select(record_id(df).alias("record_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def from_payload(rows: DataFrame, schema: T.StructType, name: str = "record") -> DataFrame:
    """The records of payload; fields that are not in the schema are left out, a missing required one is refused by its name."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    out = rows.select(F.from_json("payload", loose).alias("r")).select("r.*")
    needed = [f.name for f in schema.fields if not f.nullable]
    if needed:
        lost = out.select(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])).alias("lost")).filter(F.size("lost") > 0).limit(1).collect()
        if lost:
            raise MissingFieldError(name, lost[0][0][0])
    return out


class StageStore:
    """root/stages/<stage>/site_key=/day_key=; the schema of each stage lies beside it, so partition keys stay strings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, stage: str) -> str:
        return f"{self.root}/stages/{stage}"

    def clear(self, stage: str) -> None:
        for path in (self.path(stage), f"{self.root}/schemas/{stage}"):
            files.delete(self.spark, path)

    def write(self, stage: str, records: DataFrame, sort: str | None = None, name: str = "", version: str = "1") -> bool:
        """Replace a stage; nothing is written, and False returned, if there are no records.

        Records without site or day go to `unknown`. sort names the column of sort_key (0 without one).
        """
        self.clear(stage)
        key = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) if c in records.columns else F.lit("unknown")
        out = records.withColumns(
            {
                "record_id": record_id(records), "schema_name": F.lit(name or stage), "schema_version": F.lit(version),
                "sort_key": (F.col(sort) if sort else F.lit(0)).cast("long"), "site_key": key("site_key"), "day_key": key("day_key"),
            }
        )
        if records.isEmpty():
            return False
        plain = T.StructType([f for f in out.schema.fields if f.name not in KEYS] + [T.StructField(k, T.StringType()) for k in KEYS])
        out.select(plain.names).repartition(*KEYS).write.partitionBy(*KEYS).mode("overwrite").parquet(self.path(stage))
        self.spark.createDataFrame([(plain.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schemas/{stage}")
        return True

    def read(self, stage: str, site_key: str | None = None, day_key: str | None = None, source_id: str | None = None) -> DataFrame | None:
        """The stage's records by (sort_key, record_id), None if nothing was written. A day without a site is not looked at."""
        if not files.exists(self.spark, f"{self.root}/schemas/{stage}"):
            return None
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schemas/{stage}").first()[0]))
        df = self.spark.read.schema(schema).parquet(self.path(stage))
        if site_key is not None:
            df = df.filter(F.col("site_key") == site_key)
            if day_key is not None:
                df = df.filter(F.col("day_key") == day_key)
        if source_id is not None:
            df = df.filter(F.col("source_id") == source_id)
        return df.orderBy("sort_key", "record_id")

    def stages(self) -> list[str]:
        return files.folders(self.spark, f"{self.root}/stages")
