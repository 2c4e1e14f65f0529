"""Events to a consumer: retained before they are sent, sent at least once, kept once by their key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


class ConsumerUnavailable(RuntimeError):
    """The consumer could not be reached; its events are retained."""


@dataclass
class Report:
    """delivered counts duplicates too."""

    attempted: int = 0
    delivered: int = 0
    duplicates: int = 0
    undelivered: int = 0
    retries: int = 0


class Delivery:
    """root/events (JSON), root/manifest (delivered keys by day), root/pending (batches not yet delivered).

    send takes the events that were not delivered before and raises ConsumerUnavailable if it must be tried
    again; by default they are written to root/events, a batch's files replacing those of an earlier try of it.
    Events: idempotency_key, us and any other columns. A key holds its event's time, so only the manifest of the
    days at hand is read.
    """

    ATTEMPTS = 3

    def __init__(self, spark: SparkSession, root: str, send: Callable[[DataFrame, str], None] | None = None, attempts: int = ATTEMPTS):
        self.spark, self.root, self.send, self.attempts, self.report = spark, root.rstrip("/"), send or self.write, attempts, Report()

    def write(self, events: DataFrame, batch: str) -> None:
        events.drop("day").write.mode("overwrite").json(f"{self.root}/events/batch={batch}")

    def delivered(self) -> DataFrame:
        if not files.exists(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], "idempotency_key string, day date, batch string")
        return self.spark.read.schema("idempotency_key string, day date, batch string").parquet(f"{self.root}/manifest")

    def pending(self) -> list[str]:
        return [n.removeprefix("batch=") for n in files.folders(self.spark, f"{self.root}/pending")]

    def export(self, events: DataFrame, batch: str) -> Report:
        """Deliver a batch; repeated keys count as duplicates. The batch stays pending if every attempt fails."""
        kept = f"{self.root}/pending/batch={batch}"
        events.withColumn("day", F.to_date(F.timestamp_micros("us"))).write.mode("overwrite").parquet(kept)
        return self._deliver(batch)

    def retry_pending(self) -> Report:
        for batch in self.pending():
            self._deliver(batch)
        return self.report

    def _deliver(self, batch: str) -> Report:
        kept = f"{self.root}/pending/batch={batch}"
        every = self.spark.read.parquet(kept)
        span = every.agg(F.count("*"), F.min("day"), F.max("day")).first()
        done = self.delivered().filter(F.col("day").between(F.lit(span[1]), F.lit(span[2])) & (F.col("batch") != batch)).select("idempotency_key")
        fresh = every.dropDuplicates(["idempotency_key"]).join(done, "idempotency_key", "left_anti")
        new = fresh.count()
        self.report.attempted += span[0]
        for attempt in range(self.attempts):
            self.report.retries += attempt > 0
            try:
                if new:
                    self.send(fresh, batch)
                    keys = fresh.select("idempotency_key", F.lit(batch).alias("batch"), "day")
                    keys.write.option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").mode("overwrite").parquet(f"{self.root}/manifest")
                break
            except ConsumerUnavailable:
                continue
        else:
            self.report.undelivered += span[0]
            return self.report
        self.report.delivered += span[0]
        self.report.duplicates += span[0] - new
        files.delete(self.spark, kept)
        return self.report
