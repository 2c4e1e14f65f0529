"""Continuous sources and sinks on Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.perception import ROW, TRACK_SCHEMA, TrackState, frames_of
from ..sources.delivery import Delivery


def frames(spark: SparkSession, path: str, schema: str, per_trigger: int = 16, stride: int = 1) -> DataFrame:
    """Every stride-th frame row of a growing folder, counted from the source's start; the query's checkpoint resumes where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.filter(F.pmod("frame_index", F.lit(stride)) == 0) if stride > 1 else stream


def daily(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Observations and mean value per site and day; days close once the watermark has passed them."""
    day = F.window("observed_at", "1 day")
    out = stream.withWatermark("observed_at", delay).groupBy(day, "site_key").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.to_date("window.start").alias("day_key"), "site_key", "n", "mean_value")


def visits(stream: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of an animal: observations no further apart than gap."""
    s = F.session_window("observed_at", gap)
    return stream.withWatermark("observed_at", delay).groupBy("animal_id", s).agg(F.count("*").alias("n")).select("animal_id", "session_window.start", "session_window.end", "n")


def deliver(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, send=None):
    """Keyed events, each delivered once: a batch that runs again finds its keys in the manifest and adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        Delivery(batch.sparkSession, path, send).export(batch, f"epoch-{epoch}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def track_stream(boxes: DataFrame, gap: int = 15, iou: float = 0.20, width: float = 0, height: float = 0) -> DataFrame:
    """The tracker over a stream of (source_id, frame_index, position, x1, y1, x2, y2, last): rows of TrackState.

    Boxes come out with their tracklet at once; a track that ends gives one more row with its reason. The
    state holds a source's active tracks only. `last` marks the source's last frame: tracks still open then
    end with it, and the state is dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else TrackState(str(key[0]), gap, iou, width, height)
        rows: list[tuple] = []
        pdf = pd.concat(list(parts))
        for index, found in frames_of(pdf):
            rows += held.frame(index, found)
        if pdf["last"].any():
            rows += held.close()
            state.remove()
        else:
            state.update((pickle.dumps(held),))
        yield pd.DataFrame(rows, columns=ROW)

    return boxes.groupBy("source_id").applyInPandasWithState(run, TRACK_SCHEMA, "held binary", "append", "NoTimeout")
