"""Pipeline events as streams: decoded, folded to flags, and checked against a status machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundwork import schemas
from groundwork.operators import state


def read_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of the JSON-lines files of a folder, decoded."""
    return state.decode(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def flags(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Flags of each document version so far, repeated events dropped; for update or complete mode."""
    once = events.where("is_valid").withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["event_id"])
    kind = F.col("event_type")
    return once.groupBy("doc_id", "version_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max((kind == "body_chunks_indexed").cast("int")).cast("boolean").alias("is_body_searchable"),
        F.max((kind == "search_projection_activated").cast("int")).cast("boolean").alias("is_enriched_searchable"),
    )


def throughput(events: DataFrame, window: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Events a window and type; late ones beyond the watermark are dropped, and so are those without a time."""
    return (
        events.withWatermark("occurred_at", watermark)
        .groupBy(F.window("occurred_at", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("w.start", "event_type", "n")
    )


def check_statuses(statuses: DataFrame, machine: str) -> DataFrame:
    """Steps of a stream of (key, seq, status), checked as they come: (key, seq, current, next, valid).

    The state of a key is its last status. Within one batch rows count by ``seq``.
    """
    edges = set(state.MACHINES[machine])

    def step(key: tuple, frames: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
        current = last.get[0] if last.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, status in zip(rows["seq"], rows["status"], strict=True):
            if current is not None:
                out.append((key[0], seq, current, status, (current, status) in edges))
            current = status
        last.update((current,))
        yield pd.DataFrame(out, columns=["key", "seq", "current", "next", "valid"])

    return statuses.groupBy("key").applyInPandasWithState(
        step,
        "key string, seq long, current string, next string, valid boolean",
        "status string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def schema() -> str:
    return schemas.EVENT
