"""Progress records as a stream. The request surface names event subscriptions without answering them; this
is what Structured Streaming offers for its append-only progress records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(progress: DataFrame, key: str = "job_id", at: str = "ts") -> DataFrame:
    """The newest record of each job (update or complete mode)."""
    fields = [c for c in progress.columns if c not in (key, at)]
    return progress.groupBy(key).agg(F.max(at).alias(at), F.max_by(F.struct(*fields), F.col(at)).alias("r")).select(key, at, "r.*")


def per_window(events: DataFrame, at: str = "ts", late: str = "10 minutes", width: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """Events of each kind in each window; late ones count until the watermark passes the window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
