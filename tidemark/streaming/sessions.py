"""Sessions over a stream of events, by Spark's own session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SESSION_GAP_MINUTES


def streaming_sessions(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES, late: str = "1 hour") -> DataFrame:
    """visitorid, session_start, session_end (of the last event's window), counts. Works on streams and on batches; a stream's
    sessions come out once the watermark has passed them."""
    source = events.withWatermark("datetime", late) if events.isStreaming else events
    window = F.session_window("datetime", f"{gap_minutes} minutes")
    return source.groupBy("visitorid", window.alias("w")).agg(F.count("*").alias("n_events"), F.count_if(F.col("event") == "view").alias("n_views"), F.count_if(F.col("event") == "transaction").alias("n_transactions")).select("visitorid", F.col("w.start").alias("session_start"), (F.col("w.end") - F.expr(f"INTERVAL {gap_minutes} MINUTES")).alias("session_end"), "n_events", "n_views", "n_transactions")


def streaming_popularity(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """itemid, window start, weighted events: tumbling windows that a batch job can decay and add up."""
    from ..functions.scoring import event_weight

    source = events.withWatermark("datetime", late) if events.isStreaming else events
    return source.groupBy("itemid", F.window("datetime", every).alias("w")).agg(F.sum(event_weight(F.col("event"))).alias("weight")).select("itemid", F.col("w.start").alias("window_start"), "weight")
