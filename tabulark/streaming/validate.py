"""Q16: contract validation on a stream of new rows.

Validation is stateless per row, so the batch operator applies unchanged to a
streaming DataFrame: no watermark or state store is needed. Sinks get
exactly-once output through Structured Streaming's checkpointed offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.contract import validate


def validate_stream(stream_df: DataFrame, contract, row_id: str) -> DataFrame:
    """Issues ``(row, column, severity, code)`` for each arriving row."""
    return validate(stream_df, contract, row_id)


def run_validation(
    stream_df: DataFrame, contract, row_id: str, sink_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Validate a stream into a parquet sink. ``checkpoint`` must be a shared,
    durable folder so a restarted query resumes without loss or duplicates."""
    issues = validate_stream(stream_df, contract, row_id)
    w = issues.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
