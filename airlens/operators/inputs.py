"""Health of stream inputs (AGG-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def input_health(reads: DataFrame) -> DataFrame:
    """Per input: up, bytes, reconnects, errors and last data time.

    ``reads``: ``input, arrival, us, kind ('open'|'data'|'error'), bytes, reason``. An input is up until its last row is an
    error; every open after the first is a reconnect.
    """
    kind = F.col("kind")
    return reads.groupBy("input").agg(
        F.max_by(kind != "error", "arrival").alias("up"),
        F.coalesce(F.sum(F.when(kind != "error", F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"),
        F.greatest(F.count_if(kind == "open") - 1, F.lit(0)).alias("reconnects"),
        F.count_if(kind == "error").alias("errors"),
        F.max(F.when(kind == "data", F.col("us"))).alias("last_data_us"),
    )


def input_errors(reads: DataFrame) -> DataFrame:
    """Errors per input and reason."""
    return reads.filter("kind = 'error'").groupBy("input", "reason").agg(F.count(F.lit(1)).alias("errors"))
