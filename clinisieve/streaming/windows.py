"""Counts, rates and latencies per time window, with the alert thresholds of the monitoring.

Each function takes a table or a stream.  A stream needs ``watermark``, the time it waits for
late rows; its windows are emitted once they are complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinisieve.operators.quantiles import grouped_quantile

# Alert thresholds and window lengths.
FAILED_LOGINS, LOGIN_WINDOW = 50, "5 minutes"
ERROR_RATE, P99_MS, METRIC_WINDOW = 0.05, 5000.0, "60 seconds"


def _late(df: DataFrame, time: str, watermark: str | None) -> DataFrame:
    if not df.isStreaming:
        return df
    if watermark is None:
        raise ValueError("a stream needs a watermark")
    return df.withWatermark(time, watermark)


def _start_end(width: str) -> list[Column]:
    return [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]


def failed_login_windows(df: DataFrame, failed: Column, time: str = "ts", *, width: str = LOGIN_WINDOW,
                         threshold: int = FAILED_LOGINS, watermark: str | None = None) -> DataFrame:
    """Windows with more failed logins than the threshold."""
    counts = (_late(df, time, watermark).filter(failed)
              .groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("failures")))
    return counts.filter(F.col("failures") > threshold).select(*_start_end(width), "failures")


def error_rate_windows(df: DataFrame, failed: Column, time: str = "ts", *, width: str = METRIC_WINDOW,
                       threshold: float = ERROR_RATE, only_alerts: bool = False,
                       watermark: str | None = None) -> DataFrame:
    """Failures per second, and their share of all requests, per window; alert above the threshold."""
    counts = _late(df, time, watermark).groupBy(F.window(time, width).alias("w")).agg(
        F.count_if(failed).alias("failures"), F.count(F.lit(1)).alias("requests"))
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp"))
               - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1_000_000
    out = counts.select(
        *_start_end(width), "failures", "requests",
        (F.col("failures") / seconds).alias("failures_per_second"),
        (F.col("failures") / F.col("requests")).alias("failure_share"),
        (F.col("failures") / seconds > threshold).alias("alert"))
    return out.filter("alert") if only_alerts else out


def p99_windows(df: DataFrame, latency: str, time: str = "ts", *, width: str = METRIC_WINDOW,
                threshold: float = P99_MS, only_alerts: bool = False,
                watermark: str | None = None) -> DataFrame:
    """The 99th percentile of the latency per window; exact on a table, a sketch on a stream."""
    if df.isStreaming:
        out = _late(df, time, watermark).groupBy(F.window(time, width).alias("w")).agg(
            F.percentile_approx(latency, 0.99, 10_000).cast("double").alias("p99"))
        out = out.select(*_start_end(width), "p99")
    else:
        keyed = df.withColumn("w", F.window(time, width)).select(*_start_end(width), latency)
        out = grouped_quantile(keyed, ["window_start", "window_end"], latency, 0.99, "p99")
    out = out.withColumn("alert", F.col("p99") > threshold)
    return out.filter("alert") if only_alerts else out
