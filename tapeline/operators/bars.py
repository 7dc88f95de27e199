"""OHLCV bars: from ticks, from finer bars, and per-symbol summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.operators.blocks import number_rows

# Timeframe names and their length in seconds.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
KEYS = ["symbol"]


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def arrival_order(ts: Column, tie: Column) -> Column:
    """(ts, tie) as one sortable decimal, so min_by/max_by stay hash aggregates."""
    return F.unix_micros(ts).cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + tie.cast(
        "decimal(19,0)"
    )


def bars_from_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """Ticks ``(symbol, ts, seq, price, volume)`` to bars; empty bins have no row.

    One aggregation with map-side combine: what is shuffled is one partial bar
    per symbol, bin and map task, so a hot symbol costs no more than a cold one.
    """
    ordered = ticks.withColumn("_at", arrival_order(F.col("ts"), F.col("seq")))
    return (
        ordered.groupBy("symbol", bucket_start(F.col("ts"), TIMEFRAMES[tf]).alias("ts"))
        .agg(
            F.min_by("price", "_at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_at").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumn("tf", F.lit(tf))
    )


def coarsen(bars: DataFrame, tf: str) -> DataFrame:
    """Finer bars to ``tf`` bars (first, max, min, last, sum)."""
    return (
        bars.groupBy("symbol", bucket_start(F.col("ts"), TIMEFRAMES[tf]).alias("_bin"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_bin", "ts")
        .withColumn("tf", F.lit(tf))
    )


def numbered(bars: DataFrame) -> DataFrame:
    return number_rows(bars, KEYS)


def all_timeframes(bars: DataFrame, available: str, wanted: list[str]) -> DataFrame:
    """Base bars plus every missing coarser timeframe, as one tall table."""
    out = bars.withColumn("tf", F.lit(available))
    for tf in wanted:
        if tf != available:
            out = out.unionByName(coarsen(bars, tf))
    return out


def liquidity_rank(bars: DataFrame, window_days: int = 30, min_days: int = 15, digits: int = 2) -> DataFrame:
    """Month-end rank of symbols by their rolling dollar volume, rounded to cents.

    Equal volumes share a rank: sums of the same values in another order differ
    in their last bits, so they are rounded before they are ranked.  Daily sums
    first (map-side combine); the calendar spine and the rolling frame then work
    on one row per symbol and day.
    """
    daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.sum(F.col("close") * F.col("volume")).alias("usd_volume")
    )
    span = daily.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    filled = spine.join(daily, ["symbol", "day"], "left")
    frame = Window.partitionBy("symbol").orderBy("day").rowsBetween(1 - window_days, 0)
    rolled = filled.withColumn(
        "rolling",
        F.when(
            F.count("usd_volume").over(frame) >= min_days,
            F.sum("usd_volume").over(frame),
        ),
    )
    month_end = (
        rolled.groupBy("symbol", F.trunc("day", "month").alias("month"))
        .agg(F.max_by("rolling", F.when(F.col("rolling").isNotNull(), F.col("day"))).alias("usd_volume"))
        .filter("usd_volume is not null")
        .withColumn("usd_volume", F.round("usd_volume", digits))
    )
    by_month = Window.partitionBy("month").orderBy(F.desc("usd_volume"))
    return month_end.withColumn("rank", F.rank().over(by_month))


def true_range(w) -> Column:
    """True range against the previous close; first bar: high - low."""
    prev = F.lag("close").over(w)
    hl = F.col("high") - F.col("low")
    return F.coalesce(F.greatest(hl, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)), hl)


def history_sufficiency(bars: DataFrame, before: str) -> DataFrame:
    """Bars before a date and first bar, per symbol and timeframe."""
    return bars.groupBy("symbol", "tf").agg(
        F.count_if(F.col("ts") < F.lit(before).cast("timestamp")).alias("bars_before"),
        F.min("ts").alias("first_ts"),
    )
