"""Folds, samples and weights of training sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.operators.blocks import number_rows

# Fixed values: (train start, train end, test start, test end) come from these lengths in months.
TRAIN_MONTHS, TEST_MONTHS = 6, 3


def walk_forward_windows(spark: SparkSession, start: str, end: str, train: int = TRAIN_MONTHS, test: int = TEST_MONTHS) -> DataFrame:
    """Rolling windows by calendar months: train, then test, advancing by test."""
    months = f"months_between(date'{end}', date'{start}')"
    steps = spark.sql(f"select explode(sequence(0, greatest(cast(floor(({months} - {train}) / {test}) as int) - 1, 0))) as window_id")
    begin = F.add_months(F.lit(start).cast("date"), F.col("window_id") * test)
    out = steps.select(
        "window_id",
        begin.alias("train_start"),
        F.add_months(begin, train).alias("train_end"),
        F.add_months(begin, train).alias("test_start"),
        F.add_months(begin, train + test).alias("test_end"),
    )
    return out.filter(F.col("test_end") <= F.lit(end).cast("date"))


def hash_order(*columns: str, seed: int = 42) -> Column:
    """Seeded pseudo-random order that does not depend on partitioning."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))


def take_per_group(df: DataFrame, keys: list[str], quota: DataFrame, order: Column, tie: str) -> DataFrame:
    """The first ``quota`` rows per key in ``order`` without sorting a key in one task.

    The order is cut into buckets; bucket counts (map-side) tell in which
    bucket the quota ends.  Rows of earlier buckets are all taken, and only the
    rows of that one bucket are ranked.
    """
    spread = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 52))  # 4 096 buckets
    counts = spread.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    plan = before.join(quota, keys).withColumn("_left", F.col("quota") - F.col("_before")).filter("_left > 0")
    kept = spread.join(plan.select(*keys, "_b", "_left"), [*keys, "_b"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o", tie))
    return kept.withColumn("_r", rank).filter("_r <= _left").drop("_o", "_b", "_left", "_r")


def subsample_no_trade(samples: DataFrame, ratio: float, tie: str, seed: int = 42) -> DataFrame:
    """All entries, and at most ``ratio`` no-trade rows per entry and class."""
    per_class = samples.groupBy("asset_class").agg(F.count_if(F.col("label_action") > 0).alias("_e"))
    quota = per_class.select("asset_class", F.floor(F.col("_e") * ratio).alias("quota"))
    idle = take_per_group(samples.filter("label_action = 0"), ["asset_class"], quota, hash_order(tie, seed=seed), tie)
    return samples.filter("label_action > 0").unionByName(idle)


def stratified(samples: DataFrame, keys: list[str], fraction: float, tie: str, seed: int = 42) -> DataFrame:
    """The same share of every class, exact to a row."""
    quota = samples.groupBy(*keys).agg(F.round(F.count(F.lit(1)) * fraction).cast("long").alias("quota"))
    return take_per_group(samples, keys, quota, hash_order(tie, seed=seed), tie)


def balanced(samples: DataFrame, label: str, tie: str, seed: int = 42) -> DataFrame:
    """As many rows of every label as the rarest one has."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    quota = counts.crossJoin(counts.agg(F.min("_n").alias("quota"))).select(label, "quota")
    return take_per_group(samples, [label], quota, hash_order(tie, seed=seed), tie)


def cap_rows(samples: DataFrame, key: str, max_rows: int, tie: str, seed: int = 42) -> DataFrame:
    """Proportional sample per window so that all windows together fit the cap."""
    sizes = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    share = F.least(F.lit(1.0), F.lit(max_rows) / F.col("_t"))
    quota = sizes.crossJoin(total).select(key, F.floor(F.col("_n") * share).cast("long").alias("quota"))
    return take_per_group(samples, [key], quota, hash_order(tie, seed=seed), tie)


def expanding_folds(samples: DataFrame, window: str = "window", min_train: int = 6) -> DataFrame:
    """Rows with their role in each fold: train 0..k, validation k+1, test k+2.

    Folds are rows of a small table made from the window numbers; a row is
    repeated once per fold it takes part in.
    """
    folds = samples.select(F.col(window).alias("_w")).distinct().filter(F.col("_w") >= min_train + 1).select(
        (F.col("_w") - min_train - 1).alias("fold"), F.col("_w").alias("test_window")
    )
    role = F.when(F.col(window) == F.col("test_window"), "test").when(
        F.col(window) == F.col("test_window") - 1, "validation"
    ).otherwise("train")
    return samples.join(F.broadcast(folds), F.col(window) <= F.col("test_window")).withColumn("role", role)


def holdout(samples: DataFrame, column: str, value: str) -> DataFrame:
    return samples.withColumn("role", F.when(F.col(column) == value, "test").otherwise("train"))


def group_split(samples: DataFrame, window: str, share: float = 0.8) -> DataFrame:
    """Early windows train, late windows test; a trade lies in one window only."""
    edge = samples.agg((F.min(window) + F.floor((F.max(window) - F.min(window) + 1) * share)).alias("_edge"))
    return samples.crossJoin(F.broadcast(edge)).withColumn(
        "role", F.when(F.col(window) < F.col("_edge"), "train").otherwise("test")
    ).drop("_edge")


def out_of_sample_part(samples: DataFrame, window: str, share: float = 2 / 3) -> DataFrame:
    """Only rows after the cut at two thirds of the windows."""
    edge = samples.agg(F.floor((F.max(window) + 1) * share).alias("_edge"))
    return samples.crossJoin(F.broadcast(edge)).filter(F.col(window) >= F.col("_edge")).drop("_edge")


def recency_weight(rows: DataFrame, keys: list[str], ts: str, tie: str, halflife: float) -> DataFrame:
    """Weight halves every ``halflife`` rows of age (newest has age 0)."""
    ranked = number_rows(rows, keys, ts, 30 * 86400, (tie,), "_i", "_n")
    age = F.col("_n") - 1 - F.col("_i")
    return ranked.withColumn("recency_weight", F.exp(-math.log(2) * age / halflife)).drop("_i", "_n")


def window_weight(samples: DataFrame, window: str = "window") -> DataFrame:
    top = samples.agg(F.max(window).alias("_m"))
    w = F.exp((F.col(window) - F.col("_m")) / (0.3 * F.greatest(F.col("_m"), F.lit(1))))
    return samples.crossJoin(F.broadcast(top)).withColumn("recency_weight", w).drop("_m")


def fuse(backtest: DataFrame, live: DataFrame, counterfactual: DataFrame, ts: str, tie: str, share: float = 0.3) -> DataFrame:
    """Backtest, live and counterfactual rows; the last share of live validates."""
    counted = number_rows(live.withColumn("_all", F.lit(0)), ["_all"], ts, 30 * 86400, (tie,), "_i", "_n")
    role = F.when(F.col("_i") >= F.floor(F.col("_n") * (1 - share)), "validation").otherwise("train")
    marked = counted.withColumn("role", role).drop("_i", "_n", "_all").withColumn("source", F.lit("live"))
    rest = [
        d.withColumn("role", F.lit("train")).withColumn("source", F.lit(n))
        for d, n in ((backtest, "backtest"), (counterfactual, "counterfactual"))
    ]
    return marked.unionByName(rest[0], True).unionByName(rest[1], True)
