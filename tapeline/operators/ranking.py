"""Ranks and scores of instruments within their class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Component weights of the opportunity score.
OPPORTUNITY_WEIGHTS = {
    "alignment": 0.30, "volume": 0.20, "trend_strength": 0.20, "session": 0.15, "zone_quality": 0.10, "rr_score": 0.05,
}


def percent_rank(per_symbol: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """rank/(n-1) in ascending order, ties by symbol; 0.5 for a single one.

    Input has one row per symbol, already aggregated.
    """
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(value, "symbol")) - 1
    return per_symbol.withColumn(out, F.when(n == 1, 0.5).otherwise(rank / (n - 1)))


def class_scores(scans: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Z-score in the group through a logistic curve; raw when alone; 0.5 without spread."""
    stats = scans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in components],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in components],
    )

    def score(c: str) -> Column:
        z = (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")
        return F.when(F.col("_n") < 2, F.col(c)).when(F.col(f"_s_{c}") < 1e-10, 0.5).otherwise(1 / (1 + F.exp(-z)))

    joined = scans.join(stats, keys).withColumns({f"z_{c}": score(c) for c in components})
    return joined.drop("_n", *[f"_{p}_{c}" for c in components for p in "ms"])


def opportunities(scans: DataFrame, cycle: str, weights: dict[str, float] | None = None, least: float = 0.5, top: int = 10) -> DataFrame:
    """Best instruments per scan cycle from the class scores.

    ``row_number <= top`` per cycle becomes a partial top-k before the shuffle.
    """
    weights = weights or OPPORTUNITY_WEIGHTS
    active = scans.filter("market_open and (volume > 0 or trend_strength > 0 or session > 0)")
    scored = class_scores(active, [cycle, "asset_class"], list(weights))
    total = sum((F.col(f"z_{c}") * w for c, w in weights.items()), F.lit(0.0))
    total = F.least(F.when(F.col("has_signal"), total * 1.2).otherwise(total), F.lit(1.0))
    ranked = scored.withColumn("score", total).filter(F.col("score") >= least)
    w = Window.partitionBy(cycle).orderBy(F.desc(F.round("score", 9)), "symbol")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
