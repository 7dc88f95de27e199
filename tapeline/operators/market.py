"""Volume, volatility and regime measures of bars; volume profile; trend agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import scores
from tapeline.operators.bars import KEYS, true_range
from tapeline.operators.blocks import framed
from tapeline.operators.recursive import simple_atr

BINS = 10
LOOKBACK = 100


def volume_measures(bars: DataFrame) -> DataFrame:
    """Volume ratio to its 20-bar mean, relative-volume score, confirmation flag."""

    def build(w):
        mean20 = F.avg("volume").over(w.rowsBetween(-19, 0))
        full = F.count(F.lit(1)).over(w.rowsBetween(-19, 0)) >= 5
        past = F.avg("volume").over(w.rowsBetween(-LOOKBACK, -1))
        rel = F.col("volume") / past
        before = F.avg("volume").over(w.rowsBetween(-20, -1))
        return {
            "volume_ratio": F.when(full & (mean20 > 0), F.least(F.col("volume") / mean20, F.lit(5.0))).otherwise(1.0),
            "relative_ratio": F.when((F.col("bar_idx") >= 19) & (past > 0), rel).otherwise(0.0),
            "relative_score": F.when(
                (F.col("bar_idx") >= 19) & (past > 0) & (rel >= 1.5), F.least(rel, F.lit(3.0)) / 3.0
            ).otherwise(0.0),
            "volume_ok": F.coalesce((F.col("bar_idx") >= 4) & (before > 0) & (F.col("volume") >= before * 1.2), F.lit(False)),
        }

    return framed(bars, KEYS, build, before=LOOKBACK)


def regime_volatility(bars: DataFrame) -> DataFrame:
    """Deviation of the last 50 closes over that of the last 200, in 0.5..2."""

    def build(w):
        short = F.stddev_pop("close").over(w.rowsBetween(-49, 0))
        long = F.stddev_pop("close").over(w.rowsBetween(-199, 0))
        return {"regime_volatility": F.when(long > 0, scores.clip(short / long, 0.5, 2.0)).otherwise(1.0)}

    return framed(bars, KEYS, build, before=199)


def volatility_filter(bars: DataFrame, least: float, period: int = 14) -> DataFrame:
    """Bars whose mean true range is at least a share of the close."""
    moved = framed(bars, KEYS, lambda w: {"_tr": true_range(w)}, before=1)
    rows = framed(moved, KEYS, lambda w: {"_atr": F.avg("_tr").over(w.rowsBetween(1 - period, 0))}, before=period)
    share = F.when(F.col("close") > 0, F.col("_atr") / F.col("close")).otherwise(0.0)
    return rows.withColumn("atr_share", share).filter(F.col("atr_share") >= least).drop("_tr", "_atr")


def symbol_profile(bars: DataFrame, day_bars: int = 288, first_rows: int | None = None) -> DataFrame:
    """Volatility, traded value and range per symbol, over all bars or an explicit prefix.

    Per-bar values come from bounded frames; the symbol level is one
    aggregation with map-side combine.
    """
    bars = bars if first_rows is None else bars.filter(F.col("bar_idx") < first_rows)
    moved = framed(bars, KEYS, lambda w: {"_tr": true_range(w)}, before=1)
    rows = moved.filter("close > 0")
    usd = F.col("close") * F.col("volume")
    by_day = rows.groupBy("symbol", F.floor(F.col("bar_idx") / day_bars).alias("_d")).agg(
        F.sum(F.col("_tr") / F.col("close")).alias("_a"), F.count(F.lit(1)).alias("_n"), F.sum(usd).alias("_u"),
        F.max("high").alias("_h"), F.min("low").alias("_l"), F.sum("close").alias("_c"),
    )
    return by_day.groupBy("symbol").agg(
        (F.sum("_a") / F.sum("_n")).alias("atr_pct"),
        (F.sum("_u") / F.sum("_n")).alias("usd_volume"),
        ((F.max("_h") - F.min("_l")) / (F.sum("_c") / F.sum("_n"))).alias("range_pct"),
        F.avg("_u").alias("day_usd_volume"),
        F.sum("_n").alias("bars"),
    )


def instrument_profile(bars: DataFrame, day_bars: int = 288, period: int = 14) -> DataFrame:
    """Per symbol: mean share of the full ATR in the close scaled to a day, bars per day, bars.

    The scale is the root of the bars of a full day.  Days are whole days from
    the first bar to the last; within one day all bars count as one day's.
    """
    share = F.when((F.col("bar_idx") >= period) & (F.col("close") > 0), F.col("atr_simple") / F.col("close"))
    p = simple_atr(bars, period).groupBy("symbol").agg(F.avg(share).alias("_a"), F.count(F.lit(1)).alias("bars"), F.min("ts").alias("_x"), F.max("ts").alias("_y"))
    days = F.floor((F.unix_seconds("_y") - F.unix_seconds("_x")) / 86_400)
    return p.select("symbol", (F.coalesce("_a", F.lit(0.0)) * F.sqrt(F.lit(float(day_bars)))).alias("daily_atr_pct"), (F.col("bars") / F.greatest(days, F.lit(1))).alias("bars_per_day"), "bars")


def volume_profile(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Profile score of requests ``req_id, symbol, bar_idx, entry, target, direction``.

    Each request reads its last 100 bars by an equi join; bar volume is spread
    over ten price bins by overlap.
    """
    fan = requests.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(LOOKBACK - 1)))).withColumn(
        "_at", F.col("bar_idx") - F.col("_k")
    )
    b = bars.select("symbol", F.col("bar_idx").alias("_at"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("volume").alias("_v"))
    rows = fan.join(b, ["symbol", "_at"])
    span = rows.groupBy("req_id").agg(
        F.min("_l").alias("_min"), F.max("_h").alias("_max"), F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.when((F.col("_h") > F.col("_l")) & (F.col("_v") > 0), F.struct("_l", "_h", "_v"))).alias("_bars"),
    )
    width = (F.col("_max") - F.col("_min")) / BINS
    lo = lambda i: F.col("_min") + width * i
    filled = span.withColumn(
        "_bins",
        F.array(*[_bin(lo(i), lo(i + 1)) for i in range(BINS)]),
    )
    total = F.aggregate("_bins", F.lit(0.0), lambda a, x: a + x)
    dens = filled.withColumn("_total", total).withColumn("_d", F.transform("_bins", lambda x: x / F.col("_total")))
    j = requests.join(dens.drop("_bars", "_bins"), "req_id")
    place = lambda p: F.least(F.greatest(((F.col(p) - F.col("_min")) / (F.col("_max") - F.col("_min")) * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))
    j = j.withColumns({"_e": place("entry"), "_t": place("target")})
    first = F.when(F.col("direction") > 0, F.col("_e")).otherwise(F.col("_t"))
    last = F.when(F.col("direction") > 0, F.col("_t")).otherwise(F.col("_e"))
    size = F.greatest(last - first + 1, F.lit(0))
    path = F.aggregate(F.slice("_d", first + 1, size), F.lit(0.0), lambda a, x: a + x) / size
    path_score = F.when(size > 0, scores.clip(1 - (path * BINS - 0.5), 0.0, 1.0)).otherwise(0.5)
    entry_score = F.least(F.element_at("_d", F.col("_e") + 1) * BINS, F.lit(2.0)) / 2.0
    thin = (F.col("_n") < 20) | (F.col("_max") <= F.col("_min")) | (F.col("_total") <= 0)
    score = F.when(thin, 0.5).otherwise(scores.clip(entry_score * 0.4 + path_score * 0.6, 0.0, 1.0))
    return j.select(*requests.columns, score.alias("profile_score"))


def _bin(low: Column, high: Column) -> Column:
    """Volume of the collected bars that falls into one price bin."""
    def add(acc, x):
        part = F.least(x["_h"], high) - F.greatest(x["_l"], low)
        return acc + F.when(part > 0, x["_v"] * part / (x["_h"] - x["_l"])).otherwise(0.0)

    return F.aggregate("_bars", F.lit(0.0), add)

