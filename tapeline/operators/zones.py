"""Zones around price: quality, nearest active zone, confluence, recent zone, stops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import scores
from tapeline.operators.bars import KEYS
from tapeline.operators.blocks import BLOCK, framed, running
from tapeline.operators.recursive import ema_bias_corrected, simple_atr, simple_rsi
from tapeline.operators.touch import extreme_tree, search


def closed_through(zones: DataFrame, closes_tree, at: str) -> DataFrame:
    """Add ``untouched``: 1 never closed inside, 0.5 inside, 0 through the zone.

    Tests the closes after the zone's bar and before bar ``at`` by two
    searches on the tree of closes.
    """
    up = F.col("sign") > 0
    far = F.when(up, F.col("bottom")).otherwise(F.col("top"))
    near = F.when(up, F.col("top")).otherwise(F.col("bottom"))
    rows = zones.withColumn("_from", F.col("bar_idx") + 1)
    rows = search(rows, closes_tree, "_from", far, up, True, "_through")
    rows = search(rows, closes_tree, "_from", near, up, True, "_inside")
    before = lambda c: F.coalesce(F.col(c) < F.col(at), F.lit(False))
    value = F.when(before("_through"), 0.0).when(before("_inside"), 0.5).otherwise(1.0)
    return rows.withColumn("untouched", value).drop("_from", "_through", "_inside")


def closes_as_bars(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "bar_idx", F.col("close").alias("low"), F.col("close").alias("high"))


def rate_zones(zones: DataFrame, bars: DataFrame, age: int, overlap: Column) -> DataFrame:
    """Quality of each zone ``age`` bars after it formed; needs ``atr`` on the bars."""
    rows = zones.withColumn("_at", F.col("bar_idx") + age)
    rows = closed_through(rows, extreme_tree(closes_as_bars(bars)), "_at")
    form = bars.select(
        "symbol", "bar_idx", scores.formation_quality(F.col("open"), F.col("high"), F.col("low"), F.col("close")).alias("formation")
    )
    atr = bars.select("symbol", F.col("bar_idx").alias("_at"), "atr")
    rows = rows.join(form, ["symbol", "bar_idx"]).join(atr, ["symbol", "_at"])
    size = scores.zone_size_score(F.abs(F.col("top") - F.col("bottom")), F.col("atr"))
    quality = scores.zone_quality(F.lit(age), F.col("untouched"), F.col("size_score"), F.col("formation"), overlap)
    return rows.withColumn("size_score", size).withColumn("zone_quality", quality).withColumn(
        "zone_quality_ok", F.col("zone_quality") >= 0.7
    ).drop("_at")


def nearest_zones(bars: DataFrame, zones: DataFrame, end: str, cap: float = 5.0, size: int = BLOCK) -> DataFrame:
    """Distance in ATR to the nearest active zone above and below, and their number.

    A zone is sent to the blocks of bars it lives in, as long as it lies within
    ``cap`` ATR of that block's prices; farther ones cannot change a capped
    distance.  The number of active zones comes from running counts.
    """
    from tapeline.operators.structure import active_counts

    blocked = bars.withColumn("_b", F.floor(F.col("bar_idx") / size).cast("long"))
    reach = blocked.groupBy("symbol", "_b").agg(
        F.min("close").alias("_lo"), F.max("close").alias("_hi"), (F.max("atr") * cap).alias("_r")
    )
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    live = zones.join(last, "symbol").withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("bar_idx") / size).cast("long"), F.floor(F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last")) / size).cast("long")
    )))
    near = live.join(reach, ["symbol", "_b"]).filter(
        (F.col("mid") <= F.col("_hi") + F.col("_r")) & (F.col("mid") >= F.col("_lo") - F.col("_r"))
    ).select("symbol", "_b", "bar_idx", F.coalesce(F.col(end), F.lit(np.iinfo(np.int64).max)).alias("_end"), "mid")

    def measure(key, rows: pd.DataFrame, zs: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        above = np.full(len(rows), cap)
        below = np.full(len(rows), cap)
        idx, close, atr = rows["bar_idx"].to_numpy(), rows["close"].to_numpy(), rows["atr"].to_numpy()
        for start, stop, mid in zip(zs["bar_idx"].to_numpy(), zs["_end"].to_numpy(), zs["mid"].to_numpy()):
            a, z = np.searchsorted(idx, [start, stop])
            d = np.where(atr[a:z] > 0, (mid - close[a:z]) / np.where(atr[a:z] > 0, atr[a:z], 1.0), 0.0)
            above[a:z] = np.where(d > 0, np.minimum(above[a:z], d), above[a:z])
            below[a:z] = np.where(d < 0, np.minimum(below[a:z], -d), below[a:z])
        return pd.DataFrame({"symbol": rows["symbol"], "bar_idx": idx, "dist_above": above, "dist_below": below})

    left = blocked.select("symbol", "_b", "bar_idx", "close", "atr").groupBy("symbol", "_b")
    dist = left.cogroup(near.groupBy("symbol", "_b")).applyInPandas(
        measure, "symbol string, bar_idx long, dist_above double, dist_below double"
    )
    counted = active_counts(bars.select("symbol", "bar_idx"), zones, end, size)
    return dist.join(counted, ["symbol", "bar_idx"]).withColumn(
        "active_share", F.least(F.coalesce("active", F.lit(0)), F.lit(20)) / 20.0
    ).drop("active")


def recent_zone(bars: DataFrame, zones: DataFrame, bars_back: int, prefer: str = "fvg") -> DataFrame:
    """Newest zone per bar and direction among the last bars, one type first."""
    offered = zones.withColumn("_age", F.explode(F.sequence(F.lit(0), F.lit(bars_back - 1)))).withColumn(
        "_at", F.col("bar_idx") + F.col("_age")
    )
    rank = F.when(F.col("type") == prefer, 1_000_000).otherwise(0) - F.col("_age")
    best = offered.groupBy("symbol", F.col("_at").alias("bar_idx"), "sign").agg(
        F.max_by("type", rank).alias("zone_type"), F.max_by("top", rank).alias("zone_top"), F.max_by("bottom", rank).alias("zone_bottom")
    )
    return best.join(bars.select("symbol", "bar_idx"), ["symbol", "bar_idx"], "left_semi")


def confluence(entries: DataFrame, breaks: DataFrame, zones: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    """Distinct tags of events from three bars before to one bar after an entry."""
    tags = breaks.select("symbol", "bar_idx", F.concat(F.col("kind"), F.when(F.col("sign") > 0, "_up").otherwise("_down")).alias("tag")).unionByName(
        zones.select("symbol", "bar_idx", F.concat(F.upper("type"), F.when(F.col("sign") > 0, "_up").otherwise("_down")).alias("tag"))
    )
    near = tags.withColumn("bar_idx", F.explode(F.sequence(F.col("bar_idx") - after, F.col("bar_idx") + before)))
    grouped = near.groupBy("symbol", "bar_idx").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return entries.join(grouped, ["symbol", "bar_idx"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def missed_setups(breaks: DataFrame, zones: DataFrame) -> DataFrame:
    """Bars with a break and a gap of one direction, less the one that was traded."""
    gap = zones.filter("type = 'fvg'").select("symbol", "bar_idx", "sign")
    both = breaks.select("symbol", "bar_idx", "sign").join(gap, ["symbol", "bar_idx", "sign"])
    return both.groupBy("symbol").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("missed"))


def structural_stop(rows: DataFrame, blocks: DataFrame, levels: DataFrame, size: int = BLOCK) -> DataFrame:
    """Stop below/above the newest order block on the safe side, else the last level.

    The newest block is a running value along the bars; each bar carries the
    last bullish and bearish block and the last liquidity levels.
    """
    ob = blocks.groupBy("symbol", "bar_idx").agg(
        F.max(F.when(F.col("ob") > 0, F.col("ob_bottom"))).alias("_ub"), F.max(F.when(F.col("ob") < 0, F.col("ob_top"))).alias("_dt")
    )
    lv = levels.groupBy("symbol", "bar_idx").agg(
        F.max(F.when(F.col("liquidity") > 0, F.col("level"))).alias("_hi"), F.min(F.when(F.col("liquidity") < 0, F.col("level"))).alias("_lo")
    )
    j = rows.join(ob, ["symbol", "bar_idx"], "left").join(lv, ["symbol", "bar_idx"], "left")
    state = running(j, KEYS, {n: ("last", F.col(c)) for n, c in (("_1", "_ub"), ("_2", "_dt"), ("_3", "_hi"), ("_4", "_lo"))}, size=size)
    below = lambda c: F.when(F.col(c) < F.col("close"), F.col(c))
    above = lambda c: F.when(F.col(c) > F.col("close"), F.col(c))
    return state.select(
        *rows.columns,
        F.coalesce(below("_1"), below("_4")).alias("stop_long"), F.coalesce(above("_2"), above("_3")).alias("stop_short"),
        F.coalesce(above("_2"), above("_3")).alias("target_long"), F.coalesce(below("_1"), below("_4")).alias("target_short"),
    )


def optimal_points(entries: DataFrame, blocks: DataFrame, swung: DataFrame, levels: DataFrame, bars: DataFrame) -> DataFrame:
    """Entry, stop and target that structure would have offered up to the entry bar.

    Entry: newest order block on the safe side of the price.  Stop: newest
    swing low/high beyond it.  Target: first liquidity level of the frame above
    (long), newest below (short).  Each is one search on a tree of levels.
    """
    def level_tree(df, low, high):
        return extreme_tree(
            bars.select("symbol", "bar_idx").join(df, ["symbol", "bar_idx"], "left").select(
                "symbol", "bar_idx", F.coalesce(low, F.lit(1e300)).alias("low"), F.coalesce(high, F.lit(-1e300)).alias("high")
            )
        )

    up, entry = F.col("direction") > 0, F.col("entry")
    ob = blocks.groupBy("symbol", "bar_idx").agg(F.min("ob_bottom").alias("_b"), F.max("ob_top").alias("_t"))
    sw = swung.filter("swing is not null").select(
        "symbol", "bar_idx", F.when(F.col("swing") == -1, F.col("low")).alias("_b"), F.when(F.col("swing") == 1, F.col("high")).alias("_t")
    )
    lq = levels.groupBy("symbol", "bar_idx").agg(F.min("level").alias("_b"), F.max("level").alias("_t"))
    rows = search(entries, level_tree(ob, F.col("_b"), F.col("_t")), "bar_idx", entry, up, False, "_ob", backward=True)
    rows = search(rows, level_tree(sw, F.col("_b"), F.col("_t")), "bar_idx", entry, up, True, "_sw", backward=True)
    tree = level_tree(lq, F.col("_b"), F.col("_t"))
    rows = search(rows.withColumn("_zero", F.lit(0).cast("long")), tree, "_zero", entry, F.lit(False), True, "_first")
    rows = search(rows, tree, "bar_idx", entry, F.lit(True), True, "_last", backward=True)
    rows = rows.withColumn("_lq", F.when(up, F.when(F.col("_first") <= F.col("bar_idx"), F.col("_first"))).otherwise(F.col("_last")))
    for tag, table in (("_ob", ob), ("_sw", sw), ("_lq", lq)):
        side = table.select("symbol", F.col("bar_idx").alias(tag), F.col("_b").alias(f"{tag}_b"), F.col("_t").alias(f"{tag}_t"))
        rows = rows.join(side, ["symbol", tag], "left")
    pick = lambda t, lo, hi: F.when(up, F.col(f"{t}_{lo}")).otherwise(F.col(f"{t}_{hi}"))
    best = F.coalesce(pick("_ob", "b", "t"), entry)
    stop = F.coalesce(pick("_sw", "b", "t"), F.col("stop"))
    return rows.select(
        *entries.columns, best.alias("optimal_entry"), stop.alias("optimal_sl"),
        F.coalesce(pick("_lq", "t", "b"), F.col("target")).alias("optimal_tp"),
        (F.abs(entry - stop) < F.abs(entry - F.col("stop"))).alias("sl_tighter"),
    )


def pip_size(symbol: Column, asset_class: Column) -> Column:
    return (
        F.when(asset_class == "forex", F.when(symbol.contains("JPY"), 0.01).otherwise(0.0001))
        .when((asset_class == "commodities") & symbol.contains("XAU"), 0.1)
        .otherwise(0.01)
    )


def universe_scan(bars: DataFrame, min_atr_share: float) -> DataFrame:
    """Latest state per symbol: volatility and thin-volume filters, then scores.

    The newest row per symbol is an aggregated maximum; its frames of at most
    100 bars come from bounded windows before that.
    """
    averages = ema_bias_corrected(bars, {"ema20": 20, "ema50": 50})
    rows = simple_rsi(simple_atr(averages, 14, "atr14"), 14, "rsi14")
    rows = framed(
        rows, KEYS,
        lambda w: {"_v20": F.avg("volume").over(w.rowsBetween(-19, 0)), "_v100": F.avg("volume").over(w.rowsBetween(-99, 0))},
        before=99,
    )
    last = rows.groupBy("symbol").agg(
        F.max_by(F.struct("ts", "close", "volume", "atr14", "ema20", "ema50", "rsi14", "_v20", "_v100", "n_bars"), "bar_idx").alias("x")
    )
    x = last.select("symbol", "x.*").filter((F.col("n_bars") >= 30) & (F.col("close") > 0))
    x = x.filter((F.col("atr14") / F.col("close") >= min_atr_share) & (F.col("volume") / F.col("_v20") >= 0.5))
    rsi = F.col("rsi14")
    return x.select(
        "symbol", "ts", (F.col("atr14") / F.col("close")).alias("atr_share"),
        (F.least(F.col("volume") / F.col("_v100"), F.lit(2.0)) / 2).alias("volume_score"),
        F.when(F.col("ema20") > F.col("ema50"), F.least((F.col("ema20") - F.col("ema50")) / F.col("close") * 100, F.lit(1.0))).otherwise(0.0).alias("trend_score"),
        F.when((rsi >= 40) & (rsi <= 60), 1.0).when((rsi >= 30) & (rsi <= 70), 0.6).otherwise(0.3).alias("momentum_score"),
    )


def episode_ids(rows: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """New episode whenever the bars-held counter falls back."""
    resets = running(rows, keys, {"_prev": ("last", F.col("bars_held"), False)}, order, block)
    marked = resets.withColumn("_r", F.coalesce((F.col("bars_held") < F.col("_prev")).cast("int"), F.lit(0)))
    return running(marked, keys, {"episode": ("sum", F.col("_r"))}, order, block).drop("_prev", "_r")
