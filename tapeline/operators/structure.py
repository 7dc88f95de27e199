"""Price structure without look-ahead: swings, gaps, breaks, order blocks, sweeps.

Inputs are numbered bars of one timeframe: ``symbol, ts, bar_idx, open, high,
low, close, volume``.  Events are tables keyed by ``(symbol, bar_idx)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.bars import KEYS
from tapeline.operators.blocks import BLOCK, framed, running
from tapeline.operators.touch import extreme_tree, first_touch, range_extremes
from tapeline.session import materialize

ORDER_BLOCK_REACH = 19  # bars searched back from a break


def as_float32(column: Column) -> Column:
    """Levels of order blocks are kept at single precision."""
    return column.cast("float").cast("double")


def swings(bars: DataFrame, length: int, size: int = BLOCK) -> DataFrame:
    """Add ``swing`` (+1/-1/null) and ``swing_level``; the high wins a tie."""

    def build(w):
        past = w.rowsBetween(-length, -1)
        full = F.count(F.lit(1)).over(past) == length
        top = full & (F.col("high") >= F.max("high").over(past))
        bottom = full & (F.col("low") <= F.min("low").over(past))
        return {
            "swing": F.when(top, 1).when(bottom, -1),
            "swing_level": F.when(top, F.col("high")).when(bottom, F.col("low")),
        }

    return framed(bars, KEYS, build, before=length, size=size)


def swing_marks(bars: DataFrame, length: int | str, tree=None, size: int = BLOCK) -> DataFrame:
    """Add ``top`` and ``bottom``: not below (above) any of the ``length`` bars before, which must be there.

    ``length`` is a number, or a column with a length for each row (a symbol's
    own parameter); then the extremes before a bar are read from the tree of
    block extremes, five equi joins whatever the lengths are.
    """
    at = F.col("bar_idx")
    if isinstance(length, int):

        def build(w):
            past = w.rowsBetween(-length, -1)
            full = at >= length
            return {"top": full & (F.col("high") >= F.max("high").over(past)), "bottom": full & (F.col("low") <= F.min("low").over(past))}

        return framed(bars, KEYS, build, before=length, size=size)
    ends = {"_from": (at - F.col(length)).cast("long"), "_to": (at - 1).cast("long")}
    tree = tree if tree is not None else extreme_tree(bars)
    seen = range_extremes(bars.withColumns(ends), tree, "_from", "_to", "_least", "_most")
    full = at >= F.col(length)
    marks = {"top": full & F.coalesce(F.col("high") >= F.col("_most"), F.lit(False)), "bottom": full & F.coalesce(F.col("low") <= F.col("_least"), F.lit(False))}
    return seen.withColumns(marks).drop("_from", "_to", "_least", "_most")


def swings_by_symbol(bars: DataFrame, length: str = "swing_length", tree=None, size: int = BLOCK) -> DataFrame:
    """``swings`` with the length that each row names (K5: parameters by symbol)."""
    marked = swing_marks(bars, length, tree, size)
    found = {
        "swing": F.when(F.col("top"), 1).when(F.col("bottom"), -1),
        "swing_level": F.when(F.col("top"), F.col("high")).when(F.col("bottom"), F.col("low")),
    }
    return marked.withColumns(found).drop("top", "bottom")


def gaps(bars: DataFrame, size: int = BLOCK) -> DataFrame:
    """Three-bar gaps, placed on the bar that completes them (+1 up, -1 down)."""

    def build(w):
        high2, low2 = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
        body = F.lag("close", 1).over(w) - F.lag("open", 1).over(w)
        up = (high2 < F.col("low")) & (body > 0)
        down = (low2 > F.col("high")) & (body < 0)
        return {
            "gap": F.when(up, 1).when(down, -1),
            "gap_top": F.when(up, F.col("low")).when(down, low2),
            "gap_bottom": F.when(up, high2).when(down, F.col("high")),
        }

    return framed(bars, KEYS, build, before=2, size=size)


def breaks(swung: DataFrame, size: int = BLOCK) -> DataFrame:
    """Break events: ``bar_idx, sign, kind (BOS/CHOCH), level, broken_idx``.

    A level is the last swing before a bar.  All bars that look at the same
    swing form a group and only the first one beyond it breaks it, so breaks
    are a grouped minimum.  Bars that break upwards cannot break downwards.
    Whether a break continues or turns the trend depends on the break before.
    """
    is_high, is_low = F.col("swing") == 1, F.col("swing") == -1
    seen = running(
        swung,
        KEYS,
        {
            "high_idx": ("max", F.when(is_high, F.col("bar_idx")), False),
            "high_lvl": ("last", F.when(is_high, F.col("swing_level")), False),
            "low_idx": ("max", F.when(is_low, F.col("bar_idx")), False),
            "low_lvl": ("last", F.when(is_low, F.col("swing_level")), False),
        },
        size=size,
    ).select("symbol", "ts", "bar_idx", "high", "low", "high_idx", "high_lvl", "low_idx", "low_lvl")
    beyond = (F.col("high") > F.col("high_lvl")) | (F.col("low") < F.col("low_lvl"))
    seen = materialize(seen.filter(beyond))  # scanned several times below; few bars are beyond a level

    def first_beyond(rows, idx, lvl, sign):
        return rows.groupBy("symbol", F.col(idx).alias("broken_idx")).agg(
            F.min("bar_idx").alias("bar_idx"), F.min("ts").alias("ts"), F.min(lvl).alias("level")
        ).withColumn("sign", F.lit(sign))

    above = seen.filter(F.col("high") > F.col("high_lvl"))
    up = first_beyond(above, "high_idx", "high_lvl", 1)
    below = seen.filter(F.col("low") < F.col("low_lvl"))
    below = below.join(up.select("symbol", "bar_idx"), ["symbol", "bar_idx"], "left_anti")
    both = up.unionByName(first_beyond(below, "low_idx", "low_lvl", -1))
    trend = running(both, KEYS, {"trend": ("last", F.col("sign"), False)}, size=size)
    return trend.select(
        "symbol",
        "ts",
        "bar_idx",
        "sign",
        F.when(F.col("trend") == F.col("sign"), "BOS").otherwise("CHOCH").alias("kind"),
        "level",
        "broken_idx",
    )


def order_blocks(bars: DataFrame, broken: DataFrame, size: int = BLOCK) -> DataFrame:
    """Last opposite candle in the bars before a break; one row per origin.

    ``bar_idx`` is the origin, ``confirmed_idx`` the first break that named it.
    """
    body = F.col("close") - F.col("open")

    def build(w):
        reach = w.rowsBetween(-ORDER_BLOCK_REACH, -1)
        return {
            "red_idx": F.max(F.when(body < 0, F.col("bar_idx"))).over(reach),
            "green_idx": F.max(F.when(body > 0, F.col("bar_idx"))).over(reach),
        }

    candles = framed(bars.select("symbol", "bar_idx", "open", "close"), KEYS, build, ORDER_BLOCK_REACH, size=size)
    named = (
        broken.select("symbol", "bar_idx", "sign")
        .join(candles.select("symbol", "bar_idx", "red_idx", "green_idx"), ["symbol", "bar_idx"])
        .withColumn("origin", F.when(F.col("sign") > 0, F.col("red_idx")).otherwise(F.col("green_idx")))
        .filter("origin is not null")
        .groupBy("symbol", F.col("origin").alias("bar_idx"), F.col("sign").alias("ob"))
        .agg(F.min("bar_idx").alias("confirmed_idx"))
    )
    wick = F.col("high") - F.col("low")
    return named.join(bars, ["symbol", "bar_idx"]).select(
        "symbol",
        "ts",
        "bar_idx",
        "ob",
        as_float32(F.col("high")).alias("ob_top"),
        as_float32(F.col("low")).alias("ob_bottom"),
        as_float32(F.col("volume")).alias("ob_volume"),
        as_float32(F.when(wick > 0, F.abs(body) / wick * 100).otherwise(0.0)).alias("ob_percentage"),
        "confirmed_idx",
    )


def gap_mitigation(gap_rows: DataFrame, bars: DataFrame, tree=None) -> DataFrame:
    """``mitigated_idx``: price reaches the far side of the gap."""
    up = F.col("gap") > 0
    return first_touch(
        gap_rows, bars, "bar_idx", F.when(up, F.col("gap_bottom")).otherwise(F.col("gap_top")), up,
        False, "mitigated_idx", tree=tree,
    )


def order_block_mitigation(blocks: DataFrame, bars: DataFrame, tree=None) -> DataFrame:
    """``mitigated_idx``: price passes beyond the block, tested from its origin on."""
    up = F.col("ob") > 0
    return first_touch(
        blocks, bars, "bar_idx", F.when(up, F.col("ob_bottom")).otherwise(F.col("ob_top")), up,
        True, "mitigated_idx", tree=tree,
    )


def liquidity(swung: DataFrame, bars: DataFrame, range_percent: float = 0.005, tree=None) -> DataFrame:
    """Levels at swings and the bar that sweeps them beyond the range."""
    levels = swung.filter("swing is not null").select(
        "symbol", "ts", "bar_idx", F.col("swing").alias("liquidity"), F.col("swing_level").alias("level")
    )
    below = F.col("liquidity") < 0
    price = F.when(below, F.col("level") * (1 - range_percent)).otherwise(F.col("level") * (1 + range_percent))
    return first_touch(levels, bars, "bar_idx", price, below, True, "end_idx", tree=tree).withColumn(
        "swept", F.when(F.col("end_idx").isNotNull(), 1)
    )


def indicator_bundle(bars: DataFrame, swing_length: int = 8, range_percent: float = 0.005) -> dict[str, DataFrame]:
    """All structure tables of one timeframe; ``bars`` should be a stored table."""
    tree = extreme_tree(bars)
    swung = swings(bars, swing_length)
    broken = breaks(swung)
    return {
        "swings": swung,
        "gaps": gap_mitigation(gaps(bars).filter("gap is not null"), bars, tree),
        "breaks": broken,
        "order_blocks": order_block_mitigation(order_blocks(bars, broken), bars, tree),
        "liquidity": liquidity(swung, bars, range_percent, tree),
    }


def running_structure(bars: DataFrame, broken: DataFrame, size: int = BLOCK) -> DataFrame:
    """Per bar: last break sign, any break yet, last break was CHoCH, decay since.

    ``structure`` -1/0/1, ``strong`` boolean, ``after_choch`` boolean,
    ``decay`` exp(-0.05 * bars since the last break; 100 bars before any).
    """
    events = broken.select("symbol", "bar_idx", "sign", (F.col("kind") == "CHOCH").cast("int").alias("_choch"))
    rows = bars.join(events, ["symbol", "bar_idx"], "left")
    state = running(
        rows,
        KEYS,
        {
            "_s": ("last", F.col("sign")),
            "_c": ("last", F.col("_choch")),
            "_at": ("max", F.when(F.col("sign").isNotNull(), F.col("bar_idx"))),
        },
        size=size,
    )
    since = F.coalesce(F.col("bar_idx") - F.col("_at"), F.lit(100))
    return state.select(
        *bars.columns,
        F.coalesce("_s", F.lit(0)).alias("structure"),
        F.col("_s").isNotNull().alias("strong"),
        (F.coalesce("_c", F.lit(0)) == 1).alias("after_choch"),
        F.exp(-0.05 * since).alias("decay"),
        F.coalesce("sign", F.lit(0)).alias("break_sign"),
    )


def recent_flag(rows: DataFrame, flags: dict[str, Column], bars_back: int, size: int = BLOCK) -> DataFrame:
    """For each named condition: did it hold on this bar or one of the ``bars_back`` before."""

    def build(w):
        frame = w.rowsBetween(-bars_back, 0)
        return {n: F.coalesce(F.max(c.cast("int")).over(frame), F.lit(0)) == 1 for n, c in flags.items()}

    return framed(rows, KEYS, build, before=bars_back, size=size)


def active_counts(bars: DataFrame, zones: DataFrame, end: str, size: int = BLOCK) -> DataFrame:
    """Zones alive on each bar: +1 where they start, -1 where they end, summed.

    ``zones``: ``symbol, bar_idx, <end>``; a zone counts on bars
    ``bar_idx <= i < end``.
    """
    starts = zones.groupBy("symbol", "bar_idx").agg(F.count(F.lit(1)).alias("_d"))
    ends = (
        zones.filter(F.col(end).isNotNull())
        .groupBy("symbol", F.col(end).alias("bar_idx"))
        .agg((-F.count(F.lit(1))).alias("_d"))
    )
    delta = starts.unionByName(ends).groupBy("symbol", "bar_idx").agg(F.sum("_d").alias("_d"))
    rows = bars.join(delta, ["symbol", "bar_idx"], "left")
    return running(rows, KEYS, {"active": ("sum", F.col("_d"))}, size=size).drop("_d")


def premium_discount(bars4h: DataFrame, size: int = BLOCK) -> DataFrame:
    """Midpoint of the last swing high and low, null unless high > low."""
    state = running(
        bars4h,
        KEYS,
        {
            "_sh": ("last", F.when(F.col("swing") == 1, F.col("swing_level"))),
            "_sl": ("last", F.when(F.col("swing") == -1, F.col("swing_level"))),
        },
        size=size,
    )
    return state.withColumn(
        "midpoint", F.when(F.col("_sh") > F.col("_sl"), (F.col("_sh") + F.col("_sl")) / 2)
    ).drop("_sh", "_sl")


def swings_centred(bars: DataFrame, length: int, size: int = BLOCK) -> DataFrame:
    """Swings confirmed by later bars (labels only): extreme of the 2*length bars
    that end ``length`` bars ahead."""

    def build(w):
        around = w.rowsBetween(1 - length, length)
        full = F.count(F.lit(1)).over(around) == 2 * length
        top, bottom = full & (F.col("high") == F.max("high").over(around)), full & (F.col("low") == F.min("low").over(around))
        return {
            "swing": F.when(top, 1).when(bottom, -1),
            "swing_level": F.when(top, F.col("high")).when(bottom, F.col("low")),
        }

    return framed(bars, KEYS, build, before=length, after=length, size=size)


def gaps_centred(bars: DataFrame, size: int = BLOCK) -> DataFrame:
    """Three-bar gaps placed on the middle bar, which needs the next bar (labels only)."""

    def build(w):
        high1, low1, high2, low2 = F.lag("high").over(w), F.lag("low").over(w), F.lead("high").over(w), F.lead("low").over(w)
        up = (high1 < low2) & (F.col("close") > F.col("open"))
        down = (low1 > high2) & (F.col("close") < F.col("open"))
        return {
            "gap": F.when(up, 1).when(down, -1),
            "gap_top": F.when(up, low2).when(down, low1),
            "gap_bottom": F.when(up, high1).when(down, high2),
        }

    return framed(bars, KEYS, build, before=1, after=1, size=size)
