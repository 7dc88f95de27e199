"""First later bar that reaches a price level, without pairing levels and bars.

Bars are folded into arrays of ``FAN`` extremes per block, and blocks again
into super blocks.  A level climbs that tree (own block, own super block, the
top) and comes down again where the extreme says the touch must be.  Every step
is an equi join to one row, so a level is never multiplied by bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

FAN = 256


def _first_hit(values: Column, start: Column, level: Column, strict: Column) -> Column:
    """0-based position >= start whose value is below the level; null if none."""
    hits = F.transform(values, lambda v, i: (i >= start) & ((v < level) | (~strict & (v == level))))
    found = F.array_position(hits, True)
    return F.when(found > 0, found - 1)


def extreme_tree(bars: DataFrame, fan: int = FAN):
    """Three levels of low / negated-high arrays over the bars of each symbol."""
    def fold(df, lo, hi, idx):
        order = lambda c: F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(c).alias("v")))), lambda s: s["v"]
        )
        return order(lo).alias("lows"), order(hi).alias("neg_highs")

    flat = bars.select(
        "symbol", "bar_idx", F.col("low").alias("lo"), (-F.col("high")).alias("nh"),
        F.floor(F.col("bar_idx") / fan).cast("long").alias("blk"),
    )
    level1 = materialize(
        flat.groupBy("symbol", "blk").agg(
            *fold(flat, "lo", "nh", "bar_idx"), F.min("lo").alias("lo"), F.min("nh").alias("nh")
        )
    )
    up = level1.select("symbol", "blk", "lo", "nh", F.floor(F.col("blk") / fan).cast("long").alias("sup"))
    level2 = up.groupBy("symbol", "sup").agg(
        *fold(up, "lo", "nh", "blk"), F.min("lo").alias("lo"), F.min("nh").alias("nh")
    )
    top = level2.select("symbol", "sup", "lo", "nh")
    level3 = top.groupBy("symbol").agg(*fold(top, "lo", "nh", "sup"))
    return level1, level2, level3


def _last_hit(values: Column, stop: Column, level: Column, strict: Column) -> Column:
    """0-based position <= stop whose value is below the level, the last one; null if none."""
    hits = F.transform(values, lambda v, i: (i <= stop) & ((v < level) | (~strict & (v == level))))
    found = F.array_position(F.reverse(hits), True)
    return F.when(found > 0, F.size(values) - found)


def search(
    levels: DataFrame,
    tree,
    at: str,
    level: Column,
    falling: Column,
    strict: Column | bool,
    out: str,
    backward: bool = False,
    fan: int = FAN,
) -> DataFrame:
    """Add ``out``: the bar nearest to ``at`` (itself included) that reaches the level.

    ``falling``: a low at or below the level counts, else a high at or above
    it.  ``strict``: beyond the level instead of up to it.  Forward finds the
    first such bar from ``at`` on, ``backward`` the last one up to ``at``.
    """
    level1, level2, level3 = tree
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    df = levels.select(
        "*", falling.alias("_down"), F.when(falling, level).otherwise(-level).alias("_lvl"), strict.alias("_strict"),
        F.floor(F.col(at) / fan).cast("long").alias("_blk"),
    )
    find, edge, shift = (_last_hit, F.lit(fan), -1) if backward else (_first_hit, F.lit(0), 1)
    blk, own, insup, top = F.col("_blk"), F.col("_own"), F.col("_insup"), F.col("_top")
    sup = F.floor(blk / fan).cast("long")
    df = _read(df, level1, "blk", blk, "_own", find, F.col(at) % fan)
    # levels that are settled keep a spread key, so they do not pile up in one partition
    df = _read(df, level2, "sup", sup, "_insup", find, blk % fan + shift, own.isNull())
    df = _read(df, level3, None, None, "_top", find, sup + shift, own.isNull() & insup.isNull())
    df = _read(df, level2, "sup", F.coalesce(top, -1 - blk), "_down2", find, edge)
    far = F.when(own.isNull(), F.coalesce(sup * fan + insup, top * fan + F.col("_down2")))
    df = _read(df, level1, "blk", F.coalesce(far, -1 - blk), "_bar", find, edge)
    result = F.coalesce(blk * fan + own, far * fan + F.col("_bar"))
    return df.select(*levels.columns, result.cast("long").alias(out))


def _read(df, table, key, value, name, find, bound, when=None):
    """Left join of one tree row per level row, reduced to the position found in it."""
    right = table.select(F.col("symbol").alias("_rs"), *([F.col(key).alias("_rk")] if key else []), "lows", "neg_highs")
    on = F.col("symbol") == F.col("_rs")
    if key:
        on = on & (value == F.col("_rk"))
    if when is not None:
        on = on & when
    side = F.when(F.col("_down"), F.col("lows")).otherwise(F.col("neg_highs"))
    return df.join(right, on, "left").select(*df.columns, find(side, bound, F.col("_lvl"), F.col("_strict")).alias(name))


def first_touch(
    levels: DataFrame,
    bars: DataFrame,
    start: str,
    level: Column,
    falling: Column,
    strict: Column | bool = False,
    out: str = "touch_idx",
    fan: int = FAN,
    tree=None,
) -> DataFrame:
    """Add ``out``: the first bar number >= ``start`` that reaches the level."""
    tree = tree if tree is not None else extreme_tree(bars, fan)
    return search(levels, tree, start, level, falling, strict, out, fan=fan)


def range_extremes(rows: DataFrame, tree, start: str, end: str, low: str, high: str, fan: int = FAN) -> DataFrame:
    """Lowest low and highest high of bars ``start..end`` (inclusive) per row.

    The range is the tail of one block, whole blocks, and the head of another;
    whole blocks are read from at most two super blocks and the top, so the
    cost per row does not grow with the length of the range.
    """
    level1, level2, level3 = tree
    s, e = F.col(start), F.col(end)
    df = rows.select("*", F.floor(s / fan).cast("long").alias("_bs"), F.floor(e / fan).cast("long").alias("_be"))
    bs, be = F.col("_bs"), F.col("_be")
    us, ue = F.floor((bs + 1) / fan).cast("long"), F.floor((be - 1) / fan).cast("long")
    inner, same, one = be - bs > 1, bs == be, us == ue
    none = -1 - bs  # matches no block, and keeps rows spread

    def part(df, table, key, value, tag, first, last, when=None):
        right = table.select(
            F.col("symbol").alias("_rs"), *([F.col(key).alias("_rk")] if key else []), F.col("lows").alias("_l"), F.col("neg_highs").alias("_h")
        )
        on = F.col("symbol") == F.col("_rs")
        if key:
            on = on & (value == F.col("_rk"))
        if when is not None:
            on = on & when
        cut = lambda c: F.array_min(F.slice(F.col(c), first + 1, F.greatest(last - first + 1, F.lit(0))))
        return df.join(right, on, "left").select(*df.columns, cut("_l").alias(f"_{tag}l"), cut("_h").alias(f"_{tag}h"))

    whole = F.lit(fan - 1)
    df = part(df, level1, "blk", bs, "a", (s % fan).cast("int"), F.when(same, e % fan).otherwise(whole).cast("int"))
    df = part(df, level1, "blk", F.when(same, none).otherwise(be), "b", F.lit(0), (e % fan).cast("int"))
    df = part(df, level2, "sup", F.when(inner, us).otherwise(none), "c", ((bs + 1) % fan).cast("int"),
              F.when(one, (be - 1) % fan).otherwise(whole).cast("int"))
    df = part(df, level2, "sup", F.when(inner & ~one, ue).otherwise(none), "d", F.lit(0), ((be - 1) % fan).cast("int"))
    df = part(df, level3, None, None, "e", (us + 1).cast("int"), (ue - 1).cast("int"), inner & (ue - us > 1))
    valid = e >= s
    return df.select(
        *rows.columns,
        F.when(valid, F.least(*[F.col(f"_{t}l") for t in "abcde"])).alias(low),
        F.when(valid, -F.least(*[F.col(f"_{t}h") for t in "abcde"])).alias(high),
    )
