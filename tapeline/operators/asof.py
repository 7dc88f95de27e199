"""Joins on time: backward, forward, nearest, overlap and offset fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators.blocks import running

CHUNK_SECONDS = 7 * 86400


def asof_match(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_on: str,
    right_on: str,
    columns: list[str],
    out: str = "_match",
    direction: str = "backward",
    inclusive: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Left rows with ``out``: a struct of the matching right row's time ``at`` and ``columns`` (null when none).

    Both sides are stacked in time order; the latest right row is a running
    maximum of (time, columns), computed in time chunks with a carry between
    chunks, so the values travel with the time and nothing is joined again.  Of
    right rows with one key and time the one with the largest values counts.
    Forward matching is the same on the negated axis.
    """
    sign = 1 if direction == "backward" else -1
    micros = lambda c: F.unix_micros(F.col(c)) * sign
    # inclusive: right rows sort before left rows of the same instant
    first, second = (0, 1) if inclusive else (1, 0)
    rhs = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        (micros(right_on) * 2 + first).alias("_at"),
        F.struct(micros(right_on).alias("_t"), *[F.col(c).alias(c) for c in columns]).alias("_rt"),
    )
    lhs = left.select(
        F.struct(*left.columns).alias("_row"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        (micros(left_on) * 2 + second).alias("_at"),
        F.lit(None).cast(rhs.schema["_rt"].dataType).alias("_rt"),
    )
    rhs = rhs.withColumn("_row", F.lit(None).cast(lhs.schema["_row"].dataType))
    chunk = F.floor(F.col("_at") / (chunk_seconds * 2_000_000)).cast("long")
    matched = running(lhs.unionByName(rhs), [f"_k_{k}" for k in keys], {"_m": ("max", F.col("_rt"))}, "_at", chunk)
    found = F.struct(F.timestamp_micros(F.col("_m._t") * sign).alias("at"), *[F.col(f"_m.{c}").alias(c) for c in columns])
    return matched.filter("_row is not null").select("_row.*", F.when(F.col("_m").isNotNull(), found).alias(out))


def asof_key(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, out: str = "_match", direction: str = "backward",
             inclusive: bool = True, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """For each left row the time of the matching right row (null when none)."""
    found = asof_match(left, right, keys, left_on, right_on, [], out, direction, inclusive, chunk_seconds)
    return found.withColumn(out, F.col(f"{out}.at"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_on: str,
    right_on: str,
    columns: dict[str, str],
    direction: str = "backward",
    inclusive: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Left rows with ``{right column: output name}`` of the as-of match; one row for each left row."""
    found = asof_match(left, right, keys, left_on, right_on, list(columns), "_match", direction, inclusive, chunk_seconds)
    return found.select(*left.columns, *[F.col(f"_match.{c}").alias(o) for c, o in columns.items()])


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_on: str,
    right_on: str,
    columns: dict[str, str],
    tolerance_seconds: float | None = None,
) -> DataFrame:
    """Closest right row on either side; ties take the earlier row."""
    back = asof_match(left, right, keys, left_on, right_on, list(columns), "_back")
    both = asof_match(back, right, keys, left_on, right_on, list(columns), "_fwd", "forward")
    gap = lambda c: F.abs(F.unix_micros(F.col(f"{c}.at")) - F.unix_micros(F.col(left_on)))
    pick = (
        F.when(F.col("_back").isNull(), F.col("_fwd"))
        .when(F.col("_fwd").isNull(), F.col("_back"))
        .when(gap("_back") <= gap("_fwd"), F.col("_back"))
        .otherwise(F.col("_fwd"))
    )
    matched = both.withColumn("_match", pick)
    if tolerance_seconds is not None:
        far = gap("_match") > int(tolerance_seconds * 1_000_000)
        matched = matched.withColumn("_match", F.when(~far, F.col("_match")))
    return matched.select(*left.columns, F.col("_match.at").alias("matched_ts"), *[F.col(f"_match.{c}").alias(o) for c, o in columns.items()])


def fan_out(signals: DataFrame, bars: DataFrame, horizon: int, start: int = 1, idx: str = "bar_idx") -> DataFrame:
    """Each signal with its bars ``idx+start .. idx+start+horizon-1`` (``step`` from 0).

    An equi join on (symbol, bar number): work is signals x horizon.
    """
    steps = signals.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))).withColumn(
        "_bar", F.col(idx) + F.lit(start) + F.col("step")
    )
    path = bars.select(
        "symbol",
        F.col("bar_idx").alias("_bar"),
        F.col("ts").alias("bar_ts"),
        F.col("high").alias("bar_high"),
        F.col("low").alias("bar_low"),
        F.col("close").alias("bar_close"),
    )
    return steps.join(path, ["symbol", "_bar"]).withColumnRenamed("_bar", "path_idx")


def purge(signals: DataFrame, windows: DataFrame, tail_seconds: int, ts: str = "ts") -> DataFrame:
    """Drop signals whose holding span meets a test window (closed ends).

    ``windows`` is a parameter table (``test_start, test_end``) with one row
    per walk-forward window, so it is broadcast.
    """
    w = F.broadcast(windows.select(F.col("test_start").alias("_a"), F.col("test_end").alias("_z")))
    last = F.timestamp_micros(F.unix_micros(F.col(ts)) + tail_seconds * 1_000_000)
    return signals.join(w, (F.col(ts) <= F.col("_z")) & (last >= F.col("_a")), "left_anti")


def overlaps_any(zones: DataFrame, others: DataFrame, keys: list[str], low: str, high: str, width: float) -> DataFrame:
    """Add ``overlaps``: does any other zone of the key share a price with this one.

    A zone overlaps when, among the others that begin at or below its top, the
    highest end reaches its bottom: a running maximum along the price axis, in
    price chunks of ``width``.
    """
    mine = zones.select(F.struct(*zones.columns).alias("_row"), *[F.col(k).alias(f"_k_{k}") for k in keys],
                        F.col(high).alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_end"))
    theirs = others.select(F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"),
                           *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(low).alias("_p"),
                           F.lit(0).alias("_side"), F.col(high).alias("_end"))
    both = mine.unionByName(theirs).withColumn("_at", F.struct("_p", "_side"))
    reach = running(both, [f"_k_{k}" for k in keys], {"_m": ("max", F.col("_end"))}, "_at",
                    F.floor(F.col("_p") / width).cast("long"))
    found = F.coalesce(F.col("_m") >= F.col(f"_row.{low}"), F.lit(False))
    return reach.filter("_row is not null").select("_row.*", found.alias("overlaps"))


def correlation_conflicts(
    candidates: DataFrame, held: DataFrame, returns: DataFrame, limit: float = 0.7, min_points: int = 20
) -> DataFrame:
    """Candidates whose returns correlate beyond ``limit`` with a held symbol.

    ``held`` is the open book (bounded by the position limit), so only
    candidate x held pairs are formed, matched on time.
    """
    mine = returns.join(candidates.select("symbol"), "symbol", "left_semi").select("symbol", "ts", F.col("ret").alias("_a"))
    book = returns.join(held.select("symbol"), "symbol", "left_semi").select(
        F.col("symbol").alias("held_symbol"), "ts", F.col("ret").alias("_b")
    )
    pairs = mine.join(book, "ts").filter("symbol <> held_symbol").groupBy("symbol", "held_symbol").agg(
        F.corr("_a", "_b").alias("correlation"), F.count(F.lit(1)).alias("points")
    )
    return pairs.withColumn("conflict", (F.abs("correlation") > limit) & (F.col("points") >= min_points))


def dataset_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Per column: rows on both sides, on one side only, and beyond tolerance."""
    tall = lambda d: d.unpivot(keys, columns, "column", "value")
    a = tall(old).withColumnRenamed("value", "old").withColumn("_o", F.lit(1))
    b = tall(new).withColumnRenamed("value", "new").withColumn("_n", F.lit(1))
    j = a.join(b, [*keys, "column"], "full")
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()
    return j.groupBy("column").agg(
        F.count_if(both).alias("both"),
        F.count_if(F.col("_n").isNull()).alias("only_old"),
        F.count_if(F.col("_o").isNull()).alias("only_new"),
        F.count_if(both & (F.abs(F.col("old") - F.col("new")) > tolerance)).alias("different"),
    )
