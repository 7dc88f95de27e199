"""Account rules: open positions, loss limits, allocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tapeline.functions.scores import risk_fraction
from tapeline.operators.blocks import curve, running
from tapeline.operators.greedy import greedy_keep

# Loss limits of the breaker.
DAILY_LIMIT, WEEKLY_LIMIT, ALLTIME_LIMIT = 0.03, 0.05, 0.08
DAY_US = 86_400_000_000


def portfolio_run(trades: DataFrame, keys: list[str], account: float = 100_000.0, chunk_seconds: int = 7 * 86400) -> DataFrame:
    """Trades taken per account ``keys``: one open position per symbol, a fixed share of the start equity at risk.

    Input: ``keys, trade_id, symbol, ts, exit_ts, score, entry, stop, direction,
    exit_price, outcome, cost_pct, risk_cap`` (outcome already resolved).  Which
    trades are taken depends on time only; results are in R and add up, so
    equity is a running sum.  Equity, pauses and sizes do not feed back.
    """
    stop_pct = F.abs(F.col("entry") - F.col("stop")) / F.col("entry")
    share = F.least(risk_fraction(F.col("score")), F.col("risk_cap"))
    rows = trades.withColumns({
        "start_us": F.unix_micros("ts"), "exit_us": F.unix_micros("exit_ts"), "stop_pct": stop_pct, "risk_share": share,
        "price_pnl": (F.col("exit_price") - F.col("entry")) * F.col("direction") / F.col("entry"),
    }).filter("stop_pct > 0 and risk_share > 0").select(
        *keys, "trade_id", "symbol", "start_us", "exit_us", "stop_pct", "price_pnl", "risk_share", "cost_pct", "outcome"
    )
    kept = greedy_keep(rows, [*keys, "symbol"], "start_us", "exit_us", "trade_id", chunk_seconds * 1_000_000)
    pnl = account * F.col("risk_share") / F.col("stop_pct") * (F.col("price_pnl") - F.col("cost_pct"))
    booked = kept.withColumns({"pnl": pnl, "actual_rr": F.col("price_pnl") / F.col("stop_pct")})
    week = F.floor(F.col("start_us") / (7 * DAY_US)).cast("long")
    run = curve(booked, keys, "pnl", ["start_us", "trade_id"], week, start=account)
    return run.select(
        *keys, "trade_id", "symbol", "outcome", "pnl", "equity", "risk_share", "actual_rr",
        F.timestamp_micros("start_us").alias("ts"), F.timestamp_micros("exit_us").alias("exit_time"),
    )


def variant_book(
    trades: DataFrame, variants: DataFrame, account: float = 100_000.0, chunk_seconds: int = 7 * 86400
) -> DataFrame:
    """One open trade per variant; equity compounds by a fixed share of itself.

    ``variants`` is a parameter table.  Which trades are taken depends on time
    only, so the greedy selection runs in chunks; equity is a product of growth
    factors, a running sum of their logarithms.
    """
    rows = trades.crossJoin(F.broadcast(variants)).filter(
        (F.col("score") >= F.col("threshold")) & (F.col("risk_reward") >= F.col("min_rr"))
    ).withColumns({"start_us": F.unix_micros("ts"), "exit_us": F.unix_micros("exit_ts")})
    kept = greedy_keep(rows, ["variant"], "start_us", "exit_us", "trade_id", chunk_seconds * 1_000_000)
    stop_pct = F.abs(F.col("entry") - F.col("stop")) / F.col("entry")
    size = F.least(F.least(F.col("risk"), F.lit(0.03)) / stop_pct, F.col("leverage").cast("double"))
    moved = (F.col("exit_price") - F.col("entry")) * F.col("direction") / F.col("entry")
    growth = size * (moved - F.col("cost_pct"))
    rr = growth / F.least(F.col("risk"), F.lit(0.03))
    logged = kept.withColumns({"_g": F.log1p(F.greatest(growth, F.lit(-0.999999))), "actual_rr": rr})
    run = curve(logged, ["variant"], "_g", ["start_us", "trade_id"], F.floor(F.col("start_us") / DAY_US).cast("long"))
    outcome = F.when(F.col("actual_rr") > 0.2, "win").when(F.col("actual_rr") < -0.2, "loss").otherwise("breakeven")
    return run.withColumns(
        {
            "variant_outcome": outcome,
            "equity": account * F.exp("equity"),
            "dd": 1 - F.exp(-F.col("drawdown")),
        }
    ).drop("_g", "peak", "drawdown")


def breaker_status(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Loss windows and flags after each closed trade, in exit order.

    Rows are shuffled and sorted once, in hours.  Day and week sums and the
    all-time curve begin an hour from a scan over the totals of the hours.
    The hour is one struct with the keys, so that a null key is a group too.
    """
    hour, pnl = F.date_trunc("hour", "exit_time").alias("_hour"), F.coalesce("pnl_pct", F.lit(0.0))
    rows = trades.filter("exit_time is not null").select(F.struct(*keys, hour).alias("_k"), "trade_id", "exit_time", pnl.alias("_x"))
    inside = Window.partitionBy("_k").orderBy("exit_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_s", F.sum("_x").over(inside)).withColumn("_m", F.max("_s").over(inside))
    hours = local.groupBy("_k").agg(F.sum("_x").alias("_t"), F.max("_m").alias("_h")).select("_k", "_k.*", "_t", "_h")

    def before(*group: Column) -> WindowSpec:
        return Window.partitionBy(*keys, *group).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)

    sums = {"_day": [F.to_date("_hour")], "_week": [F.date_trunc("week", "_hour")], "_all": []}
    based = hours.withColumns({n: F.coalesce(F.sum("_t").over(before(*g)), F.lit(0.0)) for n, g in sums.items()})
    based = based.withColumn("_peak", F.max(F.col("_all") + F.col("_h")).over(before())).select("_k", *sums, "_peak")
    rows = local.join(based, "_k").select(
        "_k.*", "trade_id", "exit_time", (F.col("_day") + F.col("_s")).alias("daily"), (F.col("_week") + F.col("_s")).alias("weekly"),
        (F.greatest(F.lit(0.0), "_peak", F.col("_all") + F.col("_m")) - (F.col("_all") + F.col("_s"))).alias("drawdown"),
    )
    budget = F.least(
        *[F.greatest(F.lit(limit) - F.abs(F.least(c, F.lit(0.0))), F.lit(0.0))
          for limit, c in ((DAILY_LIMIT, F.col("daily")), (WEEKLY_LIMIT, F.col("weekly")), (ALLTIME_LIMIT, -F.col("drawdown")))]
    )
    return rows.select(
        *keys, "trade_id", "exit_time", "daily", "weekly", (-F.col("drawdown")).alias("alltime_dd"),
        (F.col("daily") <= -DAILY_LIMIT).alias("day_pause"), (F.col("weekly") <= -WEEKLY_LIMIT).alias("half_size"),
        (F.col("drawdown") >= ALLTIME_LIMIT).alias("stopped"), budget.alias("risk_budget"),
    )


def breaker_windows(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over the last 24 hours and 7 days at each closed trade, with the end of the pause they cause.

    A row goes to the time chunk it lies in and, as history, to the next one, so
    a window needs one chunk only.
    """
    us = F.unix_micros("exit_time")
    out = trades.filter("exit_time is not null").select(*keys, "trade_id", "exit_time", "pnl_pct", us.alias("_us"))
    for name, span in (("rolling_day", DAY_US), ("rolling_week", 7 * DAY_US)):
        own = F.floor(F.col("_us") / span).cast("long")
        spread = out.withColumn("_own", own).withColumn("_chunk", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
        window = Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(-span, 0)
        out = spread.withColumn(name, F.sum("pnl_pct").over(window)).filter("_chunk = _own").drop("_own", "_chunk")
    pause = F.when(F.round("rolling_day", 9) <= -DAILY_LIMIT, F.timestamp_micros(F.col("_us") + DAY_US))
    return out.select(*keys, "trade_id", "exit_time", "rolling_day", "rolling_week", pause.alias("paused_until"), (F.round("rolling_week", 9) <= -WEEKLY_LIMIT).alias("half_size"))


def pause_run(trades: DataFrame, keys: list[str], daily: float, weekly: float, alltime: float) -> DataFrame:
    """Trades taken when a day, a week or everything stops after its loss limit.

    A limit only takes away the rest of its day, week or history, so the three
    apply one after the other: a row stays while no earlier running sum has
    reached the limit.  Sums are exact decimals; no result counts as zero.
    Rows are shuffled once, in hours, as in ``breaker_status``.
    """
    us = F.unix_micros("ts")
    hour, zero = F.floor(us / 3_600_000_000).cast("long").alias("_hour"), F.lit(0).cast("decimal(20,9)")
    rows = trades.select(F.struct(*keys, hour).alias("_k"), "trade_id", us.alias("us"), "pnl_pct").repartition("_k")
    # Made after the shuffle: all passes read the same one.
    rows = rows.withColumn("_x", F.coalesce(F.col("pnl_pct").cast("decimal(20,9)"), zero))
    inside = Window.partitionBy("_k").orderBy("us", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    day = F.floor(F.col("_hour") / 24).cast("long")
    for group, limit in (([day], daily), ([F.floor((day + 3) / 7)], weekly), ([], alltime)):
        before = Window.partitionBy(*keys, *group).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
        local = rows.withColumn("_s", F.sum("_x").over(inside) - F.col("_x")).withColumn("_m", F.min("_s").over(inside))
        hours = local.groupBy("_k").agg(F.sum("_x").alias("_t"), F.min("_m").alias("_l")).select("_k", "_k.*", "_t", "_l")
        based = hours.withColumn("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).cast("decimal(30,9)"))
        based = based.withColumn("_low", F.min(F.col("_b") + F.col("_l")).over(before)).select("_k", "_b", "_low")
        kept = F.least("_low", F.col("_b") + F.col("_m")) > F.lit(limit).cast("decimal(20,9)")
        rows = local.join(based, "_k").filter(kept).select("_k", "trade_id", "us", "pnl_pct", "_x")
    return rows.select(*[F.col("_k")[k].alias(k) for k in keys], "trade_id", "us", "pnl_pct")


def confidence_risk(confidence: Column, threshold: float, low: float, high: float) -> Column:
    share = F.least(F.greatest((confidence - threshold) / max(1 - threshold, 0.01), F.lit(0.0)), F.lit(1.0))
    return low + (high - low) * share


def reject_streaks(decisions: DataFrame, keys: list[str], order: str, block: Column) -> DataFrame:
    """How many runs of consecutive rejections of each length there are per key."""
    marked = running(decisions, keys, {"_run": ("sum", F.col("accepted").cast("int"))}, order, block)
    runs = marked.filter(~F.col("accepted")).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("streaks"))


def allocate(
    ranked: DataFrame, cycle: str, max_positions: int = 5, max_per_class: int = 2, max_heat: float = 0.06,
    base_risk: float = 0.005, top_risk: float = 0.015, max_ranked: int = 10,
) -> DataFrame:
    """Decision and reason per opportunity of a scan cycle, best first.

    The ordered walk per cycle is over its first ``max_ranked`` opportunities;
    the others are refused as ``rank``.
    """
    rows = ranked.filter(F.col("rank") <= max_ranked)
    fields = [f for f in rows.schema.fields if f.name in (cycle, "symbol", "asset_class", "rank", "score", "conflict", "held")]
    schema = T.StructType([*fields, T.StructField("risk_pct", T.DoubleType()), T.StructField("reason", T.StringType())])
    names = [f.name for f in fields]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, heat, per_class, risks, reasons = 0, 0.0, {}, [], []
        for row in pdf.sort_values("rank").itertuples(index=False):
            left = max_heat - heat
            risk = min(base_risk + (top_risk - base_risk) * min(row.score, 1.0), left)
            if row.held:
                reason = "held"
            elif taken >= max_positions:
                reason = "max_positions"
            elif per_class.get(row.asset_class, 0) >= max_per_class:
                reason = "max_class"
            elif left <= 0.001:
                reason = "heat"
            elif row.conflict:
                reason = "correlation"
            elif risk < 0.001:
                reason = "risk_too_small"
            else:
                reason = "approved"
                taken, heat = taken + 1, heat + risk
                per_class[row.asset_class] = per_class.get(row.asset_class, 0) + 1
            risks.append(risk if reason == "approved" else None)
            reasons.append(reason)
        out = pdf.sort_values("rank")[names].copy()
        out["risk_pct"], out["reason"] = risks, reasons
        return out

    rest = ranked.filter(F.col("rank") > max_ranked).select(*names, F.lit(None).cast("double").alias("risk_pct"), F.lit("rank").alias("reason"))
    return rows.select(*names).groupBy(cycle).applyInPandas(walk, schema).unionByName(rest)
