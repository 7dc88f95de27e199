"""Trade-journal reports and trade-run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.operators.blocks import curve, running

INITIAL_EQUITY = 100_000.0


def closed(trades: DataFrame) -> DataFrame:
    return trades.filter("exit_time is not null")


def day_number(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / 86400).cast("long")


def daily_pnl(trades: DataFrame) -> DataFrame:
    """Net result and number of trades per exit day."""
    return (
        trades.filter("exit_time is not null and pnl_pct is not null")
        .groupBy(F.to_date("exit_time").alias("day"))
        .agg((F.sum("pnl_pct") * INITIAL_EQUITY).alias("pnl"), F.count(F.lit(1)).alias("trades"))
    )


def profit_factor(gains: Column, losses: Column, cap: float) -> Column:
    return F.when(losses > 0, gains / losses).when(gains > 0, cap).otherwise(0.0)


def overview(trades: DataFrame) -> DataFrame:
    """Totals, win rate, profit factor (999 without losses), per-trade Sharpe."""
    x = F.col("pnl_pct")
    gains, losses = F.sum(F.when(x > 0, x).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)))
    deviation = F.stddev_samp(x)
    return closed(trades).filter("pnl_pct is not null").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(F.col("outcome") == "win").alias("wins"),
        F.sum(x).alias("total_pnl_pct"),
        profit_factor(gains, losses, 999.0).alias("profit_factor"),
        F.coalesce(F.when(deviation > 0, F.avg(x) / deviation * F.sqrt(F.lit(252.0))), F.lit(0.0)).alias("sharpe"),
    )


def class_rollup(trades: DataFrame) -> DataFrame:
    """Per asset class: counts, result, open risk and drawdown of its account.

    A trade whose stop lies at break-even carries no open risk.
    """
    is_open = F.col("exit_time").isNull()
    pnl = F.coalesce(F.sum(F.col("pnl_pct") * INITIAL_EQUITY), F.lit(0.0))
    base = trades.groupBy("asset_class").agg(
        F.count_if(~is_open).alias("trades"),
        F.count_if(F.col("outcome") == "win").alias("wins"),
        pnl.alias("pnl"),
        F.count_if(is_open).alias("active"),
        F.coalesce(F.sum(F.when(is_open & ~F.coalesce(F.col("be_triggered"), F.lit(False)), F.col("risk_pct"))) * 100, F.lit(0.0)).alias("heat_pct"),
    )
    return base.withColumn("equity", INITIAL_EQUITY + F.col("pnl")).withColumns(
        {
            "win_rate": F.when(F.col("trades") > 0, F.col("wins") / F.col("trades") * 100).otherwise(0.0),
            "dd_pct": F.greatest(F.lit(0.0), -F.col("pnl") / INITIAL_EQUITY * 100),
        }
    )


def account_totals(rollup: DataFrame) -> DataFrame:
    """Second-level totals over the class accounts."""
    return rollup.agg(
        F.sum("trades").alias("trades"),
        F.sum("wins").alias("wins"),
        F.sum("equity").alias("equity"),
        F.max("dd_pct").alias("worst_dd_pct"),
        F.sum("active").alias("active"),
    )


def period_stats(trades: DataFrame, as_of: str, periods: dict[str, int]) -> DataFrame:
    """Result and worst running drawdown of the last days before ``as_of``.

    A trade belongs to every period it falls in (at most ``len(periods)``
    copies); drawdowns run per period in exit order.
    """
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("exit_time"))
    spans = F.array(*[F.when((age >= 0) & (age <= days), F.lit(name)) for name, days in periods.items()])
    rows = closed(trades).select(
        F.explode(F.array_compact(spans)).alias("period"), "exit_time", "trade_id", "asset_class",
        F.coalesce("pnl_pct", F.lit(0.0)).alias("pnl_pct"),
    )
    run = curve(rows, ["period"], "pnl_pct", ["exit_time", "trade_id"], day_number("exit_time"))
    return run.groupBy("period").agg(
        (F.sum("pnl_pct") * 100).alias("pnl_pct"),
        (F.max("drawdown") * 100).alias("dd_pct"),
        F.count(F.lit(1)).alias("trades"),
        *[
            (F.sum(F.when(F.col("asset_class") == c, F.col("pnl_pct")).otherwise(0.0)) * 100).alias(f"pnl_{c}")
            for c in ("crypto", "forex", "stocks", "commodities")
        ],
    )


def equity_curve(trades: DataFrame, keys: list[str] | None = None, value: str = "pnl", account: float = INITIAL_EQUITY,
                 floor_at_start: bool = False) -> DataFrame:
    """Equity after each closed trade in exit order, with peak and drawdown share."""
    rows = closed(trades).withColumn("_all", F.lit(1))
    run = curve(rows, keys or ["_all"], value, ["exit_time", "trade_id"], day_number("exit_time"), account, floor_at_start)
    return run.withColumn("drawdown", -F.col("drawdown") / F.col("peak")).drop("_all")


def daily_returns(trades: DataFrame, keys: list[str], account: float = INITIAL_EQUITY) -> DataFrame:
    """Equity per calendar day (carried over days without trades) and its change.

    Trades are summed per day first, so everything ordered works on days.
    """
    daily = closed(trades).groupBy(*keys, F.to_date("exit_time").alias("day")).agg(F.sum("pnl").alias("pnl"))
    spans = daily.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    spine = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    days = spine.join(daily, [*keys, "day"], "left")
    w = Window.partitionBy(*keys).orderBy("day")
    total = F.sum(F.coalesce("pnl", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    curve_ = days.withColumn("equity", account + total)
    before = F.lag("equity").over(w)
    return curve_.withColumn("daily_return", F.col("equity") / before - 1).select(*keys, "day", "equity", "daily_return")


def return_moments(returns: DataFrame, keys: list[str], periods_per_year: int = 365) -> DataFrame:
    """Observations, annualised Sharpe, bias-corrected skewness and (normal = 3) kurtosis."""
    x = F.col("daily_return")
    stats = returns.filter(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("_mean"),
        F.stddev_samp(x).alias("_std"),
        F.skewness(x).alias("_skew"),
        F.kurtosis(x).alias("_kurt"),
    )
    n = F.col("n").cast("double")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.col("_skew")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_kurt") + 6) + 3
    few = F.col("n") < 4
    return stats.select(
        *keys,
        "n",
        F.when((F.col("n") >= 2) & (F.col("_std") > 0), F.col("_mean") / F.col("_std") * F.sqrt(F.lit(float(periods_per_year))))
        .otherwise(0.0)
        .alias("sharpe"),
        F.when(few | ~(F.col("_std") > 0), 0.0).otherwise(skew).alias("skew"),
        F.when(few | ~(F.col("_std") > 0), 3.0).otherwise(kurt).alias("kurt_nonexcess"),
    )


def run_metrics(trades: DataFrame, keys: list[str], account: float = INITIAL_EQUITY) -> DataFrame:
    """Metrics of trade runs: factors, rates, drawdown, recovery, expectancy.

    Input ``keys, exit_time, trade_id, pnl, outcome, rr_actual``.  One curve
    pass for the drawdown, one grouped aggregation for everything.
    """
    run = equity_curve(trades, keys, account=account)
    pnl, win, loss = F.col("pnl"), F.col("outcome") == "win", F.col("outcome") == "loss"
    total = lambda c: F.coalesce(F.sum(F.when(c, pnl)), F.lit(0.0))
    base = run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.sum(pnl).alias("total_pnl"),
        total(pnl > 0).alias("_gp"),
        F.abs(F.sum(F.when(pnl <= 0, pnl))).alias("_gl"),
        F.count_if(pnl > 0).alias("_nw"),
        F.count_if(win).alias("n_wins"),
        F.count_if(loss).alias("n_losses"),
        F.count_if(F.col("outcome") == "breakeven").alias("n_breakeven"),
        total(win).alias("_wp"),
        F.abs(total(loss)).alias("_lp"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("rr_actual").alias("avg_rr"),
    )
    n, decided = F.col("total_trades"), F.col("n_wins") + F.col("n_losses")
    gross_loss = F.coalesce("_gl", F.lit(1e-9))
    win_rate = F.when(decided > 0, F.col("n_wins") / decided).otherwise(0.0)
    avg_win = F.when(F.col("n_wins") > 0, F.col("_wp") / F.col("n_wins")).otherwise(0.0)
    avg_loss = F.when(F.col("n_losses") > 0, F.col("_lp") / F.col("n_losses")).otherwise(0.0)
    dd_usd = F.when(F.col("max_drawdown") != 0, F.abs(F.col("max_drawdown") * account)).otherwise(1e-9)
    return base.select(
        *keys, "total_trades", "total_pnl", "n_wins", "n_losses", "n_breakeven", "max_drawdown", "avg_rr",
        F.when(gross_loss > 0, F.col("_gp") / gross_loss).otherwise(F.col("_gp")).alias("profit_factor"),
        profit_factor(F.col("_wp"), F.col("_lp"), 100.0).alias("pf_real"),
        (F.col("_nw") / n).alias("winrate"),
        win_rate.alias("winrate_real"),
        (F.col("n_breakeven") / n).alias("be_rate"),
        (F.col("total_pnl") / dd_usd).alias("recovery_factor"),
        (win_rate * avg_win - (1 - win_rate) * avg_loss).alias("expectancy"),
    )


def replay_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Replay summary with population deviation, per-trade Sharpe and the deepest fall of the running result in exit order."""
    x = F.col("pnl_pct")
    gains, losses = F.sum(F.when(x > 0, x).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)))
    dev = F.stddev_pop(x)
    run = curve(closed(trades), keys, "pnl_pct", ["exit_time", "trade_id"], day_number("exit_time"))
    return run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.count_if(F.col("outcome") == "win") / F.count(F.lit(1))).alias("win_rate"),
        F.avg("rr_actual").alias("avg_rr"),
        profit_factor(gains, losses, 999.0).alias("profit_factor"),
        F.when(dev > 0, F.avg(x) / dev).otherwise(0.0).alias("sharpe"),
        F.max("drawdown").alias("max_drawdown"),
    )


def since_deploy(trades: DataFrame, deployed: str, min_trades: int = 30, max_loss: float = -0.05) -> DataFrame:
    """Result of trades closed after a deploy time and whether to roll back."""
    rows = closed(trades).filter(F.col("exit_time") > F.lit(deployed).cast("timestamp"))
    agg = rows.agg(
        F.count(F.lit(1)).alias("trades"),
        F.coalesce(F.sum("pnl_pct"), F.lit(0.0)).alias("cum_pnl"),
        F.coalesce(F.avg((F.col("outcome") == "win").cast("double")), F.lit(0.0)).alias("win_rate"),
    )
    return agg.withColumn(
        "rollback", (F.col("trades") >= min_trades) & (F.col("cum_pnl") < max_loss)
    )


def latest(trades: DataFrame, columns: list[str], n: int = 100, offset: int = 0, asset_class: str | None = None) -> DataFrame:
    """Page of closed trades, newest first; absent columns are left out."""
    rows = closed(trades)
    if asset_class is not None:
        rows = rows.filter(F.col("asset_class") == asset_class)
    present = [c for c in columns if c in trades.columns]
    return rows.orderBy(F.desc("exit_time"), F.desc("trade_id")).select(*present).offset(offset).limit(n)


def episode_rows(trade_bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Bars of closed trades with trade metadata and the hold-better label."""
    kept = trade_bars.join(closed(trades).select("trade_id"), "trade_id", "left_semi")
    meta = trades.select("trade_id", "symbol", "asset_class", "outcome", "rr_actual", "risk_pct")
    unrealized = F.col("unrealized_pnl_pct") / F.greatest(F.col("risk_pct"), F.lit(1e-6))
    return kept.join(meta, "trade_id", "left").withColumn("bar_unrealized_rr", unrealized).withColumn(
        "label_hold_better",
        (F.coalesce("rr_actual", F.lit(0.0)) - F.col("bar_unrealized_rr") > 0).cast("int"),
    )


def with_running_extremes(bars: DataFrame, keys: list[str], size: int = 4096) -> DataFrame:
    """Running best favourable and worst adverse move over the bars of a trade."""
    return running(
        bars, keys,
        {"mfe": ("max", F.col("favorable")), "mae": ("max", F.col("adverse"))}, "bar_index", size=size,
    )
