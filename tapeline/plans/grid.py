"""Parameter grids over signals: resolve once, gate per combination, run, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import journal as J
from tapeline.operators import outcomes as O
from tapeline.operators import portfolio as P
from tapeline.session import materialize

# The value lists of the grid (8 x 6 x 3 x 3).
GRID = {
    "threshold": [0.70, 0.72, 0.75, 0.78, 0.80, 0.82, 0.85, 0.88],
    "min_rr": [2.0, 2.25, 2.5, 2.75, 3.0, 3.5],
    "risk_cap": [0.005, 0.010, 0.015],
    "ratchet_r": [1.5, 2.0, 2.5],
}


def parameter_grid(spark: SparkSession, values: dict[str, list[float]] | None = None) -> DataFrame:
    """Cross product of the value lists; one row per combination."""
    values = values or GRID
    out = spark.range(1).select()
    for name, choices in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(float(c)) for c in choices])).alias(name))
    return out.withColumn("combo_id", F.concat_ws("/", *values))


def day_windows(signals: DataFrame, days: int) -> DataFrame:
    """Consecutive test windows of ``days`` days from the first signal on."""
    first = signals.agg(F.to_date(F.min("ts")).alias("_first"))
    return first.withColumn("_days", F.lit(days))


def _windowed(signals: DataFrame, windows: DataFrame) -> DataFrame:
    number = F.floor(F.datediff(F.to_date("ts"), F.col("_first")) / F.col("_days"))
    return signals.crossJoin(F.broadcast(windows)).withColumn("window_id", number.cast("int")).drop("_first", "_days")


def resolved(signals: DataFrame, bars: DataFrame, ratchets: list[float], commission: float, slippage: float, hold: int = 48) -> DataFrame:
    """Outcomes once per break-even level, not once per combination."""
    out = None
    for level in ratchets:
        res = O.resolve(signals, bars, hold, commission, slippage, level).withColumn("ratchet_r", F.lit(float(level)))
        out = res if out is None else out.unionByName(res)
    return materialize(out)


def grid_trades(signals: DataFrame, bars: DataFrame, grid: DataFrame, windows: DataFrame, commission: float = 0.0004,
                slippage: float = 0.0001) -> DataFrame:
    """Trades taken per combination and window."""
    levels = [r[0] for r in grid.select("ratchet_r").distinct().orderBy("ratchet_r").collect()]  # a parameter table
    res = resolved(signals, bars, levels, commission, slippage)
    base = _windowed(signals, windows).join(res.select("sig_id", "ratchet_r", "outcome", "exit_price", "exit_ts"), "sig_id")
    gated = base.join(F.broadcast(grid), "ratchet_r").filter(
        (F.col("score") >= F.col("threshold")) & (F.col("risk_reward") >= F.col("min_rr"))
    )
    rows = gated.withColumns({"trade_id": F.col("sig_id"), "cost_pct": F.lit(commission * 2 + slippage * 2)})
    return P.portfolio_run(rows, ["combo_id", "window_id"])


def metrics_of(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Run metrics with daily Sharpe and moments of the return series."""
    t = trades.withColumn("rr_actual", F.col("actual_rr"))
    run = J.run_metrics(t, keys)
    moments = J.return_moments(J.daily_returns(t, keys), keys)
    return run.join(moments, keys, "left").fillna({"sharpe": 0.0, "skew": 0.0, "kurt_nonexcess": 3.0, "n": 0})


def grid_results(signals: DataFrame, bars: DataFrame, grid: DataFrame, windows: DataFrame, min_trades: int = 5,
                 max_ratio: float = 10.0) -> DataFrame:
    """Metrics per combination and window, zero from the first failing window on.

    A combination is evergreen when every window passes and its profit factors
    differ by at most ``max_ratio``.  Windows are few (parameter table), so the
    per-combination comparison is a plain grouped aggregation.
    """
    m = metrics_of(materialize(grid_trades(signals, bars, grid, windows)), ["combo_id", "window_id"])
    all_windows = _windowed(signals, windows).select("window_id").distinct()
    full = grid.crossJoin(F.broadcast(all_windows)).join(m, ["combo_id", "window_id"], "left").fillna(
        0, ["pf_real", "total_trades", "max_drawdown", "winrate_real", "sharpe"]
    )
    passes = (
        (F.col("pf_real") >= 1.5) & (F.col("total_trades") >= min_trades) & (F.col("max_drawdown") >= -0.12) & (F.col("winrate_real") <= 0.80)
    )
    full = materialize(full.withColumn("passes", passes))
    fail = full.groupBy("combo_id").agg(
        F.min(F.when(~F.col("passes"), F.col("window_id"))).alias("_fail"), F.min("pf_real").alias("_min"), F.max("pf_real").alias("_max")
    )
    j = full.join(fail, "combo_id")
    shown = F.col("_fail").isNull() | (F.col("window_id") <= F.col("_fail"))
    cut = lambda c: F.when(shown, F.col(c)).otherwise(0).alias(c)
    ever = F.col("_fail").isNull() & (F.col("_min") > 0) & (F.col("_max") / F.col("_min") <= max_ratio)
    return j.select(
        *[c for c in grid.columns], "window_id", *[cut(c) for c in ("pf_real", "total_trades", "max_drawdown", "winrate_real", "sharpe")],
        F.coalesce(ever, F.lit(False)).alias("is_evergreen"), shown.alias("evaluated"),
    )


def best_parameters(results: DataFrame, n: int = 1) -> DataFrame:
    """Evergreen combination with the best worst window (all when none is evergreen)."""
    per = results.groupBy("combo_id", "is_evergreen").agg(
        F.min("pf_real").alias("min_pf"), F.avg(F.when(F.col("evaluated"), F.col("pf_real"))).alias("mean_pf"), F.min("total_trades").alias("_t")
    )
    confidence = F.when(F.col("_t") < 10, "low").when(F.col("_t") < 20, "medium").otherwise("high")
    return per.withColumn("confidence", confidence).drop("_t").orderBy(
        F.desc("is_evergreen"), F.desc("min_pf"), F.desc("mean_pf"), "combo_id"
    ).limit(n)


def cost_stress(signals: DataFrame, bars: DataFrame, costs: dict[str, tuple[float, float]], risk_cap: float = 0.01,
                least_pf: float = 1.2, least_sharpe: float = 0.5, max_dd: float = -0.10) -> DataFrame:
    """The same signals run at several cost levels."""
    out = None
    for name, (commission, slippage) in costs.items():
        res = O.resolve(signals, bars, 48, commission, slippage).select("sig_id", "outcome", "exit_price", "exit_ts")
        rows = signals.join(res, "sig_id").withColumns(
            {"trade_id": F.col("sig_id"), "cost_pct": F.lit(commission * 2 + slippage * 2), "risk_cap": F.lit(risk_cap), "scenario": F.lit(name)}
        )
        out = rows if out is None else out.unionByName(rows)
    trades = materialize(P.portfolio_run(out, ["scenario"]))
    t = trades.withColumn("rr_actual", F.col("actual_rr"))
    pnl = F.col("pnl")
    curve = J.equity_curve(t, ["scenario"], floor_at_start=True)
    base = curve.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum(F.when(pnl > 0, pnl)).alias("_w"), F.abs(F.sum(F.when(pnl < 0, pnl))).alias("_l"),
        F.min("drawdown").alias("max_drawdown"),
    )
    moments = J.return_moments(J.daily_returns(t, ["scenario"]), ["scenario"]).select("scenario", "sharpe")
    j = base.join(moments, "scenario", "left").withColumn("pf_real", F.coalesce(F.col("_w") / F.col("_l"), F.when(F.col("_w") > 0, 10.0).otherwise(0.0)))
    gate = (F.col("pf_real") >= least_pf) & (F.col("sharpe") >= least_sharpe) & (F.col("max_drawdown") >= max_dd)
    return j.withColumn("gate_pass", F.coalesce(gate, F.lit(False))).drop("_w", "_l")
