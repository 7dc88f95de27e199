"""Trade-journal reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import TRADES, with_
from tapeline.catalog.registry import R, query, r
from tapeline.functions import scores
from tapeline.operators import journal as J
from tapeline.session import materialize
from tapeline.sources import tables as T

TR = with_(TRADES)
AS_OF = "2000-06-30"
EQUITY_SQL = """run AS (
  SELECT *, 100000 + sum(pnl) OVER w AS equity FROM trades WHERE exit_time IS NOT NULL
  WINDOW w AS (ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
eq AS (SELECT *, max(equity) OVER (ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS peak FROM run)"""


@query(
    "journal_daily_pnl",
    TR + f"""SELECT exit_time::DATE AS day, {R('sum(pnl_pct) * 100000', 2)} AS pnl, count(*) AS trades FROM trades
    WHERE exit_time IS NOT NULL AND pnl_pct IS NOT NULL GROUP BY 1""",
)
def journal_daily_pnl(spark, sf):
    return J.daily_pnl(T.trades(spark, sf)).select("day", r("pnl", 2).alias("pnl"), "trades")


@query(
    "journal_overview",
    TR + f"""SELECT count(*) AS trades, count(*) FILTER (outcome = 'win') AS wins, {R('sum(pnl_pct)')} AS total_pnl_pct,
    {R('sum(pnl_pct) FILTER (pnl_pct > 0) / abs(sum(pnl_pct) FILTER (pnl_pct < 0))')} AS profit_factor,
    {R('avg(pnl_pct) / stddev_samp(pnl_pct) * sqrt(252)')} AS sharpe FROM trades WHERE exit_time IS NOT NULL""",
)
def journal_overview(spark, sf):
    out = J.overview(T.trades(spark, sf))
    return out.select("trades", "wins", *[r(c).alias(c) for c in ("total_pnl_pct", "profit_factor", "sharpe")])


ROLLUP = f"""SELECT asset_class, count(*) FILTER (exit_time IS NOT NULL) AS trades,
    count(*) FILTER (outcome = 'win') AS wins, {R('coalesce(sum(pnl_pct * 100000), 0)', 3)} AS pnl,
    count(*) FILTER (exit_time IS NULL) AS active,
    {R('coalesce(sum(risk_pct) FILTER (exit_time IS NULL AND NOT be_triggered) * 100, 0)', 4)} AS heat_pct,
    {R('100000 + coalesce(sum(pnl_pct * 100000), 0)', 3)} AS equity,
    {R('100.0 * count(*) FILTER (outcome = $$win$$) / count(*) FILTER (exit_time IS NOT NULL)')} AS win_rate,
    {R('greatest(0, -sum(pnl_pct * 100000) / 100000 * 100)', 4)} AS dd_pct FROM trades GROUP BY asset_class"""


@query("journal_class_rollup", TR + ROLLUP)
def journal_class_rollup(spark, sf):
    out = J.class_rollup(T.trades(spark, sf))
    digits = {"pnl": 3, "heat_pct": 4, "equity": 3, "win_rate": 6, "dd_pct": 4}
    return out.select("asset_class", "trades", "wins", "active", *[r(c, d).alias(c) for c, d in digits.items()])


@query(
    "journal_account_totals",
    TR + f"""SELECT sum(trades)::BIGINT AS trades, sum(wins)::BIGINT AS wins, {R('sum(equity)', 2)} AS equity,
    {R('max(dd_pct)', 4)} AS worst_dd_pct, sum(active)::BIGINT AS active FROM ({ROLLUP})""",
)
def journal_account_totals(spark, sf):
    out = J.account_totals(J.class_rollup(T.trades(spark, sf)))
    return out.select("trades", "wins", "active", r("equity", 2).alias("equity"), r("worst_dd_pct", 4).alias("worst_dd_pct"))


_PERIODS = {"day": 0, "week": 7, "month": 30, "year": 365}


@query(
    "journal_period_stats",
    TR + ", spans(period, days) AS (VALUES ('day', 0), ('week', 7), ('month', 30), ('year', 365)), x AS ("
    f"""SELECT period, asset_class, pnl_pct, exit_time, trade_id,
      sum(pnl_pct) OVER (PARTITION BY period ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS run
      FROM trades JOIN spans ON date_diff('day', exit_time::DATE, DATE '{AS_OF}') BETWEEN 0 AND days
      WHERE exit_time IS NOT NULL), y AS (
      SELECT *, greatest(0, max(run) OVER (PARTITION BY period ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) - run AS dd
      FROM x)
    SELECT period, {R('sum(pnl_pct) * 100')} AS pnl_pct, {R('max(dd) * 100')} AS dd_pct, count(*) AS trades, """
    + ", ".join(
        R(f"coalesce(sum(pnl_pct) FILTER (asset_class = '{c}'), 0) * 100") + f" AS pnl_{c}" for c in T.ASSET_CLASSES
    )
    + " FROM y GROUP BY period",
)
def journal_period_stats(spark, sf):
    out = J.period_stats(T.trades(spark, sf), AS_OF, _PERIODS)
    return out.select("period", "trades", *[r(c).alias(c) for c in out.columns if c not in ("period", "trades")])


def _pnl(spark, sf):
    """Closed trades with the columns a curve needs, stored."""
    t = J.closed(T.trades(spark, sf))
    return materialize(t.select("trade_id", "asset_class", "exit_time", "pnl", "outcome", "rr_actual"))


@query(
    "journal_equity_curve",
    with_(TRADES, EQUITY_SQL)
    + f"""SELECT trade_id, exit_time, {R('equity', 4)} AS equity, {R('peak', 4)} AS peak,
    {R('(equity - peak) / peak')} AS drawdown FROM eq""",
)
def journal_equity_curve(spark, sf):
    out = J.equity_curve(_pnl(spark, sf))
    return out.select("trade_id", "exit_time", r("equity", 4).alias("equity"), r("peak", 4).alias("peak"),
                      r("drawdown").alias("drawdown"))


@query(
    "journal_equity_tail",
    with_(TRADES, EQUITY_SQL)
    + f"SELECT trade_id, exit_time, {R('equity', 4)} AS equity FROM eq ORDER BY exit_time DESC, trade_id DESC LIMIT 500",
)
def journal_equity_tail(spark, sf):
    out = J.equity_curve(_pnl(spark, sf))
    last = out.orderBy(F.desc("exit_time"), F.desc("trade_id")).limit(500)
    return last.select("trade_id", "exit_time", r("equity", 4).alias("equity")).orderBy("exit_time", "trade_id")


_COLS = ["trade_id", "symbol", "asset_class", "direction", "entry_time", "exit_time", "entry_price", "exit_price",
         "pnl_pct", "rr_target", "outcome", "exit_reason", "bars_held", "score"]
_HAVE = [c for c in _COLS if c not in ("exit_price", "exit_reason")]


@query(
    "journal_latest_trades",
    TR + f"SELECT {', '.join(_HAVE)} FROM trades WHERE exit_time IS NOT NULL ORDER BY exit_time DESC, trade_id DESC LIMIT 100",
)
def journal_latest_trades(spark, sf):
    return J.latest(T.trades(spark, sf), _COLS)


@query(
    "journal_history_page",
    TR + f"""SELECT {', '.join(_HAVE)} FROM trades WHERE exit_time IS NOT NULL AND asset_class = 'crypto'
    ORDER BY exit_time DESC, trade_id DESC LIMIT 50 OFFSET 100""",
)
def journal_history_page(spark, sf):
    return J.latest(T.trades(spark, sf), _COLS, 50, 100, "crypto")


@query(
    "journal_conditional_counts",
    TR + f"""SELECT count(*) AS trades, count(*) FILTER (exit_time IS NULL) AS open_trades,
    count(*) FILTER (outcome = 'win') AS wins, {R('avg(rr_actual)')} AS mean_rr, {R('sum(pnl)', 4)} AS total_pnl,
    count(DISTINCT symbol) AS symbols FROM trades""",
)
def journal_conditional_counts(spark, sf):
    t = T.trades(spark, sf)
    return t.agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("exit_time").isNull()).alias("open_trades"),
        F.count_if(F.col("outcome") == "win").alias("wins"), r(F.avg("rr_actual")).alias("mean_rr"),
        r(F.sum("pnl"), 4).alias("total_pnl"), F.countDistinct("symbol").alias("symbols"),
    )


@query(
    "journal_top_symbols",
    TR + f"""SELECT symbol, count(*) AS entries, count(*) FILTER (outcome = 'win') AS wins, {R('avg(rr_actual)')} AS mean_rr
    FROM trades WHERE exit_time IS NOT NULL GROUP BY symbol ORDER BY entries DESC, symbol LIMIT 10""",
)
def journal_top_symbols(spark, sf):
    g = J.closed(T.trades(spark, sf)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("outcome") == "win").alias("wins"),
        r(F.avg("rr_actual")).alias("mean_rr"),
    )
    return g.orderBy(F.desc("entries"), "symbol").limit(10)


DAILY_SQL = """daily AS (SELECT asset_class, exit_time::DATE AS day, sum(pnl) AS pnl FROM trades WHERE exit_time IS NOT NULL GROUP BY ALL),
spine AS (SELECT asset_class, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day
  FROM daily GROUP BY asset_class),
eqd AS (SELECT asset_class, day, 100000 + sum(coalesce(pnl, 0)) OVER (PARTITION BY asset_class ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity
  FROM spine LEFT JOIN daily USING (asset_class, day)),
rets AS (SELECT *, equity / lag(equity) OVER (PARTITION BY asset_class ORDER BY day) - 1 AS daily_return FROM eqd)"""


@query(
    "journal_daily_returns",
    with_(TRADES, DAILY_SQL)
    + f"SELECT asset_class, day, {R('equity', 4)} AS equity, {R('daily_return')} AS daily_return FROM rets",
)
def journal_daily_returns(spark, sf):
    out = J.daily_returns(T.trades(spark, sf), ["asset_class"])
    return out.select("asset_class", "day", r("equity", 4).alias("equity"), r("daily_return").alias("daily_return"))


@query(
    "journal_return_moments",
    with_(TRADES, DAILY_SQL)
    + f"""SELECT asset_class, count(daily_return) AS n,
    {R('avg(daily_return) / stddev_samp(daily_return) * sqrt(365)')} AS sharpe,
    {R('skewness(daily_return)', 4)} AS skew, {R('kurtosis(daily_return) + 3', 4)} AS kurt_nonexcess
    FROM rets WHERE daily_return IS NOT NULL GROUP BY asset_class""",
)
def journal_return_moments(spark, sf):
    m = J.return_moments(J.daily_returns(T.trades(spark, sf), ["asset_class"]), ["asset_class"])
    return m.select("asset_class", "n", r("sharpe").alias("sharpe"), r("skew", 4).alias("skew"),
                    r("kurt_nonexcess", 4).alias("kurt_nonexcess"))


_RUN = """run AS (SELECT *, 100000 + sum(pnl) OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)
    AS equity FROM trades WHERE exit_time IS NOT NULL),
eq AS (SELECT *, max(equity) OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS peak FROM run),
m AS (SELECT asset_class, count(*) AS total_trades, sum(pnl) AS total_pnl, count(*) FILTER (outcome = 'win') AS n_wins,
    count(*) FILTER (outcome = 'loss') AS n_losses, count(*) FILTER (outcome = 'breakeven') AS n_breakeven,
    min((equity - peak) / peak) AS max_drawdown, avg(rr_actual) AS avg_rr,
    sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl <= 0)) AS profit_factor,
    sum(pnl) FILTER (outcome = 'win') / abs(sum(pnl) FILTER (outcome = 'loss')) AS pf_real,
    count(*) FILTER (pnl > 0) / count(*) AS winrate, avg(pnl) FILTER (outcome = 'win') AS aw, abs(avg(pnl) FILTER (outcome = 'loss')) AS al
  FROM eq GROUP BY asset_class)"""
_M = {"total_pnl": 4, "max_drawdown": 6, "avg_rr": 6, "profit_factor": 6, "pf_real": 6, "winrate": 6, "winrate_real": 6,
      "be_rate": 6, "recovery_factor": 4, "expectancy": 3}


@query(
    "journal_run_metrics",
    with_(TRADES, _RUN, """z AS (SELECT *, n_wins / (n_wins + n_losses) AS winrate_real, n_breakeven / total_trades AS be_rate,
    total_pnl / abs(max_drawdown * 100000) AS recovery_factor,
    n_wins / (n_wins + n_losses) * aw - (1 - n_wins / (n_wins + n_losses)) * al AS expectancy FROM m)""")
    + "SELECT asset_class, total_trades, n_wins, n_losses, n_breakeven, "
    + ", ".join(f"{R(c, d)} AS {c}" for c, d in _M.items()) + " FROM z",
)
def journal_run_metrics(spark, sf):
    m = J.run_metrics(_pnl(spark, sf), ["asset_class"])
    return m.select("asset_class", "total_trades", "n_wins", "n_losses", "n_breakeven", *[r(c, d).alias(c) for c, d in _M.items()])


@query(
    "journal_replay_metrics",
    with_(TRADES, "run AS (SELECT asset_class, exit_time, trade_id, sum(pnl_pct) OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS total FROM trades WHERE exit_time IS NOT NULL)",
          "fall AS (SELECT asset_class, max(peak - total) AS dd FROM (SELECT *, greatest(max(total) OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM run) GROUP BY asset_class)")
    + f"""SELECT asset_class, count(*) AS trades, {R('count(*) FILTER (outcome = $$win$$) / count(*)')} AS win_rate,
    {R('avg(rr_actual)')} AS avg_rr, {R('sum(pnl_pct) FILTER (pnl_pct > 0) / abs(sum(pnl_pct) FILTER (pnl_pct < 0))')} AS profit_factor,
    {R('avg(pnl_pct) / stddev_pop(pnl_pct)')} AS sharpe, {R('max(dd)', 4)} AS max_drawdown FROM trades JOIN fall USING (asset_class) WHERE exit_time IS NOT NULL GROUP BY asset_class""",
)
def journal_replay_metrics(spark, sf):
    m = J.replay_metrics(T.trades(spark, sf), ["asset_class"])
    return m.select("asset_class", "trades", *[r(c).alias(c) for c in ("win_rate", "avg_rr", "profit_factor", "sharpe")], r("max_drawdown", 4).alias("max_drawdown"))


@query(
    "journal_since_deploy",
    TR + f"""SELECT count(*) AS trades, {R('coalesce(sum(pnl_pct), 0)')} AS cum_pnl,
    {R('coalesce(avg((outcome = $$win$$)::INT), 0)')} AS win_rate,
    count(*) >= 30 AND round(coalesce(sum(pnl_pct), 0), 6) < -0.05 AS rollback
    FROM trades WHERE exit_time > TIMESTAMP '2000-01-01'""",
)
def journal_since_deploy(spark, sf):
    out = J.since_deploy(T.trades(spark, sf), "2000-01-01")
    return out.select("trades", r("cum_pnl").alias("cum_pnl"), r("win_rate").alias("win_rate"), "rollback")


def _order_trades(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("trade_id"), F.concat(F.lit("C"), "o_custkey").alias("symbol"),
        T.class_of(F.col("o_custkey")).alias("asset_class"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("exit_time"),
        F.when(F.col("o_orderstatus") == "F", "win").otherwise("breakeven").alias("outcome"),
        (F.col("o_totalprice") / 250000 - 1).alias("rr_actual"), F.lit(0.01).alias("risk_pct"),
    )


@query(
    "journal_episode_labels",
    f"""WITH b AS (SELECT l_orderkey AS trade_id, l_linenumber AS bar_index, l_partkey AS part, l_discount - 0.05 AS u FROM lineitem)
    SELECT b.trade_id, bar_index, part, o_custkey AS account, {R('u / 0.01')} AS bar_unrealized_rr,
    (round(o_totalprice / 250000 - 1 - u / 0.01, 9) > 0)::INT AS label_hold_better
    FROM b JOIN orders ON o_orderkey = b.trade_id WHERE o_orderstatus <> 'O'""",
)
def journal_episode_labels(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("bar_index"), F.col("l_partkey").alias("part"),
        (F.col("l_discount") - 0.05).alias("unrealized_pnl_pct"),
    )
    rows = J.episode_rows(li, _order_trades(spark, sf))
    return rows.select(
        "trade_id", "bar_index", "part", F.substring("symbol", 2, 20).cast("long").alias("account"),
        r("bar_unrealized_rr").alias("bar_unrealized_rr"), "label_hold_better",
    )


@query(
    "journal_hold_hours",
    TR + f"""SELECT asset_class, outcome, count(*) AS trades, {R('avg((epoch_us(exit_time) - epoch_us(entry_time)) / 3600000000)')} AS mean_hours, {R('max((epoch_us(exit_time) - epoch_us(entry_time)) / 3600000000)')} AS longest
    FROM trades WHERE exit_time IS NOT NULL GROUP BY ALL""",
)
def journal_hold_hours(spark, sf):
    """Hours from entry to exit by class and outcome."""
    t = T.trades(spark, sf).filter("exit_time is not null").withColumn("h", scores.hold_hours(F.col("entry_time"), F.col("exit_time")))
    return t.groupBy("asset_class", "outcome").agg(F.count(F.lit(1)).alias("trades"), r(F.avg("h")).alias("mean_hours"), r(F.max("h")).alias("longest"))
