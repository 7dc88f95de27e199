"""Portfolio runs, grids, breakers, ranking and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import TRADES, with_
from tapeline.catalog.outcome_queries import BASE, H, RESOLUTION, path_cte, signals
from tapeline.catalog.registry import R, query, r
from tapeline.functions import scores
from tapeline.operators import outcomes as O
from tapeline.operators import portfolio as P
from tapeline.operators import ranking as K
from tapeline.plans import grid as G
from tapeline.session import materialize
from tapeline.sources import tables as T

TR = with_(TRADES)


def graded_signals(spark, sf):
    """Break signals with a score from 0.70 and a target of 2 to 3.5 R."""
    sig, bars = signals(spark, sf)
    rr = 2 + (F.col("bar_idx") % 7) * 0.25
    out = sig.withColumns({"score": 0.70 + (F.col("bar_idx") * 37 % 30) / 100, "risk_reward": rr}).withColumn(
        "target", F.col("entry") + F.col("direction") * F.col("risk_reward") * F.abs(F.col("entry") - F.col("stop"))
    )
    return materialize(out), bars


@query("portfolio_grid_runs")
def portfolio_grid_runs(spark, sf):
    sig, bars = graded_signals(spark, sf)
    runs = G.grid_trades(sig, bars, G.parameter_grid(spark), G.day_windows(sig, 10))
    return runs.groupBy("combo_id", "window_id").agg(F.count(F.lit(1)).alias("trades"), r(F.sum("pnl"), 2).alias("pnl"))


@query("portfolio_grid_results")
def portfolio_grid_results(spark, sf):
    sig, bars = graded_signals(spark, sf)
    res = G.grid_results(sig, bars, G.parameter_grid(spark), G.day_windows(sig, 10), min_trades=3)
    return res.select("combo_id", "window_id", *[r(c).alias(c) for c in ("pf_real", "sharpe", "max_drawdown")], "total_trades", "is_evergreen")


@query("portfolio_best_parameters")
def portfolio_best_parameters(spark, sf):
    sig, bars = graded_signals(spark, sf)
    res = G.grid_results(sig, bars, G.parameter_grid(spark), G.day_windows(sig, 10), min_trades=3)
    return G.best_parameters(res)


@query("portfolio_cost_stress")
def portfolio_cost_stress(spark, sf):
    sig, bars = graded_signals(spark, sf)
    out = G.cost_stress(sig, bars, {"normal": (0.0004, 0.0002), "stressed": (0.0008, 0.0006)})
    return out.select("scenario", "n_trades", *[r(c).alias(c) for c in ("pf_real", "max_drawdown", "sharpe")], "gate_pass")


GRADED = """graded AS (SELECT * REPLACE (entry + direction * (2 + (bar_idx % 7) * 0.25::DOUBLE) * abs(entry - stop) AS target), 2 + (bar_idx % 7) * 0.25::DOUBLE AS risk_reward,
  0.70::DOUBLE + (bar_idx * 37 % 30) / 100.0::DOUBLE AS score FROM sig)"""


@query(
    "portfolio_variant_book",
    "WITH RECURSIVE " + ",\n".join([
        *BASE, GRADED, path_cte(1, H, "path", "graded"), RESOLUTION,
        "res AS (SELECT sig_id, coalesce(px, lc) AS exit_price, coalesce(xts, lts) AS exit_ts FROM d)",
        "vs(variant, threshold, min_rr, risk, leverage) AS (VALUES ('tight', 0.85::DOUBLE, 2.5::DOUBLE, 0.01::DOUBLE, 5), ('wide', 0.72::DOUBLE, 2.0::DOUBLE, 0.02::DOUBLE, 10))",
        """cand AS (SELECT variant, s.sig_id, s.ts, exit_ts, least(least(risk_, 0.03) / (abs(entry - stop) / entry), leverage) * ((exit_price - entry) * direction / entry - 0.0012::DOUBLE) AS growth, risk_,
             row_number() OVER (PARTITION BY variant ORDER BY s.ts, s.sig_id) AS rn
           FROM (SELECT * EXCLUDE (risk) FROM graded) s JOIN res USING (sig_id), (SELECT variant, threshold, min_rr, risk AS risk_, leverage FROM vs) WHERE score >= threshold AND risk_reward >= min_rr)""",
        """g AS (SELECT variant, sig_id, ts, rn, growth, risk_, exit_ts AS busy, true AS kept FROM cand c WHERE rn = 1
           UNION ALL SELECT c.variant, c.sig_id, c.ts, c.rn, c.growth, c.risk_, CASE WHEN c.ts >= g.busy THEN c.exit_ts ELSE g.busy END, c.ts >= g.busy
           FROM g JOIN cand c ON c.variant = g.variant AND c.rn = g.rn + 1)""",
        """lgs AS (SELECT *, sum(ln(1 + growth)) OVER (PARTITION BY variant ORDER BY ts, sig_id ROWS UNBOUNDED PRECEDING) AS lg FROM g WHERE kept)""",
        """pks AS (SELECT *, greatest(0, max(lg) OVER (PARTITION BY variant ORDER BY ts, sig_id ROWS UNBOUNDED PRECEDING)) AS pk FROM lgs)""",
    ])
    + f""" SELECT variant, sig_id AS trade_id, CASE WHEN growth / least(risk_, 0.03) > 0.2 THEN 'win' WHEN growth / least(risk_, 0.03) < -0.2 THEN 'loss' ELSE 'breakeven' END AS variant_outcome,
    {R('100000 * exp(lg)', 4)} AS equity, {R('1 - exp(lg - pk)')} AS dd, {R('growth / least(risk_, 0.03)')} AS actual_rr FROM pks""",
)
def portfolio_variant_book(spark, sf):
    sig, bars = graded_signals(spark, sf)
    res = O.resolve(sig, bars, 48).select("sig_id", "outcome", "exit_price", "exit_ts")
    t = sig.join(res, "sig_id").withColumns({"trade_id": F.col("sig_id"), "cost_pct": F.lit(0.0012)})
    v = spark.createDataFrame([("tight", 0.85, 2.5, 0.01, 5), ("wide", 0.72, 2.0, 0.02, 10)],
                              "variant string, threshold double, min_rr double, risk double, leverage int")
    out = P.variant_book(materialize(t), v)
    return out.select("variant", "trade_id", "variant_outcome", r("equity", 4).alias("equity"), r("dd").alias("dd"), r("actual_rr").alias("actual_rr"))


BREAKER = """c AS (SELECT *, exit_time::DATE AS d, date_trunc('week', exit_time)::DATE AS wk, pnl_pct / 1000 AS p FROM trades WHERE exit_time IS NOT NULL),
s AS (SELECT *, sum(p) OVER (PARTITION BY asset_class, d ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS daily,
  sum(p) OVER (PARTITION BY asset_class, wk ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS weekly,
  sum(p) OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING) AS tot FROM c),
x AS (SELECT *, greatest(0, max(tot) OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) - tot AS dd FROM s)"""


@query(
    "portfolio_breaker_status",
    with_(TRADES, BREAKER)
    + f"""SELECT asset_class, trade_id, exit_time, {R('daily')} AS daily, {R('weekly')} AS weekly, {R('-dd')} AS alltime_dd,
    {R('least(greatest(0.03 - abs(least(daily, 0)), 0), greatest(0.05 - abs(least(weekly, 0)), 0), greatest(0.08 - dd, 0))')} AS risk_budget FROM x""",
)
def portfolio_breaker_status(spark, sf):
    t = T.trades(spark, sf).select("asset_class", "trade_id", "exit_time", (F.col("pnl_pct") / 1000).alias("pnl_pct"))
    out = P.breaker_status(t, ["asset_class"])
    return out.select("asset_class", "trade_id", "exit_time", *[r(c).alias(c) for c in ("daily", "weekly", "alltime_dd", "risk_budget")])


@query(
    "portfolio_breaker_windows",
    with_(TRADES, """c AS (SELECT asset_class, trade_id, exit_time, pnl_pct / 1000 AS p FROM trades WHERE exit_time IS NOT NULL),
      w AS (SELECT *, sum(p) OVER (PARTITION BY asset_class ORDER BY exit_time RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS d,
      sum(p) OVER (PARTITION BY asset_class ORDER BY exit_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS wk FROM c)""")
    + f"""SELECT asset_class, trade_id, exit_time, {R('d')} AS rolling_day, {R('wk')} AS rolling_week,
    CASE WHEN round(d, 9) <= -0.03 THEN exit_time + INTERVAL 24 HOUR END AS paused_until, round(wk, 9) <= -0.05 AS half_size FROM w""",
)
def portfolio_breaker_windows(spark, sf):
    t = T.trades(spark, sf).select("asset_class", "trade_id", "exit_time", (F.col("pnl_pct") / 1000).alias("pnl_pct"))
    out = P.breaker_windows(t, ["asset_class"])
    return out.select("asset_class", "trade_id", "exit_time", r("rolling_day").alias("rolling_day"), r("rolling_week").alias("rolling_week"), "paused_until", "half_size")


@query(
    "portfolio_step_multipliers",
    TR + f"""SELECT trade_id, {R('CASE WHEN score >= 0.9 THEN 1.5 WHEN score >= 0.8 THEN 1.25 WHEN score >= 0.6 THEN 1 WHEN score >= 0.55 THEN 0.5 ELSE 1 END')} AS size_multiplier FROM trades""",
)
def portfolio_step_multipliers(spark, sf):
    bands = [(0.9, 1.5), (0.8, 1.25), (0.6, 1.0), (0.55, 0.5)]
    return T.trades(spark, sf).select("trade_id", r(scores.step_multiplier(F.col("score"), bands)).alias("size_multiplier"))


@query(
    "portfolio_pause_run",
    "WITH RECURSIVE " + TRADES + """, o AS (SELECT asset_class, trade_id, (pnl_pct / 10)::DECIMAL(20, 9) AS p, epoch_us(exit_time) // 86400000000 AS d, (epoch_us(exit_time) // 86400000000 + 3) // 7 AS w,
      row_number() OVER (PARTITION BY asset_class ORDER BY exit_time, trade_id) AS rn FROM trades WHERE exit_time IS NOT NULL),
    g AS (SELECT asset_class, rn, d, w, p AS ds, p AS ws, p AS ts, true AS taken, p FROM o WHERE rn = 1
      UNION ALL SELECT asset_class, rn, d, w, CASE WHEN ok THEN d0 + p ELSE d0 END, CASE WHEN ok THEN w0 + p ELSE w0 END, CASE WHEN ok THEN t0 + p ELSE t0 END, ok, p
      FROM (SELECT *, NOT (t0 <= -0.08 OR d0 <= -0.03 OR w0 <= -0.05) AS ok FROM (
        SELECT o.*, CASE WHEN o.d <> g.d THEN 0 ELSE g.ds END AS d0, CASE WHEN o.w <> g.w THEN 0 ELSE g.ws END AS w0, g.ts AS t0
        FROM g JOIN o ON o.asset_class = g.asset_class AND o.rn = g.rn + 1)))
    SELECT asset_class, count(*) AS trades, """ + R("sum(p)") + """ AS pnl_pct FROM g WHERE taken GROUP BY asset_class""",
)
def portfolio_pause_run(spark, sf):
    t = T.trades(spark, sf).filter("exit_time is not null").select(
        "asset_class", "trade_id", F.col("exit_time").alias("ts"), (F.col("pnl_pct") / 10).alias("pnl_pct")
    )
    out = P.pause_run(t, ["asset_class"], -0.03, -0.05, -0.08)
    return out.groupBy("asset_class").agg(F.count(F.lit(1)).alias("trades"), r(F.sum("pnl_pct")).alias("pnl_pct"))


@query(
    "portfolio_risk_sizing",
    TR + f"""SELECT trade_id, {R('CASE WHEN score < 0.78::DOUBLE THEN 0 ELSE 0.0025::DOUBLE + (0.010::DOUBLE - 0.0025::DOUBLE) * least(greatest((score - 0.78::DOUBLE) / (1 - 0.78::DOUBLE), 0), 1) END', 8)} AS risk_fraction,
    {R('100000 * least(CASE WHEN score < 0.78::DOUBLE THEN 0 ELSE 0.0025::DOUBLE + (0.010::DOUBLE - 0.0025::DOUBLE) * least(greatest((score - 0.78::DOUBLE) / (1 - 0.78::DOUBLE), 0), 1) END * 1.5, 0.01)', 4)} AS risk_amount,
    {R('0.0025::DOUBLE + (0.0125::DOUBLE - 0.0025::DOUBLE) * least(greatest((score - 0.55::DOUBLE) / (1 - 0.55::DOUBLE), 0), 1)', 8)} AS confidence_risk FROM trades""",
)
def portfolio_risk_sizing(spark, sf):
    c = F.col("score")
    return T.trades(spark, sf).select(
        "trade_id", r(scores.risk_fraction(c), 8).alias("risk_fraction"),
        r(scores.risk_amount(c, F.lit(100_000.0), 1.5), 4).alias("risk_amount"),
        r(P.confidence_risk(c, 0.55, 0.0025, 0.0125), 8).alias("confidence_risk"),
    )


@query(
    "portfolio_open_heat",
    TR + f"""SELECT asset_class, count(*) AS positions, {R('sum(risk_pct)')} AS heat FROM trades WHERE exit_time IS NULL GROUP BY asset_class""",
)
def portfolio_open_heat(spark, sf):
    return T.trades(spark, sf).filter("exit_time is null").groupBy("asset_class").agg(
        F.count(F.lit(1)).alias("positions"), r(F.sum("risk_pct")).alias("heat")
    )


@query(
    "portfolio_reject_streaks",
    with_(TRADES, """m AS (SELECT asset_class, score >= 0.7::DOUBLE AS accepted, sum((score >= 0.7::DOUBLE)::INT) OVER
      (PARTITION BY asset_class ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM trades),
      l AS (SELECT asset_class, run, count(*) AS length FROM m WHERE NOT accepted GROUP BY ALL)""")
    + "SELECT asset_class, length, count(*) AS streaks FROM l GROUP BY ALL",
)
def portfolio_reject_streaks(spark, sf):
    t = T.trades(spark, sf).select("asset_class", "entry_time", (F.col("score") >= 0.7).alias("accepted"), F.struct("entry_time", "trade_id").alias("o"))
    block = F.floor(F.unix_seconds(F.col("o.entry_time")) / (7 * 86400)).cast("long")
    return P.reject_streaks(materialize(t), ["asset_class"], "o", block)


SCANS = """scans AS (SELECT year(l_shipdate)::INT AS cycle, 'S' || l_suppkey AS symbol, (['crypto', 'forex', 'stocks', 'commodities'])[(l_suppkey % 4 + 1)::INT] AS asset_class,
  avg(l_discount) AS alignment, avg(l_quantity) AS volume, avg(l_tax) AS trend_strength, avg(l_discount * l_tax) AS session,
  avg(l_extendedprice / l_quantity) AS zone_quality, least(avg(l_quantity) / 10 / 5, 1) AS rr_score, l_suppkey % 3 = 0 AS has_signal, l_suppkey % 7 <> 0 AS market_open
  FROM lineitem GROUP BY ALL)"""
_W = K.OPPORTUNITY_WEIGHTS
RANKED = [
    SCANS,
    "st AS (SELECT cycle, asset_class, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _W) + " FROM scans WHERE market_open GROUP BY ALL)",
    "sc AS (SELECT s.cycle, s.symbol, s.asset_class, " + ", ".join(
        f"CASE WHEN n < 2 THEN {c} WHEN s_{c} < 1e-10 THEN 0.5 ELSE 1 / (1 + exp(-({c} - m_{c}) / s_{c})) END AS z_{c}" for c in _W)
    + ", has_signal FROM scans s JOIN st USING (cycle, asset_class) WHERE market_open)",
    "tot AS (SELECT *, least((" + " + ".join(f"z_{c} * {w}::DOUBLE" for c, w in _W.items()) + ") * CASE WHEN has_signal THEN 1.2::DOUBLE ELSE 1 END, 1) AS score FROM sc)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY round(score, 9) DESC, symbol) AS rank FROM tot WHERE score >= 0.5)",
]


def scans(spark, sf):
    li = T.table(spark, sf, "lineitem")
    g = li.groupBy(F.year("l_shipdate").alias("cycle"), F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_suppkey")).agg(
        F.avg("l_discount").alias("alignment"), F.avg("l_quantity").alias("volume"), F.avg("l_tax").alias("trend_strength"),
        F.avg(F.col("l_discount") * F.col("l_tax")).alias("session"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("zone_quality"),
    )
    return g.withColumns({
        "asset_class": T.class_of(F.col("l_suppkey")), "rr_score": F.least(F.col("volume") / 10 / 5, F.lit(1.0)),
        "has_signal": F.col("l_suppkey") % 3 == 0, "market_open": F.col("l_suppkey") % 7 != 0,
    })


@query("rank_opportunities", with_(*RANKED) + f"SELECT cycle, symbol, asset_class, {R('score')} AS score, rank FROM rk WHERE rank <= 10")
def rank_opportunities(spark, sf):
    return K.opportunities(scans(spark, sf), "cycle").select("cycle", "symbol", "asset_class", r("score").alias("score"), "rank")


@query(
    "rank_symbol_percentiles",
    with_(SCANS) + f"""SELECT cycle, symbol, {R('CASE WHEN count(*) OVER p = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY cycle, asset_class ORDER BY round(zone_quality, 9), symbol) - 1) / (count(*) OVER p - 1) END')} AS volatility_rank
    FROM scans WINDOW p AS (PARTITION BY cycle, asset_class)""",
)
def rank_symbol_percentiles(spark, sf):
    s = scans(spark, sf).withColumn("zone_quality", F.round("zone_quality", 9))
    return K.percent_rank(s, ["cycle", "asset_class"], "zone_quality", "volatility_rank").select("cycle", "symbol", r("volatility_rank").alias("volatility_rank"))


@query(
    "rank_capital_allocation",
    "WITH RECURSIVE " + ",\n".join([*RANKED, "w AS (SELECT cycle, rank, symbol, asset_class, score FROM rk WHERE rank <= 10)", """g AS (
      SELECT DISTINCT cycle, 0::BIGINT AS rank, ''::VARCHAR AS symbol, ''::VARCHAR AS asset_class, 0 AS taken, 0.0::DOUBLE AS heat, 0 AS n0, 0 AS n1, 0 AS n2, 0 AS n3,
        NULL::DOUBLE AS risk_pct, ''::VARCHAR AS reason FROM w
      UNION ALL
      SELECT cycle, rank, symbol, asset_class, taken + ok::INT, heat + CASE WHEN ok THEN risk ELSE 0 END, n0 + (ok AND asset_class = 'crypto')::INT, n1 + (ok AND asset_class = 'forex')::INT,
        n2 + (ok AND asset_class = 'stocks')::INT, n3 + (ok AND asset_class = 'commodities')::INT, CASE WHEN ok THEN risk END, reason
      FROM (SELECT *, reason = 'approved' AS ok FROM (SELECT *, CASE WHEN rank = 3 THEN 'held' WHEN taken >= 5 THEN 'max_positions'
          WHEN CASE asset_class WHEN 'crypto' THEN n0 WHEN 'forex' THEN n1 WHEN 'stocks' THEN n2 ELSE n3 END >= 2 THEN 'max_class'
          WHEN 0.06 - heat <= 0.001 THEN 'heat' WHEN rank = 5 THEN 'correlation' WHEN risk < 0.001 THEN 'risk_too_small' ELSE 'approved' END AS reason
        FROM (SELECT w.*, g.taken, g.heat, g.n0, g.n1, g.n2, g.n3, least(0.005::DOUBLE + (0.015::DOUBLE - 0.005::DOUBLE) * least(w.score, 1), 0.06::DOUBLE - g.heat) AS risk
              FROM g JOIN w ON w.cycle = g.cycle AND w.rank = g.rank + 1))))"""])
    + f" SELECT cycle, symbol, asset_class, rank, {R('risk_pct', 8)} AS risk_pct, reason FROM g WHERE rank > 0",
)
def rank_capital_allocation(spark, sf):
    ranked = K.opportunities(scans(spark, sf), "cycle").withColumns({"held": F.col("rank") == 3, "conflict": F.col("rank") == 5})
    return P.allocate(ranked, "cycle").select("cycle", "symbol", "asset_class", "rank", r("risk_pct", 8).alias("risk_pct"), "reason")
