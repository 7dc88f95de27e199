"""Volume, profiles, zones, trend scores, features and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import (
    TICKS, bars_cte, breaks_cte, gaps_cte, order_blocks_cte, swings_cte, touch_sql, with_,
)
from tapeline.catalog.outcome_queries import SIGNALS, signals
from tapeline.catalog.registry import R, query, r
from tapeline.catalog.structure_queries import _MOVES, _ema_cte
from tapeline.functions import scores
from tapeline.operators import bars as B
from tapeline.operators import market as M
from tapeline.operators import recursive as X
from tapeline.operators import structure as S
from tapeline.operators import zones as Z
from tapeline.plans import features as E
from tapeline.plans import signals as G
from tapeline.session import materialize
from tapeline.sources import tables as T

L = 5
BARS = with_(TICKS, bars_cte())
W = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {} PRECEDING AND {})"


@query(
    "market_liquidity_rank",
    with_("""daily AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate::DATE AS day, sum(l_extendedprice) AS usd FROM lineitem GROUP BY ALL),
    spine AS (SELECT symbol, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY symbol),
    rolled AS (SELECT symbol, day, CASE WHEN count(usd) OVER w >= 5 THEN sum(usd) OVER w END AS rolling FROM spine LEFT JOIN daily USING (symbol, day)
      WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    mon AS (SELECT symbol, date_trunc('month', day)::DATE AS month, round(arg_max(rolling, day) FILTER (rolling IS NOT NULL), 2) AS usd_volume FROM rolled GROUP BY ALL)""")
    + "SELECT symbol, month, usd_volume + 0.0 AS usd_volume, rank() OVER (PARTITION BY month ORDER BY usd_volume DESC) AS rank FROM mon WHERE usd_volume IS NOT NULL",
)
def market_liquidity_rank(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("close"), F.lit(1.0).alias("volume")
    )
    out = B.liquidity_rank(li, 30, 5)
    return out.select("symbol", "month", r("usd_volume", 2).alias("usd_volume"), "rank")


@query(
    "market_history_sufficiency",
    with_(TICKS, bars_cte("1h", "b1"), bars_cte("1d", "b2"))
    + " UNION ALL ".join(f"SELECT symbol, '{tf}' AS tf, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS bars_before, min(ts) AS first_ts FROM {b} GROUP BY symbol" for tf, b in (("1h", "b1"), ("1d", "b2"))),
)
def market_history_sufficiency(spark, sf):
    t = T.ticks(spark, sf)
    return B.history_sufficiency(B.bars_from_ticks(t, "1h").unionByName(B.bars_from_ticks(t, "1d")), "2024-01-15")


@query(
    "market_symbol_profiles",
    with_(TICKS, bars_cte(), """tr AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM bars
      WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)), ok AS (SELECT * FROM tr WHERE close > 0),
      d AS (SELECT symbol, bar_idx // 288 AS d, sum(close * volume) AS u FROM ok GROUP BY ALL)""")
    + f"""SELECT symbol, {R('avg(tr / close)')} AS atr_pct, {R('avg(close * volume)')} AS usd_volume, {R('(max(high) - min(low)) / avg(close)')} AS range_pct,
    {R('(SELECT avg(u) FROM d WHERE d.symbol = ok.symbol)')} AS day_usd_volume, count(*) AS bars FROM ok GROUP BY symbol""",
)
def market_symbol_profiles(spark, sf):
    p = M.symbol_profile(T.bars(spark, sf))
    return p.select("symbol", *[r(c).alias(c) for c in ("atr_pct", "usd_volume", "range_pct", "day_usd_volume")], "bars")


@query(
    "market_instrument_profiles",
    with_(TICKS, bars_cte("5m"), """tr AS (SELECT *, CASE WHEN bar_idx > 0 THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
      a AS (SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 13 PRECEDING) AS atr FROM tr)""")
    + f"""SELECT symbol, {R('avg(atr / close) FILTER (bar_idx >= 14 AND close > 0) * sqrt(288)')} AS daily_atr_pct, {R('count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000, 1)')} AS bars_per_day, count(*) AS bars FROM a GROUP BY symbol""",
)
def market_instrument_profiles(spark, sf):
    p = M.instrument_profile(T.bars(spark, sf, "5m"))
    return p.select("symbol", r("daily_atr_pct").alias("daily_atr_pct"), r("bars_per_day").alias("bars_per_day"), "bars")


@query(
    "market_volume_measures",
    BARS + f"""SELECT symbol, ts, {R(f'CASE WHEN count(*) OVER a >= 5 AND avg(volume) OVER a > 0 THEN least(volume / avg(volume) OVER a, 5) ELSE 1 END')} AS volume_ratio,
    {R('CASE WHEN bar_idx >= 19 AND avg(volume) OVER p > 0 THEN volume / avg(volume) OVER p ELSE 0 END')} AS relative_ratio,
    {R('CASE WHEN bar_idx >= 19 AND avg(volume) OVER p > 0 AND volume / avg(volume) OVER p >= 1.5 THEN least(volume / avg(volume) OVER p, 3) / 3 ELSE 0 END')} AS relative_score,
    bar_idx >= 4 AND coalesce(avg(volume) OVER q > 0 AND volume >= avg(volume) OVER q * 1.2::DOUBLE, false) AS volume_ok FROM bars
    WINDOW a AS {W.format(19, 'CURRENT ROW')}, p AS {W.format(100, '1 PRECEDING')}, q AS {W.format(20, '1 PRECEDING')}""",
)
def market_volume_measures(spark, sf):
    v = M.volume_measures(T.bars(spark, sf))
    return v.select("symbol", "ts", *[r(c).alias(c) for c in ("volume_ratio", "relative_ratio", "relative_score")], "volume_ok")


@query(
    "market_regime_volatility",
    BARS + f"""SELECT symbol, ts, {R('CASE WHEN round(stddev_pop(close) OVER l, 9) > 0 THEN least(greatest(stddev_pop(close) OVER s / stddev_pop(close) OVER l, 0.5), 2) ELSE 1 END', 5)} AS regime_volatility
    FROM bars WINDOW s AS {W.format(49, 'CURRENT ROW')}, l AS {W.format(199, 'CURRENT ROW')}""",
)
def market_regime_volatility(spark, sf):
    return M.regime_volatility(T.bars(spark, sf)).select("symbol", "ts", r("regime_volatility", 5).alias("regime_volatility"))


@query(
    "market_simple_indicators",
    with_(TICKS, bars_cte(), _MOVES)
    + f"""SELECT symbol, ts, {R('''CASE WHEN bar_idx < 14 THEN 50 WHEN avg(loss) OVER w = 0 THEN CASE WHEN avg(gain) OVER w > 0 THEN 100 ELSE 50 END
      ELSE 100 - 100 / (1 + avg(gain) OVER w / avg(loss) OVER w) END''')} AS rsi_simple,
    {R('avg(CASE WHEN bar_idx > 0 THEN tr END) OVER w')} AS atr_simple FROM moves WINDOW w AS {W.format(13, 'CURRENT ROW')}""",
)
def market_simple_indicators(spark, sf):
    rows = X.simple_atr(X.simple_rsi(T.bars(spark, sf)))
    return rows.select("symbol", "ts", r("rsi_simple").alias("rsi_simple"), r("atr_simple").alias("atr_simple"))


@query(
    "market_volatility_filter",
    with_(TICKS, bars_cte(), _MOVES, f"a AS (SELECT symbol, ts, close, avg(tr) OVER {W.format(13, 'CURRENT ROW')} AS atr FROM moves)")
    + f"SELECT symbol, ts, {R('atr / close')} AS atr_share FROM a WHERE close > 0 AND atr / close >= 1.2::DOUBLE",
)
def market_volatility_filter(spark, sf):
    return M.volatility_filter(T.bars(spark, sf), 1.2).select("symbol", "ts", r("atr_share").alias("atr_share"))


ADX_TRAINING = """rec AS (
  SELECT m.symbol, m.bar_idx, s.t AS atr, CASE WHEN s.t > 0 THEN s.p / s.t * 100 ELSE 0 END AS pdi, CASE WHEN s.t > 0 THEN s.m / s.t * 100 ELSE 0 END AS mdi
  FROM {m} m JOIN (SELECT symbol, (avg(tr) FILTER (bar_idx <= 13) * 13 + max(tr) FILTER (bar_idx = 14)) / 14 AS t,
    avg(pdm) FILTER (bar_idx BETWEEN 1 AND 14) AS p, avg(mdm) FILTER (bar_idx BETWEEN 1 AND 14) AS m FROM {m} GROUP BY symbol) s USING (symbol) WHERE m.bar_idx = 14
  UNION ALL
  SELECT m.symbol, m.bar_idx, (r.atr * 13 + m.tr) / 14,
    CASE WHEN (r.atr * 13 + m.tr) / 14 > 0 THEN least((r.pdi * 13 + m.pdm) / 14 / ((r.atr * 13 + m.tr) / 14) * 100, 100) ELSE 0 END,
    CASE WHEN (r.atr * 13 + m.tr) / 14 > 0 THEN least((r.mdi * 13 + m.mdm) / 14 / ((r.atr * 13 + m.tr) / 14) * 100, 100) ELSE 0 END
  FROM rec r JOIN {m} m ON m.symbol = r.symbol AND m.bar_idx = r.bar_idx + 1),
dxs AS (SELECT symbol, bar_idx, CASE WHEN pdi + mdi > 0 THEN abs(pdi - mdi) / (pdi + mdi) * 100 ELSE 0 END AS dx FROM rec),
adxr AS (SELECT symbol, 28::BIGINT AS bar_idx, avg(dx) AS adx FROM dxs WHERE bar_idx BETWEEN 14 AND 28 GROUP BY symbol
  UNION ALL SELECT d.symbol, d.bar_idx, (a.adx * 13 + d.dx) / 14 FROM adxr a JOIN dxs d ON d.symbol = a.symbol AND d.bar_idx = a.bar_idx + 1),
adxt AS (SELECT b.symbol, b.bar_idx, CASE WHEN b.n_bars >= 29 AND b.bar_idx >= 28 THEN a.adx ELSE 25 END AS adx FROM {m} b LEFT JOIN adxr a ON a.symbol = b.symbol AND a.bar_idx = b.bar_idx)"""


@query(
    "market_adx_training",
    "WITH RECURSIVE " + ",\n".join([TICKS, bars_cte(), _MOVES, ADX_TRAINING.format(m="moves")])
    + f"SELECT b.symbol, b.ts, {R('adx')} AS adx_training FROM adxt a JOIN bars b ON b.symbol = a.symbol AND b.bar_idx = a.bar_idx",
)
def market_adx_training(spark, sf):
    return X.adx_training(T.bars(spark, sf)).select("symbol", "ts", r("adx_training").alias("adx_training"))


@query(
    "market_trend_scores",
)
def market_trend_scores(spark, sf):
    rows = X.macd(X.simple_rsi(X.adx(materialize(X.ema(T.bars(spark, sf), {"ema20": 20, "ema50": 50})))))
    up = F.lit(True)
    mom = scores.momentum_score(up, F.col("rsi_simple"), F.col("macd_hist"), F.col("macd_prev"))
    agree = (F.col("ema20") > F.col("ema50")).cast("double")
    s = scores.trend_score(F.col("adx"), mom, agree, F.col("plus_di") > F.col("minus_di"))
    return rows.select("symbol", "ts", r(s).alias("trend_score"))


@query(
    "market_timeframe_agreement",
    "WITH RECURSIVE " + ",\n".join(
        [TICKS] + [x for tf in ("1h", "4h") for x in (bars_cte(tf, f"b{tf}"), _ema_cte({"e20": 20, "e50": 50}, f"b{tf}", f"e{tf}"))])
    + """SELECT a.symbol, a.ts, ((x.e20 > x.e50)::INT + (y.e20 > y.e50)::INT)::INT AS aligned, ((x.e20 > x.e50)::INT + (y.e20 > y.e50)::INT) / 2.0::DOUBLE AS share
    FROM b1h a JOIN e1h x ON x.symbol = a.symbol AND x.bar_idx = a.bar_idx
    JOIN b4h b ON b.symbol = a.symbol AND b.ts = make_timestamp((epoch_us(a.ts) // 14400000000) * 14400000000)
    JOIN e4h y ON y.symbol = b.symbol AND y.bar_idx = b.bar_idx""",
)
def market_timeframe_agreement(spark, sf):
    tall = G.series_table(materialize(B.bars_from_ticks(T.ticks(spark, sf), "1h")), "1h").filter("tf in ('1h', '4h')")
    e = X.ema(tall, {"e20": 20, "e50": 50}).withColumn("up", (F.col("e20") > F.col("e50")).cast("int"))
    e = materialize(e.select("symbol", "sym", "tf", "ts", "bar_idx", "up"))
    rows = e.filter("tf = '1h'").select("sym", "ts", F.col("up").alias("u1"))
    rows = G.attach(rows, e, "4h", {"up": "u4"}, G.SignalParams(), "inner")
    return rows.select(F.col("sym").alias("symbol"), "ts", (F.col("u1") + F.col("u4")).alias("aligned"), ((F.col("u1") + F.col("u4")) / 2).alias("share"))


ZONES = """zones AS (SELECT symbol, bar_idx, 'fvg' AS type, gap AS sign, gap_top AS top, gap_bottom AS bottom FROM gaps WHERE gap IS NOT NULL
  UNION ALL SELECT symbol, bar_idx, 'ob', ob, ob_top, ob_bottom FROM obs)"""
ALL = [TICKS, bars_cte(), swings_cte(L), breaks_cte(), gaps_cte(), order_blocks_cte(), ZONES]


def _tables(spark, sf):
    bars = T.bars(spark, sf)
    t = G.structure_tables(bars.withColumns({"sym": F.col("symbol"), "tf": F.lit("1h")}), G.SignalParams(swing_length=L))
    return bars, t, materialize(G.zone_events(t))


@query(
    "zone_active_counts",
    with_(*ALL, f"""m AS (SELECT z.*, {touch_sql('z.gap > 0', 'CASE WHEN z.gap > 0 THEN z.gap_bottom ELSE z.gap_top END', '<=')} AS e FROM gaps z WHERE gap IS NOT NULL)""")
    + """SELECT b.symbol, b.ts, (SELECT count(*) FROM m WHERE m.symbol = b.symbol AND m.bar_idx <= b.bar_idx AND (m.e IS NULL OR m.e > b.bar_idx)) AS active FROM bars b""",
)
def zone_active_counts(spark, sf):
    bars, t, _ = _tables(spark, sf)
    g = S.gap_mitigation(t["gaps"], bars)
    return S.active_counts(bars, materialize(g), "mitigated_idx").select("symbol", "ts", F.coalesce("active", F.lit(0)).alias("active"))


@query(
    "zone_nearest_distance",
    with_(*ALL, _MOVES, f"a AS (SELECT symbol, ts, bar_idx, close, avg(tr) OVER {W.format(13, 'CURRENT ROW')} AS atr FROM moves)",
          f"""m AS (SELECT symbol, bar_idx, (gap_top + gap_bottom) / 2 AS mid, {touch_sql('z.gap > 0', 'CASE WHEN z.gap > 0 THEN z.gap_bottom ELSE z.gap_top END', '<=')} AS e FROM gaps z WHERE gap IS NOT NULL)""",
          """d AS (SELECT a.symbol, a.bar_idx, CASE WHEN a.atr > 0 THEN (m.mid - a.close) / a.atr ELSE 0 END AS d FROM a JOIN m ON m.symbol = a.symbol AND m.bar_idx <= a.bar_idx AND (m.e IS NULL OR m.e > a.bar_idx))""",
          "g AS (SELECT symbol, bar_idx, min(d) FILTER (d > 0) AS up, min(-d) FILTER (d < 0) AS dn, count(*) AS n FROM d GROUP BY ALL)")
    + f"""SELECT a.symbol, a.ts, {R('least(coalesce(up, 5), 5)')} AS dist_above, {R('least(coalesce(dn, 5), 5)')} AS dist_below, least(coalesce(n, 0), 20) / 20.0::DOUBLE AS active_share
    FROM a LEFT JOIN g ON g.symbol = a.symbol AND g.bar_idx = a.bar_idx""",
)
def zone_nearest_distance(spark, sf):
    bars, t, _ = _tables(spark, sf)
    from tapeline.operators.bars import true_range
    from tapeline.operators.blocks import framed

    moved = framed(bars, ["symbol"], lambda w: {"_tr": true_range(w)}, before=1)
    rows = materialize(framed(moved, ["symbol"], lambda w: {"atr": F.avg("_tr").over(w.rowsBetween(-13, 0))}, before=14))
    g = S.gap_mitigation(t["gaps"], bars).select("symbol", "bar_idx", "mitigated_idx", ((F.col("gap_top") + F.col("gap_bottom")) / 2).alias("mid"))
    d = Z.nearest_zones(rows, materialize(g), "mitigated_idx")
    return d.join(bars.select("symbol", "bar_idx", "ts"), ["symbol", "bar_idx"]).select(
        "symbol", "ts", r("dist_above").alias("dist_above"), r("dist_below").alias("dist_below"), "active_share"
    )


@query(
    "zone_quality_scores",
    with_(*ALL, _MOVES, f"a AS (SELECT symbol, bar_idx, open, high, low, close, avg(tr) OVER {W.format(13, 'CURRENT ROW')} AS atr FROM moves)",
          """q AS (SELECT z.*, n.atr, f.open, f.high, f.low, f.close, abs(z.top - z.bottom) AS rng,
            CASE WHEN EXISTS (SELECT 1 FROM bars c WHERE c.symbol = z.symbol AND c.bar_idx > z.bar_idx AND c.bar_idx < z.bar_idx + 5 AND
              CASE WHEN z.sign > 0 THEN c.close < z.bottom ELSE c.close > z.top END) THEN 0
            WHEN EXISTS (SELECT 1 FROM bars c WHERE c.symbol = z.symbol AND c.bar_idx > z.bar_idx AND c.bar_idx < z.bar_idx + 5 AND
              CASE WHEN z.sign > 0 THEN c.close < z.top ELSE c.close > z.bottom END) THEN 0.5::DOUBLE ELSE 1 END AS untouched
          FROM zones z JOIN a n ON n.symbol = z.symbol AND n.bar_idx = z.bar_idx + 5 JOIN a f ON f.symbol = z.symbol AND f.bar_idx = z.bar_idx)""",
          """s AS (SELECT *, CASE WHEN atr <= 0 OR rng <= 0 THEN 0 WHEN rng / atr < 0.3::DOUBLE THEN 0.1::DOUBLE WHEN rng / atr <= 1 THEN 0.5::DOUBLE + 0.5::DOUBLE * (rng / atr - 0.3::DOUBLE) / 0.7::DOUBLE
             WHEN rng / atr <= 2 THEN 1 - 0.3::DOUBLE * (rng / atr - 1) WHEN rng / atr <= 3 THEN 0.7::DOUBLE - 0.4::DOUBLE * (rng / atr - 2) ELSE 0.1::DOUBLE END AS sz,
            CASE WHEN high - low <= 0 THEN 0 WHEN abs(close - open) / (high - low) >= 0.7::DOUBLE THEN 1
             WHEN abs(close - open) / (high - low) >= 0.5::DOUBLE THEN 0.7::DOUBLE + 0.3::DOUBLE * (abs(close - open) / (high - low) - 0.5::DOUBLE) / 0.2::DOUBLE
             WHEN abs(close - open) / (high - low) >= 0.3::DOUBLE THEN 0.4::DOUBLE + 0.3::DOUBLE * (abs(close - open) / (high - low) - 0.3::DOUBLE) / 0.2::DOUBLE ELSE 0.2::DOUBLE END AS fm FROM q)""")
    + f"""SELECT symbol, bar_idx, type, sign, untouched::DOUBLE AS untouched, {R('sz')} AS size_score, {R('fm')} AS formation,
    {R('exp(-0.75::DOUBLE) * untouched * (sz * 0.35::DOUBLE + fm * 0.35::DOUBLE)')} AS zone_quality FROM s""",
)
def zone_quality_scores(spark, sf):
    bars, _, zones = _tables(spark, sf)
    rows = X.simple_atr(bars, 14, "_x")
    from tapeline.operators.bars import true_range
    from tapeline.operators.blocks import framed

    moved = framed(rows, ["symbol"], lambda w: {"_tr": true_range(w)}, before=1)
    rows = materialize(framed(moved, ["symbol"], lambda w: {"atr": F.avg("_tr").over(w.rowsBetween(-13, 0))}, before=14))
    out = Z.rate_zones(zones, rows, 5, F.lit(False))
    return out.select("symbol", "bar_idx", "type", "sign", "untouched", *[r(c).alias(c) for c in ("size_score", "formation", "zone_quality")])


@query(
    "zone_recent_choice",
    with_(*ALL)
    + """SELECT b.symbol, b.ts, z.sign, arg_max(z.type, (z.type = 'fvg')::INT * 1000000 + z.bar_idx - b.bar_idx) AS zone_type,
      arg_max(z.top, (z.type = 'fvg')::INT * 1000000 + z.bar_idx - b.bar_idx) AS zone_top FROM bars b JOIN zones z ON z.symbol = b.symbol AND z.bar_idx BETWEEN b.bar_idx - 9 AND b.bar_idx
      GROUP BY ALL""",
)
def zone_recent_choice(spark, sf):
    bars, _, zones = _tables(spark, sf)
    best = Z.recent_zone(bars, zones, 10)
    return best.join(bars.select("symbol", "bar_idx", "ts"), ["symbol", "bar_idx"]).select("symbol", "ts", "sign", "zone_type", "zone_top")


@query(
    "zone_structural_stops",
    with_(*ALL, f"""s AS (SELECT b.symbol, b.ts, b.close, last_value(CASE WHEN o.ob > 0 THEN o.ob_bottom END IGNORE NULLS) OVER w AS ub, last_value(CASE WHEN o.ob < 0 THEN o.ob_top END IGNORE NULLS) OVER w AS dt,
      last_value(CASE WHEN k.swing > 0 THEN k.swing_level END IGNORE NULLS) OVER w AS hi, last_value(CASE WHEN k.swing < 0 THEN k.swing_level END IGNORE NULLS) OVER w AS lo
      FROM bars b LEFT JOIN obs o ON o.symbol = b.symbol AND o.bar_idx = b.bar_idx LEFT JOIN swung k ON k.symbol = b.symbol AND k.bar_idx = b.bar_idx
      WINDOW w AS (PARTITION BY b.symbol ORDER BY b.bar_idx ROWS UNBOUNDED PRECEDING))""")
    + """SELECT symbol, ts, coalesce(CASE WHEN ub < close THEN ub END, CASE WHEN lo < close THEN lo END) AS stop_long,
      coalesce(CASE WHEN dt > close THEN dt END, CASE WHEN hi > close THEN hi END) AS stop_short FROM s""",
)
def zone_structural_stops(spark, sf):
    bars, t, _ = _tables(spark, sf)
    levels = t["swings"].filter("swing is not null").select("symbol", "bar_idx", F.col("swing").alias("liquidity"), F.col("swing_level").alias("level"))
    return Z.structural_stop(bars, t["blocks"], levels).select("symbol", "ts", "stop_long", "stop_short")


@query(
    "zone_confluence",
    with_(*ALL, SIGNALS, """tags AS (SELECT symbol, bar_idx, kind || CASE WHEN sign > 0 THEN '_up' ELSE '_down' END AS tag FROM breaks
      UNION SELECT symbol, bar_idx, upper(type) || CASE WHEN sign > 0 THEN '_up' ELSE '_down' END FROM zones)""")
    + """SELECT s.sig_id, array_to_string(list_sort(list_distinct(list(t.tag))), ',') AS tags FROM sig s JOIN tags t ON t.symbol = s.symbol AND t.bar_idx BETWEEN s.bar_idx - 3 AND s.bar_idx + 1 GROUP BY s.sig_id""",
)
def zone_confluence(spark, sf):
    bars, t, zones = _tables(spark, sf)
    sig = T.break_signals(bars, t["breaks"])
    return Z.confluence(sig, t["breaks"], zones).select("sig_id", F.array_join("tags", ",").alias("tags"))


@query(
    "zone_missed_setups",
    with_(*ALL) + """SELECT k.symbol, greatest(count(*) - 1, 0) AS missed FROM breaks k JOIN gaps g ON g.symbol = k.symbol AND g.bar_idx = k.bar_idx AND g.gap = k.sign GROUP BY k.symbol""",
)
def zone_missed_setups(spark, sf):
    _, t, zones = _tables(spark, sf)
    return Z.missed_setups(t["breaks"], zones)


@query(
    "zone_hindsight_points",
    with_(*ALL, SIGNALS, """p AS (SELECT s.*,
      (SELECT arg_max(CASE WHEN s.direction > 0 THEN o.ob_bottom ELSE o.ob_top END, o.bar_idx) FROM obs o WHERE o.symbol = s.symbol AND o.bar_idx <= s.bar_idx
        AND CASE WHEN s.direction > 0 THEN o.ob_bottom <= s.entry ELSE o.ob_top >= s.entry END) AS oe,
      (SELECT arg_max(k.swing_level, k.bar_idx) FROM swung k WHERE k.symbol = s.symbol AND k.bar_idx <= s.bar_idx
        AND CASE WHEN s.direction > 0 THEN k.swing = -1 AND k.low < s.entry ELSE k.swing = 1 AND k.high > s.entry END) AS os,
      CASE WHEN s.direction > 0 THEN (SELECT arg_min(k.swing_level, k.bar_idx) FROM swung k WHERE k.symbol = s.symbol AND k.bar_idx <= s.bar_idx AND k.swing_level > s.entry)
        ELSE (SELECT arg_max(k.swing_level, k.bar_idx) FROM swung k WHERE k.symbol = s.symbol AND k.bar_idx <= s.bar_idx AND k.swing_level < s.entry) END AS ot FROM sig s)""")
    + f"""SELECT sig_id, {R('coalesce(oe, entry)')} AS optimal_entry, {R('coalesce(os, stop)')} AS optimal_sl, {R('coalesce(ot, target)')} AS optimal_tp FROM p""",
)
def zone_hindsight_points(spark, sf):
    bars, t, _ = _tables(spark, sf)
    sig = materialize(T.break_signals(bars, t["breaks"]))
    levels = t["swings"].filter("swing is not null").select("symbol", "bar_idx", F.col("swing_level").alias("level"))
    out = Z.optimal_points(sig, t["blocks"], t["swings"], materialize(levels), bars)
    return out.select("sig_id", *[r(c).alias(c) for c in ("optimal_entry", "optimal_sl", "optimal_tp")])


@query(
    "market_volume_profile",
    with_(TICKS, bars_cte(), swings_cte(L), breaks_cte(), SIGNALS,
          """w AS (SELECT s.sig_id, s.entry, s.target, s.direction, b.high, b.low, b.volume FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.bar_idx BETWEEN s.bar_idx - 99 AND s.bar_idx),
    p AS (SELECT sig_id, min(low) AS mn, max(high) AS mx, count(*) AS n FROM w GROUP BY sig_id),
    v AS (SELECT w.sig_id, i, sum(CASE WHEN high > low AND volume > 0 THEN volume * greatest(least(high, mn + (mx - mn) / 10 * (i + 1)) - greatest(low, mn + (mx - mn) / 10 * i), 0) / (high - low) ELSE 0 END) AS v
      FROM w JOIN p USING (sig_id), range(10) t(i) GROUP BY ALL),
    d AS (SELECT sig_id, i, v / sum(v) OVER (PARTITION BY sig_id) AS d, sum(v) OVER (PARTITION BY sig_id) AS tot FROM v),
    e AS (SELECT s.sig_id, s.direction, n, mn, mx, least(greatest(trunc((entry - mn) / (mx - mn) * 10), 0), 9) AS eb, least(greatest(trunc((target - mn) / (mx - mn) * 10), 0), 9) AS tb FROM sig s JOIN p USING (sig_id)),
    f AS (SELECT e.*, max(tot) AS tot, max(d) FILTER (i = eb) AS ed, avg(d) FILTER (CASE WHEN direction > 0 THEN i BETWEEN eb AND tb ELSE i BETWEEN tb AND eb END) AS pv FROM e JOIN d USING (sig_id) GROUP BY ALL)""")
    + f"""SELECT sig_id, {R('''CASE WHEN n < 20 OR mx <= mn OR tot <= 0 THEN 0.5 ELSE least(greatest(least(ed * 10, 2) / 2 * 0.4::DOUBLE
      + CASE WHEN pv IS NULL THEN 0.5 ELSE least(greatest(1 - (pv * 10 - 0.5), 0), 1) END * 0.6::DOUBLE, 0), 1) END''')} AS profile_score FROM f""",
)
def market_volume_profile(spark, sf):
    sig, bars = signals(spark, sf)
    req = sig.select(F.col("sig_id").alias("req_id"), "symbol", "bar_idx", "entry", "target", "direction")
    return M.volume_profile(bars, req).select(F.col("req_id").alias("sig_id"), r("profile_score").alias("profile_score"))


_BIAS = "list_sum(list_transform(list(close ORDER BY bar_idx), lambda x, i: x * pow(1 - 2.0::DOUBLE / {n}, len(list(close)) - i))) / list_sum(list_transform(list(close ORDER BY bar_idx), lambda x, i: pow(1 - 2.0::DOUBLE / {n}, len(list(close)) - i)))"


@query(
    "market_universe_scan",
    with_(TICKS, bars_cte(), _MOVES, f"""l AS (SELECT symbol, ts, bar_idx, n_bars, close, volume, avg(tr) OVER a AS atr, avg(gain) OVER a AS g, avg(loss) OVER a AS ls,
      avg(volume) OVER v AS v20, avg(volume) OVER w AS v100 FROM moves WINDOW a AS {W.format(13, 'CURRENT ROW')}, v AS {W.format(19, 'CURRENT ROW')}, w AS {W.format(99, 'CURRENT ROW')}),
      e AS (SELECT symbol, {_BIAS.format(n=21)} AS e20, {_BIAS.format(n=51)} AS e50 FROM bars GROUP BY symbol),
      x AS (SELECT l.*, e20, e50, CASE WHEN ls = 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g / ls) END AS rsi FROM l JOIN e USING (symbol) WHERE bar_idx = n_bars - 1 AND n_bars >= 30 AND close > 0)""")
    + f"""SELECT symbol, ts, {R('atr / close')} AS atr_share, {R('least(volume / v100, 2) / 2')} AS volume_score,
      {R('CASE WHEN e20 > e50 THEN least((e20 - e50) / close * 100, 1) ELSE 0 END')} AS trend_score,
      {R('CASE WHEN rsi BETWEEN 40 AND 60 THEN 1 WHEN rsi BETWEEN 30 AND 70 THEN 0.6 ELSE 0.3 END')} AS momentum_score
      FROM x WHERE atr / close >= 0.001 AND volume / v20 >= 0.5""",
)
def market_universe_scan(spark, sf):
    out = Z.universe_scan(T.bars(spark, sf), 0.001)
    return out.select("symbol", "ts", *[r(c).alias(c) for c in ("atr_share", "volume_score", "trend_score", "momentum_score")])


@query(
    "market_episode_ids",
    """WITH e AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, lag(l_quantity) OVER w AS p FROM lineitem
      WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey))
    SELECT l_suppkey AS supplier, l_orderkey, l_linenumber, l_partkey, (sum(CASE WHEN l_quantity < p THEN 1 ELSE 0 END)
      OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING))::BIGINT AS episode FROM e""",
)
def market_episode_ids(spark, sf):
    from tapeline.operators.blocks import number_rows

    li = T.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("bars_held"))
    rows = number_rows(li, ["l_suppkey"], "l_shipdate", 365 * 86400, ("l_orderkey", "l_linenumber", "l_partkey"), "i", None)
    out = Z.episode_ids(materialize(rows), ["l_suppkey"], "i", F.floor(F.col("i") / 4096).cast("long"))
    return out.select(F.col("l_suppkey").alias("supplier"), "l_orderkey", "l_linenumber", "l_partkey", F.col("episode").cast("long").alias("episode"))


PARAMS = G.SignalParams(swing_length=3, threshold=0.40)


def _features_sql() -> str:
    """The feature matrix as one statement over the tall table of series."""
    from tapeline.catalog.signal_queries import L as SL
    from tapeline.catalog.signal_queries import _state, _tall

    us = {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
    at = {tf: f"make_timestamp((epoch_us(d.ts) // {n * 1000000}) * {n * 1000000})" for tf, n in us.items()}
    side = lambda tf, a: f"LEFT JOIN full_state {a} ON {a}.symbol = d.sym || '|{tf}' AND {a}.ts = {at[tf]}"
    gap_level = "CASE WHEN z.gap > 0 THEN z.gap_bottom ELSE z.gap_top END"
    ob_level = "CASE WHEN z.ob > 0 THEN z.ob_bottom ELSE z.ob_top END"
    liq_level = "z.swing_level * (CASE WHEN z.swing < 0 THEN 1 - 0.005::DOUBLE ELSE 1 + 0.005::DOUBLE END)"
    alive = lambda kind, sign: (
        f"least((SELECT count(*) FROM life l WHERE l.kind = '{kind}' AND l.symbol = s.symbol AND l.sign {sign} 0 AND l.bar_idx <= s.bar_idx"
        " AND (l.e IS NULL OR l.e > s.bar_idx)) / 5.0::DOUBLE, 1)"
    )
    recent = lambda src, sign, extra: (
        f"EXISTS (SELECT 1 FROM {src} z WHERE z.symbol = s.symbol AND z.sign {sign} 0 AND z.bar_idx BETWEEN s.bar_idx - 6 AND s.bar_idx{extra})"
    )
    ready = f"n_bars >= {2 * SL}"
    import re

    parts = [
        TICKS, *_tall(), *_state()[:8], _MOVES, _ema_cte({"ema20": 20, "ema50": 50}),
        """seed AS (SELECT symbol, avg(gain) FILTER (bar_idx BETWEEN 1 AND 14) AS g, avg(loss) FILTER (bar_idx BETWEEN 1 AND 14) AS l,
           avg(tr) FILTER (bar_idx <= 13) AS t FROM moves GROUP BY symbol),
rec AS (SELECT m.symbol, m.bar_idx, s.g, s.l, (s.t * 13 + m.tr) / 14 AS t FROM moves m JOIN seed s USING (symbol) WHERE m.bar_idx = 14
  UNION ALL SELECT m.symbol, m.bar_idx, (r.g * 13 + m.gain) / 14, (r.l * 13 + m.loss) / 14, (r.t * 13 + m.tr) / 14
  FROM rec r JOIN moves m ON m.symbol = r.symbol AND m.bar_idx = r.bar_idx + 1)""",
        "m1h AS (SELECT * FROM moves WHERE tf = '1h')", re.sub(r"\brec\b", "arec", ADX_TRAINING.format(m="m1h")),
        f"""life AS MATERIALIZED (
  SELECT 'fvg' AS kind, symbol, bar_idx, gap AS sign, {touch_sql('z.gap > 0', gap_level, '<=')} AS e FROM gaps z WHERE gap IS NOT NULL AND {ready}
  UNION ALL SELECT 'ob', symbol, bar_idx, ob, {touch_sql('z.ob > 0', ob_level, '<')} FROM obs z
  UNION ALL SELECT 'liq', symbol, bar_idx, swing, CASE WHEN {touch_sql('z.swing < 0', liq_level, '<')} IS NOT NULL THEN greatest(z.bar_idx, 1) END FROM swung z WHERE swing IS NOT NULL)""",
        "unmit AS (SELECT * FROM life WHERE kind <> 'liq' AND e IS NULL)",
        f"""full_state AS MATERIALIZED (
  SELECT s.*, split_part(s.symbol, '|', 2) AS tf, split_part(s.symbol, '|', 1) AS sym, m.mid,
    CASE WHEN s.close > 0 THEN (s.close - e.ema20) / s.close ELSE 0 END AS d20, CASE WHEN s.close > 0 THEN (s.close - e.ema50) / s.close ELSE 0 END AS d50,
    CASE WHEN s.close > 0 THEN coalesce(r.t, sd.t) / s.close ELSE 0 END AS atrn,
    CASE WHEN r.bar_idx IS NULL OR r.bar_idx = 14 THEN 50 WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END / 100 AS rsin, x.adx,
    {recent('zones', '>', '')} AS pu, {recent('zones', '<', '')} AS pd, {recent('unmit', '>', '')} AS zu, {recent('unmit', '<', '')} AS zd,
    {alive('fvg', '>')} AS fb, {alive('fvg', '<')} AS fs, {alive('ob', '>')} AS ob_u, {alive('ob', '<')} AS ob_d, {alive('liq', '>')} AS la, {alive('liq', '<')} AS lb
  FROM structure s JOIN mids m ON m.symbol = s.symbol AND m.bar_idx = s.bar_idx JOIN emas e ON e.symbol = s.symbol AND e.bar_idx = s.bar_idx
  JOIN seed sd ON sd.symbol = s.symbol LEFT JOIN rec r ON r.symbol = s.symbol AND r.bar_idx = s.bar_idx LEFT JOIN adxt x ON x.symbol = s.symbol AND x.bar_idx = s.bar_idx)""",
        f"""f AS (SELECT d.*, coalesce(lag(d.structure) OVER o, 0) AS s5, coalesce(lag(d.decay) OVER o, 0) AS k5,
    max(CASE WHEN d.break_sign > 0 THEN 1 ELSE 0 END) OVER t = 1 AS tu, max(CASE WHEN d.break_sign < 0 THEN 1 ELSE 0 END) OVER t = 1 AS td,
    CASE WHEN count(*) OVER v >= 5 AND avg(d.volume) OVER v > 0 THEN least(d.volume / avg(d.volume) OVER v, 5) ELSE 1 END AS vr,
    d.bar_idx >= 20 AND coalesce(avg(d.volume) OVER q > 0 AND d.volume >= avg(d.volume) OVER q * 1.2::DOUBLE, false) AS vok
  FROM full_state d WHERE d.tf = '5m' WINDOW o AS (PARTITION BY d.symbol ORDER BY d.bar_idx), t AS (PARTITION BY d.symbol ORDER BY d.bar_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
    v AS (PARTITION BY d.symbol ORDER BY d.bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), q AS (PARTITION BY d.symbol ORDER BY d.bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
        f"""j AS (SELECT d.sym, d.ts, d.close, d.s5, d.k5, d.tu, d.td, d.vr, d.vok, d.d20, d.d50, d.atrn, d.rsin,
    coalesce(x1.structure, 0) AS b, x1.decay AS k1d, coalesce(x1.strong, false) AS strong, x1.atrn AS atrd,
    coalesce(x4.structure, 0) AS s4, x4.decay AS k4, coalesce(x4.pu, false) AS pu, coalesce(x4.pd, false) AS pd, x4.mid,
    coalesce(xh.structure, 0) AS s1, xh.decay AS k1, coalesce(xh.after_choch, false) AS choch, xh.d20 AS h20, xh.d50 AS h50, xh.atrn AS atrh, xh.rsin AS rsih, xh.adx, xh.n_bars AS n1, xh.la, xh.lb,
    coalesce(xq.structure, 0) AS sq, xq.decay AS kq, coalesce(xq.zu, false) AS zu, coalesce(xq.zd, false) AS zd, xq.fb, xq.fs, xq.ob_u, xq.ob_d
  FROM f d {side('1d', 'x1')} {side('4h', 'x4')} {side('1h', 'xh')} {side('15m', 'xq')})""",
        """g AS (SELECT *, (b > 0 AND s4 > 0) OR (b < 0 AND s4 < 0) AS h4, (b > 0 AND pu) OR (b < 0 AND pd) AS poi, (b > 0 AND s1 > 0) OR (b < 0 AND s1 < 0) AS h1,
    (b > 0 AND zu) OR (b < 0 AND zd) AS zone, (b > 0 AND tu) OR (b < 0 AND td) AS trig FROM j)""",
        """trh AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM b1h WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
prof AS (SELECT symbol, sum(tr / close) / count(*) AS v, sum(close * volume) / count(*) AS u, (max(high) - min(low)) / (sum(close) / count(*)) AS sp FROM trh WHERE close > 0 GROUP BY symbol),
rk AS (SELECT symbol, CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (row_number() OVER (ORDER BY v, symbol) - 1) / (count(*) OVER () - 1) END AS vr_, CASE WHEN count(*) OVER () = 1 THEN 0.5
  ELSE (row_number() OVER (ORDER BY u, symbol) - 1) / (count(*) OVER () - 1) END AS lr_,
  CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (row_number() OVER (ORDER BY sp, symbol) - 1) / (count(*) OVER () - 1) END AS sr_ FROM prof)""",
    ]
    exprs = {
        "struct_1d": "b", "struct_4h": "s4", "struct_1h": "s1", "struct_15m": "sq", "struct_5m": "s5", "decay_1d": "coalesce(k1d, 0)", "decay_4h": "coalesce(k4, 0)",
        "decay_1h": "coalesce(k1, 0)", "decay_15m": "coalesce(kq, 0)", "decay_5m": "k5", "bias_strong": "strong::INT",
        "premium_discount": "CASE WHEN close > mid THEN 1 WHEN close < mid THEN -1 ELSE 0 END", "daily_bias": "b", "h4_confirms": "h4::INT", "h4_poi": "poi::INT",
        "h1_confirms": "h1::INT", "h1_choch": "choch::INT", "has_entry_zone": "zone::INT", "precision_trigger": "trig::INT", "volume_ok": "vok::INT",
        "ema20_dist_5m": "d20", "ema50_dist_5m": "d50", "ema20_dist_1h": "CASE WHEN n1 > 50 THEN h20 ELSE 0 END", "ema50_dist_1h": "CASE WHEN n1 > 50 THEN h50 ELSE 0 END",
        "atr_5m_norm": "atrn", "atr_1h_norm": "atrh", "atr_daily_norm": "atrd", "rsi_5m": "rsin", "rsi_1h": "rsih", "volume_ratio": "vr",
        "adx_1h": "CASE WHEN n1 > 30 THEN least(adx / 50, 2) ELSE 0.5 END",
        "alignment_score": "(b <> 0)::INT * 0.12::DOUBLE + (b <> 0 AND strong)::INT * 0.08::DOUBLE + h4::INT * 0.08::DOUBLE + poi::INT * 0.08::DOUBLE + h1::INT * 0.08::DOUBLE"
        " + (h1 AND choch)::INT * 0.06::DOUBLE + zone::INT * 0.15::DOUBLE + trig::INT * 0.15::DOUBLE + vok::INT * 0.10::DOUBLE",
        "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)", "fvg_bull_active": "fb", "fvg_bear_active": "fs", "ob_bull_active": "ob_u",
        "ob_bear_active": "ob_d", "liq_above_count": "la", "liq_below_count": "lb", "symbol_volatility_rank": "coalesce(vr_, 0.5)", "symbol_liquidity_rank": "coalesce(lr_, 0.5)", "symbol_spread_rank": "coalesce(sr_, 0.5)",
    }
    return "WITH RECURSIVE " + ",\n".join(parts) + " SELECT sym AS symbol, ts, " + ", ".join(f"{R(x)} AS {n}" for n, x in exprs.items()) + " FROM g LEFT JOIN rk ON rk.symbol = g.sym"


@query("feature_matrix", _features_sql())
def feature_matrix(spark, sf):
    base = materialize(B.bars_from_ticks(T.ticks(spark, sf), "5m"))
    f = E.feature_matrix(base, PARAMS)
    ranks = M.symbol_profile(T.bars(spark, sf))
    return E.with_symbol_ranks(f, ranks).select("symbol", "ts", *[r(c).alias(c) for c in E.FEATURES])


@query("training_set")
def training_set(spark, sf):
    base = materialize(B.bars_from_ticks(T.ticks(spark, sf), "5m"))
    out = E.training_set(base, PARAMS, 96, 50)
    labels = ["label_rr", "label_max_favorable_rr", "label_mae_rr", "label_tp_rr", "optimal_sl_rr", "optimal_tp_rr", "optimal_size"]
    return out.select("symbol", "ts", "label_action", "label_outcome", "label_exit_mechanism", "label_exit_bar", "optimal_entry",
                      r("alignment_score").alias("alignment_score"), *[r(c).alias(c) for c in labels])
