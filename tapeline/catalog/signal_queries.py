"""Signals over several timeframes: scores, funnel, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import (
    TICKS, bars_cte, breaks_cte, gaps_cte, order_blocks_cte, structure_cte, swings_cte, with_,
)
from tapeline.catalog.registry import R, query, r
from tapeline.functions import scores
from tapeline.operators import structure as S
from tapeline.operators.bars import bars_from_ticks
from tapeline.operators.blocks import framed
from tapeline.plans import signals as G
from tapeline.session import materialize
from tapeline.sources import tables as T

P = G.SignalParams(swing_length=3, threshold=0.40)
L = P.swing_length
TFS = ["5m", "15m", "1h", "4h", "1d"]


def _tall():
    parts = [bars_cte(tf, "b" + tf) for tf in TFS]
    union = " UNION ALL ".join(f"SELECT * REPLACE (symbol || '|{tf}' AS symbol), symbol AS sym, '{tf}' AS tf FROM b{tf}" for tf in TFS)
    return [*parts, f"bars AS MATERIALIZED ({union})"]


def _state():
    us = {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
    at = {tf: f"make_timestamp((epoch_us(d.ts) // {s * 1000000}) * {s * 1000000})" for tf, s in us.items()}
    run = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [
        swings_cte(L), f"swung_ok AS (SELECT * FROM swung WHERE n_bars >= {2 * L})", breaks_cte("swung_ok").replace(
            "breaks AS (", "breaks AS MATERIALIZED ("), gaps_cte(), order_blocks_cte(), structure_cte(),
        f"""zones AS MATERIALIZED (
  SELECT symbol, bar_idx, 'fvg' AS type, gap AS sign, gap_top AS top, gap_bottom AS bottom FROM gaps WHERE gap IS NOT NULL AND n_bars >= {2 * L}
  UNION ALL SELECT symbol, bar_idx, 'ob', ob, ob_top, ob_bottom FROM obs)""",
        f"""mids AS (SELECT symbol, bar_idx, CASE WHEN sh > sl THEN (sh + sl) / 2 END AS mid FROM (
  SELECT symbol, bar_idx, last_value(CASE WHEN swing = 1 THEN swing_level END IGNORE NULLS) OVER {run} AS sh,
         last_value(CASE WHEN swing = -1 THEN swing_level END IGNORE NULLS) OVER {run} AS sl FROM swung))""",
        f"""state AS MATERIALIZED (
  SELECT s.*, m.mid, EXISTS (SELECT 1 FROM zones z WHERE z.symbol = s.symbol AND z.sign > 0 AND z.bar_idx BETWEEN s.bar_idx - 5 AND s.bar_idx) AS poi_up,
         EXISTS (SELECT 1 FROM zones z WHERE z.symbol = s.symbol AND z.sign < 0 AND z.bar_idx BETWEEN s.bar_idx - 5 AND s.bar_idx) AS poi_dn
  FROM structure s JOIN mids m ON m.symbol = s.symbol AND m.bar_idx = s.bar_idx)""",
        f"""dec AS MATERIALIZED (
  SELECT split_part(d.symbol, '|', 1) AS sym, d.ts, d.bar_idx, d.close AS entry, d1.structure AS bias, d1.strong AS bias_strong,
    CASE WHEN d1.structure > 0 THEN 1 ELSE -1 END AS direction, h1.structure AS s1h, h1.after_choch AS choch1h, h1.bar_idx AS idx_1h,
    h4.structure AS s4h, h4.poi_up, h4.poi_dn, h4.mid, h4.bar_idx AS idx_4h, q.symbol AS s15, q.bar_idx AS i15, q.close AS p15,
    d.bar_idx >= 4 AND coalesce(avg(d.volume) OVER v > 0 AND d.volume >= avg(d.volume) OVER v * 1.2::DOUBLE, false) AS volume_ok,
    max(CASE WHEN d.break_sign > 0 THEN 1 ELSE 0 END) OVER t = 1 AS trig_up, max(CASE WHEN d.break_sign < 0 THEN 1 ELSE 0 END) OVER t = 1 AS trig_dn,
    min(d.low) OVER x AS low21, max(d.high) OVER x AS high21
  FROM (SELECT * FROM state WHERE symbol LIKE '%|5m') d
  JOIN state d1 ON d1.symbol = split_part(d.symbol, '|', 1) || '|1d' AND d1.ts = {at['1d']} AND d1.n_bars >= {2 * L}
  JOIN state h1 ON h1.symbol = split_part(d.symbol, '|', 1) || '|1h' AND h1.ts = {at['1h']} AND h1.n_bars >= {2 * L}
  LEFT JOIN state h4 ON h4.symbol = split_part(d.symbol, '|', 1) || '|4h' AND h4.ts = {at['4h']}
  LEFT JOIN state q ON q.symbol = split_part(d.symbol, '|', 1) || '|15m' AND q.ts = {at['15m']}
  WINDOW v AS (PARTITION BY d.symbol ORDER BY d.bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         t AS (PARTITION BY d.symbol ORDER BY d.bar_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
         x AS (PARTITION BY d.symbol ORDER BY d.bar_idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))""",
        """fits AS (
  SELECT d.sym, d.bar_idx, z.type, z.top, z.bottom, CASE WHEN z.type = 'fvg' THEN 1000 ELSE 0 END + z.bar_idx - d.i15 AS rk
  FROM dec d JOIN zones z ON z.symbol = d.s15 AND z.bar_idx BETWEEN d.i15 - 5 AND d.i15 AND z.sign = d.direction
  WHERE abs(z.top - z.bottom) > 0 AND d.p15 > 0 AND (z.type = 'ob' OR abs(z.top - z.bottom) / d.p15 >= 0.0004::DOUBLE)
    AND CASE WHEN z.sign > 0 THEN d.p15 - z.bottom ELSE z.top - d.p15 END / abs(z.top - z.bottom) >= 0.30::DOUBLE),
best AS (SELECT sym, bar_idx, arg_max(type, rk) AS zone_type, arg_max(top, rk) AS zone_top, arg_max(bottom, rk) AS zone_bottom
  FROM fits GROUP BY sym, bar_idx)""",
        """flags AS (
  SELECT d.*, b.zone_type, b.zone_top, b.zone_bottom, b.zone_type IS NOT NULL AS has_zone,
    CASE WHEN entry > mid THEN 1 WHEN entry < mid THEN -1 ELSE 0 END AS dp_zone,
    coalesce(s4h = direction, false) AS h4_ok, coalesce(CASE WHEN direction > 0 THEN poi_up ELSE poi_dn END, false) AS h4_poi,
    s1h = direction AS h1_ok, CASE WHEN direction > 0 THEN trig_up ELSE trig_dn END AS precision
  FROM dec d LEFT JOIN best b ON b.sym = d.sym AND b.bar_idx = d.bar_idx),
summed AS (SELECT *, (bias <> 0)::INT * 0.12::DOUBLE + (bias <> 0 AND bias_strong)::INT * 0.08::DOUBLE + h4_ok::INT * 0.08::DOUBLE
    + h4_poi::INT * 0.08::DOUBLE + h1_ok::INT * 0.08::DOUBLE + (h1_ok AND choch1h)::INT * 0.06::DOUBLE + has_zone::INT * 0.15::DOUBLE
    + precision::INT * 0.15::DOUBLE + volume_ok::INT * 0.10::DOUBLE AS s,
    bias_strong OR h4_ok OR h4_poi OR choch1h OR volume_ok AS detailed FROM flags)"""
        + f""",
scored AS MATERIALIZED (SELECT *, CASE WHEN bias = 0 THEN 'neutral' WHEN dp_zone = direction THEN 'premium_discount'
    WHEN round(score, 9) >= {P.threshold} THEN 'passed' WHEN NOT h1_ok THEN 'no_confirm' WHEN NOT has_zone THEN 'no_zone'
    WHEN NOT precision THEN 'no_trigger' ELSE 'low_score' END AS reason
  FROM (SELECT *, least(CASE WHEN NOT detailed AND s > 0 THEN least(s * 1.3::DOUBLE, 1) ELSE s END, 1) AS score FROM summed)
  WHERE bar_idx >= {2 * L})""",
    ]


SCORED = [TICKS, *_tall(), *_state()]


def scored(spark, sf):
    base = materialize(bars_from_ticks(T.ticks(spark, sf), "5m"))
    t = G.structure_tables(G.series_table(base), P)
    state = materialize(G.running_state(t, P))
    return G.scored_bars(t, state, P), t


@query(
    "signal_scored_bars",
    with_(*SCORED)
    + f"""SELECT sym AS symbol, ts, bias, bias_strong, h4_ok, h4_poi, h1_ok, choch1h, has_zone, precision, volume_ok, dp_zone,
    {R('score')} AS score, reason FROM scored""",
)
def signal_scored_bars(spark, sf):
    rows, _ = scored(spark, sf)
    return rows.select(F.col("sym").alias("symbol"), "ts", "bias", "bias_strong", "h4_ok", "h4_poi", "h1_ok", "choch1h",
                       "has_zone", "precision", "volume_ok", "dp_zone", r("score").alias("score"), "reason")


@query("signal_funnel", with_(*SCORED) + "SELECT reason, count(*) AS bars FROM scored GROUP BY reason")
def signal_funnel(spark, sf):
    return scored(spark, sf)[0].groupBy("reason").agg(F.count(F.lit(1)).alias("bars"))


NEAR = G.SignalParams(swing_length=L, threshold=0.60)


@query(
    "signal_near_misses",
    with_(*[c.replace(f"round(score, 9) >= {P.threshold}", f"round(score, 9) >= {NEAR.threshold}") for c in SCORED])
    + f"""SELECT reason, direction, count(*) AS bars, {R('avg(0.60::DOUBLE - round(score, 9))')} AS mean_gap, {R('max(score)')} AS best FROM scored
    WHERE reason IN ('no_confirm', 'no_zone', 'no_trigger', 'low_score') AND round(score, 9) >= 0.45::DOUBLE AND round(score, 9) < 0.60::DOUBLE GROUP BY ALL""",
)
def signal_near_misses(spark, sf):
    base = materialize(bars_from_ticks(T.ticks(spark, sf), "5m"))
    t = G.structure_tables(G.series_table(base), NEAR)
    rows = G.near_misses(G.scored_bars(t, materialize(G.running_state(t, NEAR)), NEAR), NEAR)
    return rows.groupBy("reason", "direction").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("gap")).alias("mean_gap"), r(F.max("score")).alias("best"))


def _liq(tf):
    return f"""coalesce(CASE WHEN c.direction > 0 THEN
      (SELECT min(z.high) FROM tops z WHERE z.symbol = c.sym || '|{tf}' AND z.bar_idx <= c.idx_{tf} AND z.top AND z.high > c.entry + c.stop_dist * 2
         AND NOT EXISTS (SELECT 1 FROM bars v WHERE v.symbol = z.symbol AND v.bar_idx > z.bar_idx AND v.bar_idx <= c.idx_{tf} AND v.high > z.high))
      ELSE (SELECT max(z.low) FROM tops z WHERE z.symbol = c.sym || '|{tf}' AND z.bar_idx <= c.idx_{tf} AND z.bottom AND z.low < c.entry - c.stop_dist * 2
         AND NOT EXISTS (SELECT 1 FROM bars v WHERE v.symbol = z.symbol AND v.bar_idx > z.bar_idx AND v.bar_idx <= c.idx_{tf} AND v.low < z.low)) END, 0)"""


def _fvg(tf):
    return f"""coalesce(CASE WHEN c.direction > 0 THEN
      (SELECT min(z.high) FROM tops z WHERE z.symbol = c.sym || '|{tf}' AND z.bar_idx <= c.idx_{tf} AND z.high < z.l2 AND z.high > c.entry + c.stop_dist * 2
         AND NOT EXISTS (SELECT 1 FROM bars v WHERE v.symbol = z.symbol AND v.bar_idx > z.bar_idx AND v.bar_idx <= c.idx_{tf} AND v.low <= z.l2))
      ELSE (SELECT max(z.low) FROM tops z WHERE z.symbol = c.sym || '|{tf}' AND z.bar_idx <= c.idx_{tf} AND z.low > z.h2 AND z.low < c.entry - c.stop_dist * 2
         AND NOT EXISTS (SELECT 1 FROM bars v WHERE v.symbol = z.symbol AND v.bar_idx > z.bar_idx AND v.bar_idx <= c.idx_{tf} AND v.high >= z.h2)) END, 0)"""


def _ob(tf):
    return f"""coalesce(CASE WHEN c.direction > 0 THEN
      (SELECT min(o.low) FROM tops z JOIN bars o ON o.symbol = z.symbol AND o.bar_idx = z.red10 WHERE z.symbol = c.sym || '|{tf}' AND z.bar_idx <= c.idx_{tf} AND z.top
         AND o.low > c.entry + c.stop_dist * 2
         AND NOT EXISTS (SELECT 1 FROM bars v WHERE v.symbol = z.symbol AND v.bar_idx > o.bar_idx AND v.bar_idx <= c.idx_{tf} AND v.low <= o.low))
      ELSE (SELECT max(o.high) FROM tops z JOIN bars o ON o.symbol = z.symbol AND o.bar_idx = z.green10 WHERE z.symbol = c.sym || '|{tf}' AND z.bar_idx <= c.idx_{tf} AND z.bottom
         AND o.high < c.entry - c.stop_dist * 2
         AND NOT EXISTS (SELECT 1 FROM bars v WHERE v.symbol = z.symbol AND v.bar_idx > o.bar_idx AND v.bar_idx <= c.idx_{tf} AND v.high >= o.high)) END, 0)"""


GENERATED = [
    *SCORED,
    """tops AS MATERIALIZED (SELECT symbol, bar_idx, high, low, top, bottom, lag(low, 2) OVER w AS l2, lag(high, 2) OVER w AS h2,
      max(CASE WHEN close < open THEN bar_idx END) OVER b AS red10, max(CASE WHEN close > open THEN bar_idx END) OVER b AS green10 FROM swung
      WHERE symbol LIKE '%|4h' OR symbol LIKE '%|1h'
      WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx), b AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""",
    """cand AS (SELECT *, abs(entry - stop) AS stop_dist FROM (SELECT *, CASE WHEN has_zone
       THEN CASE WHEN direction > 0 THEN zone_bottom * (1 - 0.005::DOUBLE) ELSE zone_top * (1 + 0.005::DOUBLE) END
       ELSE CASE WHEN direction > 0 THEN low21 * (1 - 0.005::DOUBLE) ELSE high21 * (1 + 0.005::DOUBLE) END END AS stop
       FROM scored WHERE reason = 'passed' AND entry > 0) WHERE abs(entry - stop) / entry >= 0.0035)""",
    "lv AS (SELECT c.*, " + ", ".join(
        f"{fn(tf)} AS {n}_{tf}" for fn, n in ((_liq, "liq"), (_fvg, "fvg"), (_ob, "ob")) for tf in ("4h", "1h")) + " FROM cand c)",
    """tp AS (SELECT *, CASE WHEN liq_4h > 0 THEN 'liq_4h' WHEN liq_1h > 0 THEN 'liq_1h' WHEN fvg_4h > 0 THEN 'fvg_4h' WHEN fvg_1h > 0 THEN 'fvg_1h'
       WHEN ob_4h > 0 THEN 'ob_4h' WHEN ob_1h > 0 THEN 'ob_1h' ELSE 'fallback' END AS tp_source,
       CASE WHEN liq_4h > 0 THEN liq_4h WHEN liq_1h > 0 THEN liq_1h WHEN fvg_4h > 0 THEN fvg_4h WHEN fvg_1h > 0 THEN fvg_1h
       WHEN ob_4h > 0 THEN ob_4h WHEN ob_1h > 0 THEN ob_1h ELSE entry + direction * stop_dist * 3 END AS target FROM lv)""",
    """sized AS (SELECT *, abs(target - entry) / stop_dist AS risk_reward, CASE WHEN entry <= 0 OR stop <= 0 THEN 0 ELSE
       CASE WHEN 500 / (stop_dist / entry) / 10 > 100000 THEN 1000000 ELSE 500 / (stop_dist / entry) END / entry END AS position_size FROM tp)""",
]


@query(
    "signals_generated",
    with_(*GENERATED)
    + f"""SELECT sym AS symbol, ts, direction, {R('entry')} AS entry, {R('stop')} AS stop, {R('target')} AS target, {R('risk_reward')} AS risk_reward,
    {R('position_size')} AS position_size, {R('score')} AS score, zone_type, tp_source FROM sized WHERE risk_reward >= 2.0 AND position_size > 0""",
)
def signals_generated(spark, sf):
    base = materialize(bars_from_ticks(T.ticks(spark, sf), "5m"))
    out = G.generate(base, P)
    return out.select(
        F.col("sym").alias("symbol"), "ts", "direction", *[r(c).alias(c) for c in ("entry", "stop", "target", "risk_reward", "position_size", "score")],
        "zone_type", "tp_source",
    )


@query("signal_target_sources", with_(*GENERATED) + "SELECT tp_source, count(*) AS signals, count(*) FILTER (direction > 0) AS longs FROM sized WHERE risk_reward >= 2.0 AND position_size > 0 GROUP BY tp_source")
def signal_target_sources(spark, sf):
    out = G.generate(materialize(bars_from_ticks(T.ticks(spark, sf), "5m")), P)
    return out.groupBy("tp_source").agg(F.count(F.lit(1)).alias("signals"), F.count_if(F.col("direction") > 0).alias("longs"))


def _bar_times(tf, us):
    return f"make_timestamp((epoch_us(d.ts) // {us}) * {us})"


# Every 15m bar as a candidate, with the coarse bars that closed before it; entry is the next open.
STRICT = [
    TICKS, *_tall(), swings_cte(L),
    f"""swings AS MATERIALIZED (SELECT * FROM swung WHERE symbol LIKE '%|4h' OR symbol LIKE '%|1h')""",
    """tops AS MATERIALIZED (SELECT symbol, bar_idx, ts, high, low, top, bottom, lag(low, 2) OVER w AS l2, lag(high, 2) OVER w AS h2, lead(ts) OVER w AS next_ts,
      max(CASE WHEN close < open THEN bar_idx END) OVER b AS red10, max(CASE WHEN close > open THEN bar_idx END) OVER b AS green10 FROM swings
      WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx), b AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""",
    """levels AS (
      SELECT symbol, 'liq' AS kind, 1 AS side, bar_idx AS known, bar_idx AS at, high AS price, high AS edge FROM tops WHERE top
      UNION ALL SELECT symbol, 'liq', -1, bar_idx, bar_idx, low, low FROM tops WHERE bottom
      UNION ALL SELECT symbol, 'fvg', 1, bar_idx, bar_idx, high, l2 FROM tops WHERE high < l2
      UNION ALL SELECT symbol, 'fvg', -1, bar_idx, bar_idx, low, h2 FROM tops WHERE low > h2
      UNION ALL SELECT z.symbol, 'ob', 1, z.bar_idx, o.bar_idx, o.low, o.low FROM tops z JOIN tops o ON o.symbol = z.symbol AND o.bar_idx = z.red10 WHERE z.top
      UNION ALL SELECT z.symbol, 'ob', -1, z.bar_idx, o.bar_idx, o.high, o.high FROM tops z JOIN tops o ON o.symbol = z.symbol AND o.bar_idx = z.green10 WHERE z.bottom)""",
    """ended AS MATERIALIZED (SELECT z.symbol, z.kind, z.side, z.known, z.price, min(v.bar_idx) AS gone FROM levels z LEFT JOIN tops v ON v.symbol = z.symbol AND v.bar_idx > z.at
      AND CASE WHEN z.kind = 'liq' THEN CASE WHEN z.side > 0 THEN v.high > z.edge ELSE v.low < z.edge END ELSE CASE WHEN z.side > 0 THEN v.low <= z.edge ELSE v.high >= z.edge END END
      GROUP BY z.symbol, z.kind, z.side, z.known, z.at, z.price)""",
    f"""cand AS MATERIALIZED (SELECT split_part(d.symbol, '|', 1) AS sym, d.ts, d.entry, d.direction, d.entry * (0.0035::DOUBLE * (1 + 25 * (d.bar_idx % 3))) AS stop_dist, h4.bar_idx AS idx_4h, h1.bar_idx AS idx_1h
      FROM (SELECT symbol, ts, bar_idx, lead(open) OVER (PARTITION BY symbol ORDER BY bar_idx) AS entry, CASE WHEN close >= open THEN 1 ELSE -1 END AS direction FROM bars WHERE symbol LIKE '%|15m') d
      JOIN tops h4 ON h4.symbol = split_part(d.symbol, '|', 1) || '|4h' AND h4.next_ts = {_bar_times('4h', 14400000000)}
      JOIN tops h1 ON h1.symbol = split_part(d.symbol, '|', 1) || '|1h' AND h1.next_ts = {_bar_times('1h', 3600000000)} WHERE d.entry IS NOT NULL)""",
    *[f"""n{tf} AS (SELECT c.sym, c.ts, z.kind, CASE WHEN c.direction > 0 THEN min(z.price) ELSE max(z.price) END AS price FROM cand c JOIN ended z ON z.symbol = c.sym || '|{tf}'
      AND z.side = c.direction AND z.known <= c.idx_{tf} AND (z.gone IS NULL OR z.gone > c.idx_{tf})
      AND CASE WHEN c.direction > 0 THEN z.price > c.entry + c.stop_dist * 2 ELSE z.price < c.entry - c.stop_dist * 2 END GROUP BY c.sym, c.ts, c.direction, z.kind)""" for tf in ("4h", "1h")],
    """every AS (SELECT sym, ts, kind || '_4h' AS source, price, CASE kind WHEN 'liq' THEN 0 WHEN 'fvg' THEN 2 ELSE 4 END AS rk FROM n4h WHERE price > 0
      UNION ALL SELECT sym, ts, kind || '_1h', price, CASE kind WHEN 'liq' THEN 1 WHEN 'fvg' THEN 3 ELSE 5 END FROM n1h WHERE price > 0)""",
]


@query(
    "signal_strict_targets",
    with_(*STRICT)
    + f"""SELECT c.sym AS symbol, c.ts, c.direction, coalesce(arg_min(e.source, e.rk), 'fallback') AS tp_source,
    {R('coalesce(arg_min(e.price, e.rk), c.entry + c.direction * c.stop_dist * 3)')} AS target
    FROM cand c LEFT JOIN every e ON e.sym = c.sym AND e.ts = c.ts GROUP BY c.sym, c.ts, c.direction, c.entry, c.stop_dist""",
)
def signal_strict_targets(spark, sf):
    """Targets of every 15m bar that enters at the next open, from the coarse bars closed before it."""
    strict = G.SignalParams(swing_length=L, strict=True)
    series = G.series_table(materialize(bars_from_ticks(T.ticks(spark, sf), "5m")))
    t = {"bars": series, "swings": materialize(S.swings(series, L))}
    entry = framed(series.filter("tf = '15m'"), ["symbol"], lambda w: {"entry": F.lead("open").over(w)}, after=1).filter("entry is not null")
    rows = entry.select("sym", "ts", "entry", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("direction"), (F.col("entry") * (0.0035 * (1 + 25 * (F.col("bar_idx") % 3)))).alias("stop_dist"))
    for tf in ("4h", "1h"):
        rows = G.attach(rows, series, tf, {"bar_idx": f"idx_{tf}"}, strict, "inner")
    out = G.structure_target(materialize(rows), t, strict)
    return out.select(F.col("sym").alias("symbol"), "ts", "direction", "tp_source", r("target").alias("target"))


@query(
    "signal_session_scores",
    f"""WITH t AS (SELECT event_type AS symbol, (['crypto', 'forex', 'stocks', 'commodities'])[(user_id % 4 + 1)::INT] AS asset_class, hour(ts) AS h FROM events),
    s(asset_class, a, b, score) AS (VALUES {', '.join(f"('{c}', {x}, {y}, {v}::DOUBLE)" for c, spans in scores.SESSIONS.items() for x, y, v in spans)})
    SELECT t.asset_class, h AS hour, coalesce(s.score, CASE WHEN t.asset_class = 'stocks' THEN 0 ELSE 0.3 END) AS session_score,
    coalesce(s.score, 0) >= 0.5 AS tradeable, count(*) AS ticks
    FROM t LEFT JOIN s ON s.asset_class = t.asset_class AND h >= a AND h < b GROUP BY ALL""",
)
def signal_session_scores(spark, sf):
    ev = T.table(spark, sf, "events").select(T.class_of(F.col("user_id")).alias("asset_class"), F.hour("ts").alias("hour"))
    g = ev.groupBy("asset_class", "hour").agg(F.count(F.lit(1)).alias("ticks"))
    score = scores.session_score(F.col("asset_class"), F.col("hour"))
    return g.select("asset_class", F.col("hour").cast("long").alias("hour"), score.alias("session_score"), (score >= 0.5).alias("tradeable"), "ticks")
