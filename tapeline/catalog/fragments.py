"""Common table expressions shared by the SQL twins."""

from __future__ import annotations

from tapeline.operators.bars import TIMEFRAMES

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS volume FROM events)"""


def bars_cte(tf: str = "1h", name: str = "bars") -> str:
    us = TIMEFRAMES[tf] * 1_000_000
    return f"""{name} AS (
  SELECT symbol, ts, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx,
         count(*) OVER (PARTITION BY symbol) AS n_bars
  FROM (SELECT symbol, make_timestamp((epoch_us(ts) // {us}) * {us}) AS ts,
               first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY ts, seq) AS close, sum(volume) AS volume
        FROM ticks GROUP BY ALL))"""


def swings_cte(length: int, src: str = "bars", name: str = "swung") -> str:
    w = f"(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
    return f"""{name} AS (
  SELECT *, CASE WHEN top THEN 1 WHEN bottom THEN -1 END AS swing,
         CASE WHEN top THEN high WHEN bottom THEN low END AS swing_level
  FROM (SELECT *, coalesce(bar_idx >= {length} AND high >= max(high) OVER {w}, false) AS top,
               coalesce(bar_idx >= {length} AND low <= min(low) OVER {w}, false) AS bottom FROM {src}))"""


def breaks_cte(src: str = "swung", name: str = "breaks") -> str:
    w = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{name}_seen AS (
  SELECT *, max(CASE WHEN swing = 1 THEN bar_idx END) OVER {w} AS high_idx,
         max(CASE WHEN swing = -1 THEN bar_idx END) OVER {w} AS low_idx FROM {src}),
{name}_lvl AS (
  SELECT s.*, h.swing_level AS high_lvl, l.swing_level AS low_lvl FROM {name}_seen s
  LEFT JOIN {src} h ON h.symbol = s.symbol AND h.bar_idx = s.high_idx
  LEFT JOIN {src} l ON l.symbol = s.symbol AND l.bar_idx = s.low_idx),
{name}_up AS (
  SELECT symbol, min(bar_idx) AS bar_idx, min(ts) AS ts, 1 AS sign, min(high_lvl) AS level, high_idx AS broken_idx
  FROM {name}_lvl WHERE high > high_lvl GROUP BY symbol, high_idx),
{name}_down AS (
  SELECT symbol, min(bar_idx) AS bar_idx, min(ts) AS ts, -1 AS sign, min(low_lvl) AS level, low_idx AS broken_idx
  FROM {name}_lvl b WHERE low < low_lvl
    AND NOT EXISTS (SELECT 1 FROM {name}_up u WHERE u.symbol = b.symbol AND u.bar_idx = b.bar_idx)
  GROUP BY symbol, low_idx),
{name} AS (
  SELECT symbol, ts, bar_idx, sign,
         CASE WHEN lag(sign) OVER (PARTITION BY symbol ORDER BY bar_idx) = sign THEN 'BOS' ELSE 'CHOCH' END AS kind,
         level, broken_idx
  FROM (SELECT * FROM {name}_up UNION ALL SELECT * FROM {name}_down))"""


def gaps_cte(src: str = "bars", name: str = "gaps") -> str:
    w = "(PARTITION BY symbol ORDER BY bar_idx)"
    return f"""{name} AS (
  SELECT *, CASE WHEN h2 < low AND b1 > 0 THEN 1 WHEN l2 > high AND b1 < 0 THEN -1 END AS gap,
         CASE WHEN h2 < low AND b1 > 0 THEN low WHEN l2 > high AND b1 < 0 THEN l2 END AS gap_top,
         CASE WHEN h2 < low AND b1 > 0 THEN h2 WHEN l2 > high AND b1 < 0 THEN high END AS gap_bottom
  FROM (SELECT *, lag(high, 2) OVER {w} AS h2, lag(low, 2) OVER {w} AS l2,
               lag(close) OVER {w} - lag(open) OVER {w} AS b1 FROM {src}))"""


def order_blocks_cte(bars: str = "bars", breaks: str = "breaks", name: str = "obs") -> str:
    return f"""{name}_named AS (
  SELECT k.symbol, k.sign AS ob, k.bar_idx AS confirmed_idx,
         (SELECT max(b.bar_idx) FROM {bars} b WHERE b.symbol = k.symbol
            AND b.bar_idx BETWEEN k.bar_idx - 19 AND k.bar_idx - 1
            AND ((k.sign > 0 AND b.close < b.open) OR (k.sign < 0 AND b.close > b.open))) AS origin
  FROM {breaks} k),
{name} AS (
  SELECT n.symbol, b.ts, b.bar_idx, n.ob, b.high::FLOAT::DOUBLE AS ob_top, b.low::FLOAT::DOUBLE AS ob_bottom,
         b.volume::FLOAT::DOUBLE AS ob_volume,
         (CASE WHEN b.high - b.low > 0 THEN abs(b.close - b.open) / (b.high - b.low) * 100 ELSE 0 END)::FLOAT::DOUBLE
           AS ob_percentage,
         n.confirmed_idx
  FROM (SELECT symbol, ob, origin, min(confirmed_idx) AS confirmed_idx FROM {name}_named
        WHERE origin IS NOT NULL GROUP BY symbol, ob, origin) n
  JOIN {bars} b ON b.symbol = n.symbol AND b.bar_idx = n.origin)"""


def touch_sql(down: str, level: str, op: str, start: str = "z.bar_idx", bars: str = "bars") -> str:
    """Scalar subquery: first bar >= start reaching the level of row ``z``."""
    up_op = {"<": ">", "<=": ">="}[op]
    return f"""(SELECT min(t.bar_idx) FROM {bars} t WHERE t.symbol = z.symbol AND t.bar_idx >= {start}
       AND (({down} AND t.low {op} {level}) OR (NOT ({down}) AND t.high {up_op} {level})))"""


def structure_cte(bars: str = "bars", breaks: str = "breaks", name: str = "structure") -> str:
    """Running structure per bar."""
    w = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{name} AS (
  SELECT x.symbol, x.ts, x.bar_idx, x.open, x.high, x.low, x.close, x.volume, x.n_bars,
         coalesce(k.sign, 0) AS structure, k.sign IS NOT NULL AS strong, coalesce(k.kind = 'CHOCH', false) AS after_choch,
         exp(-0.05 * coalesce(x.bar_idx - x.at, 100)) AS decay, coalesce(x.sign, 0) AS break_sign
  FROM (SELECT b.*, e.sign, max(CASE WHEN e.sign IS NOT NULL THEN b.bar_idx END) OVER
          (PARTITION BY b.symbol ORDER BY b.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at
        FROM {bars} b LEFT JOIN {breaks} e ON e.symbol = b.symbol AND e.bar_idx = b.bar_idx) x
  LEFT JOIN {breaks} k ON k.symbol = x.symbol AND k.bar_idx = x.at)"""


TRADES = """trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id,
         'S' || l_suppkey AS symbol,
         (['crypto', 'forex', 'stocks', 'commodities'])[(l_suppkey % 4 + 1)::INT] AS asset_class,
         CASE WHEN l_linenumber % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
         substr(o_orderpriority, 1, 1)::INT AS style_id,
         least(o_orderdate, l_shipdate) AS entry_time,
         CASE WHEN o_orderstatus <> 'O' THEN greatest(o_orderdate, l_shipdate) END AS exit_time,
         l_extendedprice / l_quantity AS entry_price,
         CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN edge > 0 THEN 'win' WHEN edge < 0 THEN 'loss' ELSE 'breakeven' END END
           AS outcome,
         CASE WHEN o_orderstatus <> 'O' THEN round(l_extendedprice * edge, 4) END AS pnl,
         CASE WHEN o_orderstatus <> 'O' THEN edge END AS pnl_pct,
         1 + l_quantity / 10 AS rr_target,
         CASE WHEN o_orderstatus <> 'O' THEN edge * 40 END AS rr_actual,
         round(l_tax / 10 + 0.002, 4) AS risk_pct,
         round(0.5 + l_quantity / 100, 4) AS score,
         l_linenumber AS leverage, l_quantity::INT AS bars_held, l_linenumber % 3 = 0 AS be_triggered
  FROM (SELECT *, round(l_discount - 0.05, 2) + 0.0 AS edge FROM lineitem) JOIN orders ON l_orderkey = o_orderkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SAMPLES = """samples AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id, l_shipdate AS ts, (year(l_shipdate) - 1995)::INT AS "window",
         'S' || l_suppkey AS symbol, (['crypto', 'forex', 'stocks', 'commodities'])[(l_suppkey % 4 + 1)::INT] AS asset_class,
         l_linenumber % 3 AS label_action, CASE WHEN edge > 0 THEN 1 WHEN edge < 0 THEN 2 ELSE 3 END AS label_outcome,
         edge * 40 AS label_rr, l_quantity / 10 AS mfe, l_tax * 20 AS mae, 1 + l_quantity / 20 AS tp_rr, l_tax AS cost_rr,
         (l_partkey % 5)::INT AS mech, CASE WHEN l_partkey % 5 = 1 THEN l_quantity / 10 + 1 END AS post_tp,
         l_extendedprice / l_quantity / 1000 AS x_price, l_tax AS x_tax, l_quantity / 50 AS x_quantity
  FROM (SELECT *, round(l_discount - 0.05, 2) + 0.0 AS edge FROM lineitem))"""
