"""Bars, windows, price structure and smoothed indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeline.catalog.fragments import (
    TICKS, bars_cte, breaks_cte, gaps_cte, order_blocks_cte, structure_cte, swings_cte, touch_sql, with_,
)
from tapeline.catalog.registry import R, query, r
from tapeline.operators import bars as B
from tapeline.operators import recursive as X
from tapeline.operators import structure as S
from tapeline.session import materialize, shared_dir
from tapeline.sources import tables as T
from tapeline.sources.files import cluster_parameters

LENGTH = 5  # swing length of the registered queries
OHLCV = ["symbol", "ts", "open", "high", "low", "close", "volume"]
BARS = with_(TICKS, bars_cte("1h"))


def _resampled(tf):
    @query(f"bars_{tf}", with_(TICKS, bars_cte(tf)) + "SELECT symbol, ts, open, high, low, close, volume FROM bars")
    def run(spark, sf):
        return B.bars_from_ticks(T.ticks(spark, sf), tf).select(*OHLCV)


for _tf in B.TIMEFRAMES:
    _resampled(_tf)


@query(
    "bars_derived_timeframes",
    with_(TICKS, bars_cte("15m", "b15"), bars_cte("1h", "b1h"), bars_cte("4h", "b4h"), bars_cte("1d", "b1d"))
    + " UNION ALL ".join(
        f"SELECT '{tf}' AS tf, symbol, ts, open, high, low, close, volume FROM {t}"
        for tf, t in [("15m", "b15"), ("1h", "b1h"), ("4h", "b4h"), ("1d", "b1d")]
    ),
)
def bars_derived_timeframes(spark, sf):
    base = B.bars_from_ticks(T.ticks(spark, sf), "15m")
    return B.all_timeframes(materialize(base), "15m", ["1h", "4h", "1d"]).select("tf", *OHLCV)


@query("bars_numbered", BARS + "SELECT symbol, ts, bar_idx, n_bars, close FROM bars")
def bars_numbered(spark, sf):
    return T.bars(spark, sf).select("symbol", "ts", "bar_idx", "n_bars", "close")


@query(
    "swing_points",
    with_(TICKS, bars_cte(), swings_cte(LENGTH))
    + "SELECT symbol, ts, bar_idx, swing, swing_level FROM swung WHERE swing IS NOT NULL",
)
def swing_points(spark, sf):
    return S.swings(T.bars(spark, sf), LENGTH).filter("swing is not null").select(
        "symbol", "ts", "bar_idx", "swing", "swing_level"
    )


_SPAN = "(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(
    "swing_points_by_symbol",
    with_(TICKS, bars_cte("15m"), """own AS (SELECT *, CASE length(symbol) % 3 WHEN 0 THEN 5 WHEN 1 THEN 6 ELSE 8 END AS n FROM bars)""",
          "seen AS (SELECT *, CASE n " + " ".join(f"WHEN {n} THEN max(high) OVER {_SPAN.format(n=n)}" for n in (5, 6, 8)) + " END AS most, CASE n "
          + " ".join(f"WHEN {n} THEN min(low) OVER {_SPAN.format(n=n)}" for n in (5, 6, 8)) + " END AS least FROM own)")
    + """SELECT symbol, ts, n AS swing_length, CASE WHEN high >= most THEN 1 ELSE -1 END AS swing, CASE WHEN high >= most THEN high ELSE low END AS swing_level
    FROM seen WHERE bar_idx >= n AND (high >= most OR low <= least)""",
)
def swing_points_by_symbol(spark, sf):
    """Swings with the detector length of each symbol's cluster, read from a parameter file."""
    ticks = T.ticks(spark, sf)
    path = f"{shared_dir(spark)}/tapeline/clusters-{uuid.uuid4().hex}"
    symbols = ticks.select("symbol", (F.length("symbol") % 3).cast("string").alias("c")).distinct()
    lengths = F.create_map(*[x for c, n in (("0", 5.0), ("1", 6.0)) for x in (F.lit(c), F.struct(F.lit(n).alias("swing_length")))])
    symbols.agg(F.map_from_entries(F.collect_list(F.struct("symbol", "c"))).alias("symbol_to_cluster")).withColumn("clusters", lengths).write.json(path)
    own = cluster_parameters(spark, path, {"swing_length": 8.0}).select("symbol", F.col("swing_length").cast("int").alias("swing_length"))
    bars = materialize(B.numbered(B.bars_from_ticks(ticks, "15m")).join(own, "symbol"))
    return S.swings_by_symbol(bars).filter("swing is not null").select("symbol", "ts", "swing_length", "swing", "swing_level")


@query(
    "fair_value_gaps",
    with_(TICKS, bars_cte(), gaps_cte())
    + f"""SELECT symbol, ts, bar_idx, gap, gap_top, gap_bottom,
       {touch_sql("z.gap > 0", "CASE WHEN z.gap > 0 THEN z.gap_bottom ELSE z.gap_top END", "<=")} AS mitigated_idx
       FROM gaps z WHERE gap IS NOT NULL""",
)
def fair_value_gaps(spark, sf):
    bars = T.bars(spark, sf)
    return S.gap_mitigation(S.gaps(bars).filter("gap is not null"), bars).select(
        "symbol", "ts", "bar_idx", "gap", "gap_top", "gap_bottom", "mitigated_idx"
    )


BREAKS = with_(TICKS, bars_cte(), swings_cte(LENGTH), breaks_cte())


@query("structure_breaks", BREAKS + "SELECT * FROM breaks")
def structure_breaks(spark, sf):
    return S.breaks(S.swings(T.bars(spark, sf), LENGTH))


@query(
    "order_blocks",
    with_(TICKS, bars_cte(), swings_cte(LENGTH), breaks_cte(), order_blocks_cte())
    + f"""SELECT *, {touch_sql("z.ob > 0", "CASE WHEN z.ob > 0 THEN z.ob_bottom ELSE z.ob_top END", "<")}
       AS mitigated_idx FROM obs z""",
)
def order_blocks(spark, sf):
    bars = T.bars(spark, sf)
    broken = S.breaks(S.swings(bars, LENGTH))
    return S.order_block_mitigation(S.order_blocks(bars, broken), bars)


LIQ_LEVEL = "z.swing_level * (CASE WHEN z.swing < 0 THEN 1 - 0.005::DOUBLE ELSE 1 + 0.005::DOUBLE END)"


@query(
    "liquidity_sweeps",
    with_(TICKS, bars_cte(), swings_cte(LENGTH))
    + f"""SELECT symbol, ts, bar_idx, swing AS liquidity, swing_level AS level,
       {touch_sql("z.swing < 0", LIQ_LEVEL, "<")} AS end_idx FROM swung z WHERE swing IS NOT NULL""",
)
def liquidity_sweeps(spark, sf):
    bars = T.bars(spark, sf)
    return S.liquidity(S.swings(bars, LENGTH), bars).drop("swept")


@query(
    "running_structure",
    with_(TICKS, bars_cte(), swings_cte(LENGTH), breaks_cte(), structure_cte())
    + f"""SELECT symbol, ts, structure, strong, after_choch, {R('decay')} AS decay,
       max(CASE WHEN break_sign > 0 THEN 1 ELSE 0 END) OVER w = 1 AS bull_trigger,
       max(CASE WHEN break_sign < 0 THEN 1 ELSE 0 END) OVER w = 1 AS bear_trigger
       FROM structure WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
)
def running_structure(spark, sf):
    bars = T.bars(spark, sf)
    state = S.running_structure(bars, S.breaks(S.swings(bars, LENGTH)))
    flags = {"bull_trigger": F.col("break_sign") > 0, "bear_trigger": F.col("break_sign") < 0}
    return S.recent_flag(state, flags, 1).select(
        "symbol", "ts", "structure", "strong", "after_choch", r("decay").alias("decay"), "bull_trigger", "bear_trigger"
    )


def _ema_cte(spans, src="bars", name="emas", value="close"):
    first = ", ".join(f"{value} AS {o}" for o in spans)
    step = ", ".join(f"e.{o} + 2.0::DOUBLE / {s + 1} * (b.{value} - e.{o})" for o, s in spans.items())
    return f"""{name} AS (
  SELECT symbol, bar_idx, {first} FROM {src} WHERE bar_idx = 0
  UNION ALL
  SELECT b.symbol, b.bar_idx, {step} FROM {name} e JOIN {src} b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1)"""


@query(
    "ema_distance",
    "WITH RECURSIVE "
    + ",\n".join([TICKS, bars_cte(), _ema_cte({"ema20": 20, "ema50": 50})])
    + f"""SELECT b.symbol, b.ts, {R('ema20')} AS ema20, {R('ema50')} AS ema50,
       {R('CASE WHEN close > 0 THEN (close - ema20) / close ELSE 0 END')} AS ema20_dist,
       {R('CASE WHEN close > 0 THEN (close - ema50) / close ELSE 0 END')} AS ema50_dist
       FROM emas e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx""",
)
def ema_distance(spark, sf):
    rows = X.ema(T.bars(spark, sf), {"ema20": 20, "ema50": 50})
    dist = lambda e: F.when(F.col("close") > 0, (F.col("close") - F.col(e)) / F.col("close")).otherwise(0.0)
    return rows.select(
        "symbol", "ts", r("ema20").alias("ema20"), r("ema50").alias("ema50"),
        r(dist("ema20")).alias("ema20_dist"), r(dist("ema50")).alias("ema50_dist"),
    )


_MOVES = """moves AS (
  SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss,
         CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm
  FROM (SELECT *, coalesce(close - lag(close) OVER w, 0) AS d,
               coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr,
               coalesce(high - lag(high) OVER w, 0) AS up, coalesce(lag(low) OVER w - low, 0) AS down
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)))"""


@query(
    "wilder_rsi_atr",
    "WITH RECURSIVE "
    + ",\n".join([TICKS, bars_cte(), _MOVES, """
seed AS (SELECT symbol, avg(gain) FILTER (bar_idx BETWEEN 1 AND 14) AS g, avg(loss) FILTER (bar_idx BETWEEN 1 AND 14) AS l,
                avg(tr) FILTER (bar_idx <= 13) AS t FROM moves GROUP BY symbol),
rec AS (
  SELECT m.symbol, m.bar_idx, s.g, s.l, (s.t * 13 + m.tr) / 14 AS t FROM moves m JOIN seed s USING (symbol) WHERE m.bar_idx = 14
  UNION ALL
  SELECT m.symbol, m.bar_idx, (r.g * 13 + m.gain) / 14, (r.l * 13 + m.loss) / 14, (r.t * 13 + m.tr) / 14
  FROM rec r JOIN moves m ON m.symbol = r.symbol AND m.bar_idx = r.bar_idx + 1)"""])
    + f"""SELECT m.symbol, m.ts,
       {R('CASE WHEN r.bar_idx IS NULL OR r.bar_idx = 14 THEN 50 WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END')} AS rsi,
       {R('coalesce(r.t, s.t)')} AS atr
       FROM moves m JOIN seed s USING (symbol) LEFT JOIN rec r ON r.symbol = m.symbol AND r.bar_idx = m.bar_idx""",
)
def wilder_rsi_atr(spark, sf):
    return X.wilder(T.bars(spark, sf)).select("symbol", "ts", r("rsi").alias("rsi"), r("atr").alias("atr"))


@query(
    "adx_classic",
    "WITH RECURSIVE "
    + ",\n".join([TICKS, bars_cte(), _MOVES, """
seed AS (SELECT symbol, avg(tr) FILTER (bar_idx BETWEEN 1 AND 14) AS a, avg(pdm) FILTER (bar_idx BETWEEN 1 AND 14) AS p,
                avg(mdm) FILTER (bar_idx BETWEEN 1 AND 14) AS m FROM moves GROUP BY symbol),
rec AS (
  SELECT symbol, 14::BIGINT AS bar_idx, a, p, m FROM seed
  UNION ALL
  SELECT b.symbol, b.bar_idx, r.a - r.a / 14 + b.tr, r.p - r.p / 14 + b.pdm, r.m - r.m / 14 + b.mdm
  FROM rec r JOIN moves b ON b.symbol = r.symbol AND b.bar_idx = r.bar_idx + 1),
di AS (SELECT *, CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) ELSE 0 END AS dx
  FROM (SELECT *, CASE WHEN a > 0 THEN 100 * p / a ELSE 0 END AS pdi, CASE WHEN a > 0 THEN 100 * m / a ELSE 0 END AS mdi FROM rec)),
dx0 AS (SELECT symbol, avg(dx) AS x FROM di WHERE bar_idx BETWEEN 15 AND 28 GROUP BY symbol),
sm AS (
  SELECT symbol, 28::BIGINT AS bar_idx, x FROM dx0
  UNION ALL
  SELECT d.symbol, d.bar_idx, (s.x * 13 + d.dx) / 14 FROM sm s JOIN di d ON d.symbol = s.symbol AND d.bar_idx = s.bar_idx + 1)"""])
    + f"""SELECT b.symbol, b.ts, {R('coalesce(least(greatest(x, 0), 100), 0)')} AS adx,
       {R('CASE WHEN x IS NULL THEN 0 ELSE least(greatest(pdi, 0), 100) END')} AS plus_di,
       {R('CASE WHEN x IS NULL THEN 0 ELSE least(greatest(mdi, 0), 100) END')} AS minus_di
       FROM bars b LEFT JOIN sm ON sm.symbol = b.symbol AND sm.bar_idx = b.bar_idx
       LEFT JOIN di ON di.symbol = b.symbol AND di.bar_idx = b.bar_idx""",
)
def adx_classic(spark, sf):
    return X.adx(T.bars(spark, sf)).select(
        "symbol", "ts", r("adx").alias("adx"), r("plus_di").alias("plus_di"), r("minus_di").alias("minus_di")
    )


@query(
    "macd_histogram",
    "WITH RECURSIVE "
    + ",\n".join([TICKS, bars_cte(), _ema_cte({"e12": 12, "e26": 26}),
                  "line AS (SELECT symbol, bar_idx, e12 - e26 AS m FROM emas)",
                  _ema_cte({"sig": 9}, "line", "signal", "m"),
                  """hist AS (SELECT l.symbol, l.bar_idx, l.m - s.sig AS h FROM line l
                     JOIN signal s ON s.symbol = l.symbol AND s.bar_idx = l.bar_idx)"""])
    + f"""SELECT b.symbol, b.ts, {R('CASE WHEN h.bar_idx >= 34 THEN h.h ELSE 0 END')} AS macd_hist,
       {R('CASE WHEN h.bar_idx >= 34 THEN lag(h.h) OVER (PARTITION BY h.symbol ORDER BY h.bar_idx) ELSE 0 END')} AS macd_prev
       FROM hist h JOIN bars b ON b.symbol = h.symbol AND b.bar_idx = h.bar_idx""",
)
def macd_histogram(spark, sf):
    return X.macd(T.bars(spark, sf)).select(
        "symbol", "ts", r("macd_hist").alias("macd_hist"), r("macd_prev").alias("macd_prev")
    )


@query(
    "swing_points_centred",
    BARS + """SELECT symbol, ts, CASE WHEN f AND high = mx THEN 1 ELSE -1 END AS swing, CASE WHEN f AND high = mx THEN high ELSE low END AS swing_level
    FROM (SELECT *, count(*) OVER w = 10 AS f, max(high) OVER w AS mx, min(low) OVER w AS mn FROM bars
      WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)) WHERE f AND (high = mx OR low = mn)""",
)
def swing_points_centred(spark, sf):
    return S.swings_centred(T.bars(spark, sf), LENGTH).filter("swing is not null").select("symbol", "ts", "swing", "swing_level")


@query(
    "fair_value_gaps_centred",
    BARS + """SELECT symbol, ts, CASE WHEN h1 < l2 AND close > open THEN 1 ELSE -1 END AS gap, CASE WHEN h1 < l2 AND close > open THEN l2 ELSE l1 END AS gap_top,
    CASE WHEN h1 < l2 AND close > open THEN h1 ELSE h2 END AS gap_bottom FROM (SELECT *, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lead(high) OVER w AS h2, lead(low) OVER w AS l2
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)) WHERE (h1 < l2 AND close > open) OR (l1 > h2 AND close < open)""",
)
def fair_value_gaps_centred(spark, sf):
    return S.gaps_centred(T.bars(spark, sf)).filter("gap is not null").select("symbol", "ts", "gap", "gap_top", "gap_bottom")
