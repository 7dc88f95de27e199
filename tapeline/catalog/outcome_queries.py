"""Signals resolved against the later price path."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import TICKS, bars_cte, breaks_cte, swings_cte, with_
from tapeline.catalog.registry import R, query, r
from tapeline.operators import outcomes as O
from tapeline.operators import structure as S
from tapeline.session import materialize
from tapeline.sources import tables as T

LENGTH, H = 5, 48
SIGNALS = """sig AS (
  SELECT symbol || '-' || bar_idx AS sig_id, symbol, ts, bar_idx, n_bars, sign AS direction, close AS entry, stop,
         close + sign * 2.0::DOUBLE * abs(close - stop) AS target, abs(close - stop) AS risk
  FROM (SELECT b.*, k.sign, CASE WHEN k.sign > 0 THEN b.low * (1 - 0.005::DOUBLE) ELSE b.high * (1 + 0.005::DOUBLE) END AS stop
        FROM bars b JOIN breaks k ON k.symbol = b.symbol AND k.bar_idx = b.bar_idx)
  WHERE close > 0 AND abs(close - stop) > 0)"""
BASE = [TICKS, bars_cte(), swings_cte(LENGTH), breaks_cte(), SIGNALS]


def path_cte(start, count, name="path", sig="sig"):
    return f"""{name} AS (
  SELECT s.*, p.bar_idx AS path_idx, p.bar_idx - s.bar_idx - {start} AS step, p.ts AS bar_ts, p.high AS bar_high, p.low AS bar_low,
         p.close AS bar_close, CASE WHEN direction > 0 THEN p.high ELSE p.low END AS best,
         CASE WHEN direction > 0 THEN p.low ELSE p.high END AS worst,
         ((CASE WHEN direction > 0 THEN p.high ELSE p.low END) - entry) * direction / risk AS fav,
         (entry - (CASE WHEN direction > 0 THEN p.low ELSE p.high END)) * direction / risk AS adv
  FROM {sig} s JOIN bars p ON p.symbol = s.symbol AND p.bar_idx BETWEEN s.bar_idx + {start} AND s.bar_idx + {start} + {count} - 1)"""


PREV = "(PARTITION BY sig_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CUR = "(PARTITION BY sig_id ORDER BY step ROWS UNBOUNDED PRECEDING)"


def signals(spark, sf, tf="1h"):
    bars = T.bars(spark, sf, tf)
    return materialize(T.break_signals(bars, S.breaks(S.swings(bars, LENGTH)))), bars


RESOLUTION = f"""m AS (SELECT *, coalesce(max(CASE WHEN fav >= 1.5 THEN 1 ELSE 0 END) OVER {PREV}, 0) = 1 AS was FROM path),
lv AS (SELECT *, (NOT was AND fav >= 1.5 AND (worst - stop) * direction <= 0) AS clash, (was OR fav >= 1.5) AS rat,
  entry + entry * (0.0004::DOUBLE * 2 + 0.0001::DOUBLE * 2) * direction AS even FROM m),
l2 AS (SELECT *, CASE WHEN rat THEN CASE WHEN direction > 0 THEN greatest(stop, even) ELSE least(stop, even) END ELSE stop END AS lvl FROM lv),
e AS (SELECT *, CASE WHEN clash THEN 'loss' WHEN (worst - lvl) * direction <= 0 THEN CASE WHEN rat THEN 'breakeven' ELSE 'loss' END
    WHEN (best - target) * direction >= 0 THEN 'win' END AS ev,
    CASE WHEN clash THEN stop WHEN (worst - lvl) * direction <= 0 THEN lvl WHEN (best - target) * direction >= 0 THEN target END AS px FROM l2),
d AS (SELECT sig_id, arg_min(ev, step) FILTER (ev IS NOT NULL) AS ev, arg_min(px, step) FILTER (ev IS NOT NULL) AS px,
    arg_min(bar_ts, step) FILTER (ev IS NOT NULL) AS xts, min(step) FILTER (ev IS NOT NULL) AS xs,
    arg_max(bar_close, step) AS lc, max(bar_ts) AS lts, max(step) AS ls, first(entry) AS entry, first(direction) AS direction, first(risk) AS risk
    FROM e GROUP BY sig_id)"""
RESOLVED = f"""SELECT sig_id, coalesce(ev, CASE WHEN (lc - entry) * direction / risk >= 0.5 THEN 'win'
      WHEN (lc - entry) * direction / risk <= -0.5 THEN 'loss' ELSE 'breakeven' END) AS outcome, {R('coalesce(px, lc)')} AS exit_price,
    coalesce(xts, lts) AS exit_ts, coalesce(xs, ls) + 1 AS bars_held, {R('(coalesce(px, lc) - entry) * direction / risk')} AS actual_rr FROM d"""


@query("outcome_resolved", with_(*BASE, path_cte(1, H), RESOLUTION) + RESOLVED)
def outcome_resolved(spark, sf):
    sig, bars = signals(spark, sf)
    out = O.resolve(sig, bars, H)
    return out.select("sig_id", "outcome", r("exit_price").alias("exit_price"), "exit_ts", "bars_held", r("actual_rr").alias("actual_rr"))


_FWD = [path_cte(2, H - 1, "p0"), f"""p1 AS (SELECT *, max(CASE WHEN fav >= 1.5 THEN 1 ELSE 0 END) OVER {CUR} = 1 AS be,
  greatest(max(fav) OVER {CUR}, 0) AS mfe, greatest(max(adv) OVER {CUR}, 0) AS mae, step + 2 AS bars_held,
  (bar_close - entry) * direction / risk AS unrealized,
  entry + entry * (0.0004::DOUBLE * 2 + 0.0002::DOUBLE * 2) * direction AS even FROM p0),
p2 AS (SELECT *, CASE WHEN be THEN even ELSE stop END AS lvl FROM p1),
p3 AS (SELECT *, (lvl - entry) * direction / risk AS at_stop, (worst - lvl) * direction <= 0 AS stopped, (best - target) * direction >= 0 AS hit FROM p2),
p4 AS (SELECT *, CASE WHEN stopped THEN CASE WHEN be AND abs(at_stop) < 0.5 THEN 3 ELSE 2 END WHEN hit THEN 1 END AS mech,
  CASE WHEN stopped THEN at_stop WHEN hit THEN (target - entry) * direction / risk END AS raw FROM p3),
fwd AS (SELECT * FROM (SELECT *, coalesce(max((mech IS NOT NULL)::INT) OVER {PREV}, 0) AS ended FROM p4) WHERE ended = 0),
fend AS (SELECT sig_id, max(mech) AS mech, max(raw) FILTER (mech IS NOT NULL) AS raw, max(bars_held) FILTER (mech IS NOT NULL) AS held,
  max(path_idx) FILTER (mech IS NOT NULL) AS exit_idx, max(fav) FILTER (mech IS NOT NULL) AS xfav, max(mfe) AS mfe, max(mae) AS mae FROM fwd GROUP BY sig_id),
sim0 AS (SELECT s.*, coalesce(f.mech, 4) AS exit_mechanism, coalesce(f.held, least({H}, s.n_bars - 1 - s.bar_idx)) AS bars_held,
  coalesce(f.raw, (b.close - s.entry) * s.direction / s.risk) AS raw, coalesce(f.mfe, 0) AS mfe_rr, coalesce(f.mae, 0) AS mae_rr,
  f.exit_idx, f.raw AS tp_rr, f.xfav FROM sig s LEFT JOIN fend f USING (sig_id)
  JOIN bars b ON b.symbol = s.symbol AND b.bar_idx = least(s.bar_idx + {H}, s.n_bars - 1)),
sim1 AS (SELECT *, raw - entry * ((0.0004::DOUBLE + 0.0002::DOUBLE) * 2) / risk
   - CASE WHEN bars_held > 0 THEN entry * 0.0001::DOUBLE * (bars_held * 5 / 60.0::DOUBLE / 8) / risk ELSE 0 END AS net_rr FROM sim0),
sim AS (SELECT *, CASE exit_mechanism WHEN 1 THEN 'win' WHEN 3 THEN 'breakeven' WHEN 2 THEN CASE WHEN net_rr > 0 THEN 'win' ELSE 'loss' END
   ELSE CASE WHEN net_rr >= 0.5 THEN 'win' WHEN net_rr <= -0.5 THEN 'loss' ELSE 'breakeven' END END AS outcome FROM sim1)"""]


@query(
    "outcome_forward_simulation",
    with_(*BASE, *_FWD, """hits AS (SELECT sig_id, symbol, exit_idx AS bar_idx, direction, entry, stop, target, risk, tp_rr, xfav FROM sim WHERE exit_mechanism = 1)""",
          path_cte(1, 20, "post", "hits"), f"""post2 AS (SELECT *, coalesce(max(CASE WHEN (bar_close - entry) * direction < 0 THEN 1 ELSE 0 END) OVER {PREV}, 0) AS ov FROM post),
    pagg AS (SELECT sig_id, max(fav) AS pf, min((bar_close - entry) * direction / risk) AS pw, count(*) AS pn FROM post2 WHERE ov = 0 GROUP BY sig_id)""")
    + f"""SELECT s.sig_id, outcome, {R('net_rr')} AS net_rr, bars_held, {R('mfe_rr')} AS mfe_rr, {R('mae_rr')} AS mae_rr, exit_mechanism,
    CASE WHEN exit_mechanism = 1 THEN {R('greatest(tp_rr, xfav, coalesce(pf, tp_rr))')} END AS post_tp_max_rr,
    CASE WHEN exit_mechanism = 1 THEN coalesce(pn, 0) ELSE 0 END AS post_tp_bars,
    CASE WHEN exit_mechanism = 1 THEN {R('least(tp_rr, coalesce(pw, tp_rr))')} END AS post_tp_reversal_rr
    FROM sim s LEFT JOIN pagg p ON p.sig_id = s.sig_id""",
)
def outcome_forward_simulation(spark, sf):
    sig, bars = signals(spark, sf)
    out = O.simulate(sig, bars, H, post_bars=20)
    rounded = ["net_rr", "mfe_rr", "mae_rr", "post_tp_max_rr", "post_tp_reversal_rr"]
    return out.select("sig_id", "outcome", "bars_held", "exit_mechanism", "post_tp_bars", *[r(c).alias(c) for c in rounded])


@query(
    "outcome_exit_episodes",
    with_(*BASE, *_FWD)
    + f"""SELECT f.sig_id, f.bars_held, {R('unrealized')} AS unrealized, {R('f.mfe')} AS mfe,
    {R('least(greatest(unrealized - coalesce(lag(unrealized) OVER w, 0), -1), 1)')} AS pnl_velocity,
    {R('least(greatest(CASE WHEN f.mfe > 0 THEN (f.mfe - unrealized) / f.mfe ELSE 0 END, 0), 1)')} AS mfe_drawdown,
    {R('least(sum(CASE WHEN unrealized > 0 THEN 1 ELSE 0 END) OVER w / greatest(f.bars_held, 1), 1)')} AS time_in_profit_ratio,
    (s.net_rr - unrealized > 0)::INT AS label_hold_better
    FROM fwd f JOIN sim s ON s.sig_id = f.sig_id WINDOW w AS (PARTITION BY f.sig_id ORDER BY step ROWS UNBOUNDED PRECEDING)""",
)
def outcome_exit_episodes(spark, sf):
    sig, bars = signals(spark, sf)
    path = materialize(O.forward_paths(sig, bars, H))
    out = O.exit_episodes(path, O.simulate(sig, bars, H, post_bars=1), H)
    cols = ["unrealized", "mfe", "pnl_velocity", "mfe_drawdown", "time_in_profit_ratio"]
    return out.select("sig_id", "bars_held", "label_hold_better", *[r(c).alias(c) for c in cols])


_DEV = "greatest(CASE WHEN b.bar_idx > 0 THEN b.dev ELSE b.nxt * 0.005::DOUBLE END, b.nxt * 0.002::DOUBLE)"
EPISODES = [TICKS, bars_cte(), swings_cte(LENGTH), breaks_cte(),
    "wide AS (SELECT *, stddev_samp(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS dev, lead(open) OVER (PARTITION BY symbol ORDER BY bar_idx) AS nxt FROM bars)",
    f"""sig AS (SELECT b.symbol || '-' || b.bar_idx AS sig_id, b.symbol, b.ts, b.bar_idx, b.n_bars, k.sign AS direction, b.nxt AS entry, b.nxt - k.sign * {_DEV} AS stop, b.nxt + k.sign * {_DEV} * 2.5::DOUBLE AS target,
      abs(b.nxt - (b.nxt - k.sign * {_DEV})) AS risk FROM wide b JOIN breaks k ON k.symbol = b.symbol AND k.bar_idx = b.bar_idx WHERE b.nxt > 0 AND b.bar_idx + 10 < b.n_bars)""", *_FWD]


def episodes(spark, sf):
    """Trades at breaks, entered at the next open, their bars, and the state of the market at each bar."""
    bars = T.bars(spark, sf)
    broken = materialize(S.breaks(S.swings(bars, LENGTH)))
    entries = broken.select(F.concat_ws("-", "symbol", "bar_idx").alias("sig_id"), "symbol", "bar_idx", F.col("sign").alias("direction"), F.lit(2.5).alias("tp_rr"))
    path = materialize(O.forward_paths(O.episode_signals(entries, bars), bars, H))
    return path, O.exit_bar_state(bars, broken)


_EXIT = ["bar_unrealized_rr", "sl_distance_pct", "max_favorable_seen", "be_triggered", "asset_class_id", "bars_held_normalized", "pnl_velocity", "mfe_drawdown", "time_in_profit_ratio", "regime_volatility",
         "opposing_structure_count"]


@query(
    "outcome_exit_features",
    with_(*EPISODES, """rg AS (SELECT symbol, bar_idx, CASE WHEN stddev_pop(close) OVER l > 0 THEN least(greatest(stddev_pop(close) OVER s / stddev_pop(close) OVER l, 0.5), 2) ELSE 1 END AS regime FROM bars
            WINDOW l AS (PARTITION BY symbol ORDER BY bar_idx ROWS 199 PRECEDING), s AS (PARTITION BY symbol ORDER BY bar_idx ROWS 49 PRECEDING))""",
          "against AS (SELECT f.sig_id, f.path_idx, count(k.bar_idx) AS n FROM fwd f LEFT JOIN breaks k ON k.symbol = f.symbol AND k.sign = -f.direction AND k.bar_idx > f.bar_idx AND k.bar_idx <= f.path_idx GROUP BY ALL)")
    + f"""SELECT f.sig_id, f.bars_held::DOUBLE AS bars_held, {R('least(greatest(unrealized, -3), 10)')} AS bar_unrealized_rr, {R('least(greatest((bar_close - lvl) * direction / bar_close, 0), 0.1)')} AS sl_distance_pct,
    {R('least(f.mfe, 10)')} AS max_favorable_seen, be::INT::DOUBLE AS be_triggered, 0.33::DOUBLE AS asset_class_id, {R(f'least(f.bars_held / {H}, 1)')} AS bars_held_normalized,
    {R('least(greatest(unrealized - coalesce(lag(unrealized) OVER w, 0), -1), 1)')} AS pnl_velocity, {R('least(greatest(CASE WHEN f.mfe > 0 THEN (f.mfe - unrealized) / f.mfe ELSE 0 END, 0), 1)')} AS mfe_drawdown,
    {R('least(sum(CASE WHEN unrealized > 0 THEN 1 ELSE 0 END) OVER w / greatest(f.bars_held, 1), 1)')} AS time_in_profit_ratio, {R('regime', 4)} AS regime_volatility, least(n, 10)::DOUBLE AS opposing_structure_count
    FROM fwd f JOIN rg ON rg.symbol = f.symbol AND rg.bar_idx = f.path_idx JOIN against a ON a.sig_id = f.sig_id AND a.path_idx = f.path_idx
    WINDOW w AS (PARTITION BY f.sig_id ORDER BY step ROWS UNBOUNDED PRECEDING)""",
)
def outcome_exit_features(spark, sf):
    """Exit features that SQL can state; the smoothed indicators among them have queries of their own."""
    path, state = episodes(spark, sf)
    out = O.exit_features(path, state, H, "forex")
    rounded = [r(c, 4 if c == "regime_volatility" else 6).alias(c) for c in _EXIT if c not in ("be_triggered", "asset_class_id", "opposing_structure_count")]
    return out.select("sig_id", "bars_held", "be_triggered", "asset_class_id", "opposing_structure_count", *rounded)


@query(
    "outcome_exit_bounds",
    with_(*EPISODES) + """SELECT (SELECT count(*) FROM fwd) AS "rows", unnest([""" + ", ".join(f"'{c}'" for c in O.EXIT_BOUNDS) + """]) AS "column", 0::BIGINT AS violations""",
)
def outcome_exit_bounds(spark, sf):
    """All 16 exit features of every bar lie within their bounds."""
    from tapeline.operators import labels as L

    return L.range_violations(O.exit_features(*episodes(spark, sf), H), O.EXIT_BOUNDS)


@query(
    "outcome_retrodictive",
    with_(*BASE, "limit_sig AS (SELECT * REPLACE (entry - direction * 0.25::DOUBLE * risk AS entry, risk * 0.75::DOUBLE AS risk) FROM sig)",
          "l2 AS (SELECT * REPLACE (abs(entry - stop) AS risk) FROM limit_sig)", path_cte(1, H, "path", "l2"),
          f"""a AS (SELECT *, max(CASE WHEN bar_low <= entry AND entry <= bar_high THEN 1 ELSE 0 END) OVER {CUR} = 1 AS inn FROM path),
    b AS (SELECT *, inn AND (worst - stop) * direction <= 0 AS s, inn AND (best - target) * direction >= 0 AS t FROM a),
    c AS (SELECT *, CASE WHEN s AND t THEN 'ambiguous_sl' WHEN s THEN 'sl' WHEN t THEN 'tp' END AS e FROM b),
    d AS (SELECT sig_id, arg_min(e, step) FILTER (e IS NOT NULL) AS e, max(inn::INT) AS inn, arg_max(bar_close, step) AS lc,
      first(entry) AS entry, first(risk) AS risk, first(direction) AS direction, first(target) AS target FROM c GROUP BY sig_id)""")
    + f"""SELECT sig_id, coalesce(e, CASE WHEN inn = 0 THEN 'no_entry' ELSE 'timeout' END) AS outcome,
    {R('CASE WHEN e = $$tp$$ THEN abs(target - entry) / risk WHEN e IS NOT NULL THEN -1 WHEN inn = 1 THEN (lc - entry) * direction / risk END')} AS r FROM d""",
)
def outcome_retrodictive(spark, sf):
    sig, bars = signals(spark, sf)
    limit = sig.withColumn("entry", F.col("entry") - F.col("direction") * 0.25 * F.abs(F.col("entry") - F.col("stop")))
    return O.retrodict(limit, bars, H).select("sig_id", "outcome", r("r").alias("r"))


def _touch(level, up):
    return f"""(SELECT min(t.bar_idx) FROM bars t WHERE t.symbol = s.symbol AND t.bar_idx > s.bar_idx AND
      CASE WHEN (s.direction > 0) = {up} THEN t.high >= {level} ELSE t.low <= {level} END)"""


_HZ = {"scalp": 72, "day": 288, "swing": 1440}


@query(
    "outcome_counterfactual",
    with_(TICKS, bars_cte("15m"), swings_cte(LENGTH), breaks_cte(), SIGNALS,
          f"t AS (SELECT s.*, {_touch('s.stop', 'false')} AS sl, {_touch('s.target', 'true')} AS tp FROM sig s)")
    + "SELECT sig_id, " + ", ".join(
        f"""CASE WHEN least(sl, tp) <= bar_idx + {h} THEN CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp < sl) THEN 'win' ELSE 'loss' END
        WHEN n_bars - 1 >= bar_idx + {h} THEN 'timeout' END AS outcome_{n},
        (SELECT {R('greatest(CASE WHEN t.direction > 0 THEN max(b.high) - t.entry ELSE t.entry - min(b.low) END / t.entry, 0)')} FROM bars b
          WHERE b.symbol = t.symbol AND b.bar_idx > t.bar_idx AND b.bar_idx <= least(coalesce(least(sl, tp), 1000000000), t.bar_idx + {h})) AS mfe_{n},
        (SELECT {R('greatest(CASE WHEN t.direction > 0 THEN t.entry - min(b.low) ELSE max(b.high) - t.entry END / t.entry, 0)')} FROM bars b
          WHERE b.symbol = t.symbol AND b.bar_idx > t.bar_idx AND b.bar_idx <= least(coalesce(least(sl, tp), 1000000000), t.bar_idx + {h})) AS mae_{n}"""
        for n, h in _HZ.items()) + " FROM t",
)
def outcome_counterfactual(spark, sf):
    sig, bars = signals(spark, sf, "15m")
    out = O.counterfactual(sig, bars, _HZ)
    return out.select("sig_id", *[f"outcome_{n}" for n in _HZ], *[r(f"{m}_{n}").alias(f"{m}_{n}") for n in _HZ for m in ("mfe", "mae")])


@query(
    "outcome_after_exit",
    with_(*BASE, "ex AS (SELECT *, entry AS exit_price FROM sig)", path_cte(1, 50, "path", "ex"))
    + f"""SELECT sig_id, step, {R('(bar_close - exit_price) * direction / exit_price')} AS cumulative_pct,
    {R(f'greatest(max((bar_close - exit_price) * direction / exit_price) OVER {CUR}, 0)')} AS best_missed FROM path""",
)
def outcome_after_exit(spark, sf):
    sig, bars = signals(spark, sf)
    out = O.after_exit(sig.withColumn("exit_price", F.col("entry")), bars)
    return out.select("sig_id", "step", r("cumulative_pct").alias("cumulative_pct"), r("best_missed").alias("best_missed"))


@query(
    "outcome_bracket_fill",
    with_(*BASE, path_cte(1, 1))
    + """SELECT sig_id, CASE WHEN (worst - stop) * direction <= 0 THEN 'sl_hit' WHEN (best - target) * direction >= 0 THEN 'tp_hit' END AS exit_reason,
    (round(CASE WHEN (worst - stop) * direction <= 0 THEN stop WHEN (best - target) * direction >= 0 THEN target END, 6) + 0.0) AS fill_price FROM path""",
)
def outcome_bracket_fill(spark, sf):
    sig, bars = signals(spark, sf)
    return O.bracket_fill(O._path(sig, bars, 1, 1)).select("sig_id", "exit_reason", r("fill_price").alias("fill_price"))
