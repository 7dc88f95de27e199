"""The 42-column feature matrix and the labelled training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import scores
from tapeline.operators import labels as L
from tapeline.operators import outcomes as O
from tapeline.operators import recursive as X
from tapeline.operators import structure as S
from tapeline.operators.bars import KEYS
from tapeline.operators.blocks import framed
from tapeline.operators.market import volume_measures
from tapeline.operators.touch import extreme_tree
from tapeline.plans import signals as G
from tapeline.session import materialize

# Feature names in their order.
FEATURES = [
    "struct_1d", "struct_4h", "struct_1h", "struct_15m", "struct_5m", "decay_1d", "decay_4h", "decay_1h", "decay_15m", "decay_5m",
    "bias_strong", "premium_discount", "daily_bias", "h4_confirms", "h4_poi", "h1_confirms", "h1_choch", "has_entry_zone",
    "precision_trigger", "volume_ok", "ema20_dist_5m", "ema50_dist_5m", "ema20_dist_1h", "ema50_dist_1h", "atr_5m_norm", "atr_1h_norm",
    "atr_daily_norm", "rsi_5m", "rsi_1h", "volume_ratio", "adx_1h", "alignment_score", "hour_sin", "hour_cos", "fvg_bull_active",
    "fvg_bear_active", "ob_bull_active", "ob_bear_active", "liq_above_count", "liq_below_count", "symbol_volatility_rank",
    "symbol_liquidity_rank", "symbol_spread_rank",
]


def zone_counts(t: dict[str, DataFrame], strict: bool) -> DataFrame:
    """Active gaps, order blocks and liquidity levels per bar of every series."""
    tree = extreme_tree(t["bars"])
    # each is read for its starts, its ends and its open zones
    gaps = materialize(S.gap_mitigation(t["gaps"], t["bars"], tree))
    blocks = materialize(S.order_block_mitigation(t["blocks"], t["bars"], tree))
    levels = materialize(S.liquidity(t["swings"], t["bars"], tree=tree))
    # without ``strict`` a level that is swept at any time counts on the first bar only
    gone = F.col("end_idx") if strict else F.when(F.col("end_idx").isNotNull(), F.greatest(F.col("bar_idx"), F.lit(1)))
    levels = levels.withColumn("_end", gone)
    zones = [
        ("fvg_bull_active", gaps.filter("gap > 0"), "mitigated_idx"), ("fvg_bear_active", gaps.filter("gap < 0"), "mitigated_idx"),
        ("ob_bull_active", blocks.filter("ob > 0"), "mitigated_idx"), ("ob_bear_active", blocks.filter("ob < 0"), "mitigated_idx"),
        ("liq_above_count", levels.filter("liquidity > 0"), "_end"), ("liq_below_count", levels.filter("liquidity < 0"), "_end"),
    ]
    deltas = None
    for name, rows, end in zones:
        start = rows.select("symbol", "bar_idx", F.lit(1).alias("d"))
        stop = rows.filter(F.col(end).isNotNull()).select("symbol", F.col(end).alias("bar_idx"), F.lit(-1).alias("d"))
        part = start.unionByName(stop).withColumn("zone", F.lit(name))
        deltas = part if deltas is None else deltas.unionByName(part)
    names = [z[0] for z in zones]
    per_bar = deltas.groupBy("symbol", "bar_idx").agg(*[F.sum(F.when(F.col("zone") == n, F.col("d"))).alias(f"_{n}") for n in names])
    from tapeline.operators.blocks import running

    rows = t["bars"].select("symbol", "bar_idx").join(per_bar, ["symbol", "bar_idx"], "left")
    counted = running(materialize(rows), KEYS, {n: ("sum", F.col(f"_{n}")) for n in names})
    open_zone = (
        gaps.filter("mitigated_idx is null").select("symbol", "bar_idx", F.col("gap").alias("sign"))
        .unionByName(blocks.filter("mitigated_idx is null").select("symbol", "bar_idx", F.col("ob").alias("sign")))
        .groupBy("symbol", "bar_idx").agg(F.max((F.col("sign") > 0).cast("int")).alias("_zu"), F.max((F.col("sign") < 0).cast("int")).alias("_zd"))
    )
    return counted.join(open_zone, ["symbol", "bar_idx"], "left").select(
        "symbol", "bar_idx", *[F.least(F.col(n) / 5.0, F.lit(1.0)).alias(n) for n in names],
        (F.coalesce("_zu", F.lit(0)) == 1).alias("_open_up"), (F.coalesce("_zd", F.lit(0)) == 1).alias("_open_dn"),
    )


def indicators(bars: DataFrame) -> DataFrame:
    """EMA, ATR, RSI and volume measures of every series in one chain."""
    rows = X.smoothed(bars, {"ema20": 20, "ema50": 50})
    share = lambda c: F.when(F.col("close") > 0, F.col(c) / F.col("close")).otherwise(0.0)
    dist = lambda c: F.when(F.col("close") > 0, (F.col("close") - F.col(c)) / F.col("close")).otherwise(0.0)
    return volume_measures(rows).withColumns(
        {"ema20_dist": dist("ema20"), "ema50_dist": dist("ema50"), "atr_norm": share("atr"), "rsi_norm": F.col("rsi") / 100}
    )


def feature_matrix(base: DataFrame, p: G.SignalParams | None = None, decision_tf: str = "5m") -> DataFrame:
    """Features of every decision bar; ``symbol, ts`` and the named columns."""
    p = p or G.SignalParams()
    t = G.structure_tables(G.series_table(base, decision_tf), p)
    state = G.running_state(t, G.SignalParams(**{**p.__dict__, "poi_bars": p.poi_bars + 1}))
    counts = zone_counts(t, p.strict)
    state = state.join(counts, ["symbol", "bar_idx"])
    state = S.recent_flag(state, {"zone_up": F.col("_open_up"), "zone_dn": F.col("_open_dn")}, p.zone_bars)
    ind = indicators(t["bars"]).select("symbol", "bar_idx", "ema20_dist", "ema50_dist", "atr_norm", "rsi_norm", "volume_ratio", "volume_ok")
    hourly = X.adx_training(t["bars"].filter("tf = '1h'")).select("symbol", "bar_idx", "adx_training")
    state = materialize(state.join(ind, ["symbol", "bar_idx"]).join(hourly, ["symbol", "bar_idx"], "left"))
    hit = lambda c, w: F.coalesce(F.max(c.cast("int")).over(w.rowsBetween(-p.trigger_bars, 0)), F.lit(0)) == 1
    rows = framed(
        state.filter(F.col("tf") == decision_tf), KEYS,
        lambda w: {
            "trigger_up": hit(F.col("break_sign") > 0, w), "trigger_dn": hit(F.col("break_sign") < 0, w),
            "struct_5m": F.coalesce(F.lag("structure").over(w), F.lit(0)), "decay_5m": F.coalesce(F.lag("decay").over(w), F.lit(0.0)),
        },
        before=max(1, p.trigger_bars),
    )
    rows = rows.select(
        "sym", "ts", "bar_idx", "close", "open", "high", "low", "n_bars", "struct_5m", "decay_5m", "trigger_up", "trigger_dn", "volume_ratio",
        F.col("volume_ok").alias("_vol"), F.col("ema20_dist").alias("ema20_dist_5m"), F.col("ema50_dist").alias("ema50_dist_5m"),
        F.col("atr_norm").alias("atr_5m_norm"), F.col("rsi_norm").alias("rsi_5m"),
    )
    ready = F.col("n_bars") >= 2 * p.swing_length
    on = lambda c: F.when(ready, F.col(c))
    state = state.withColumns({c: on(c) for c in ("bias", "strong", "structure", "after_choch", "poi_up", "poi_dn", "zone_up", "zone_dn")}).withColumn(
        "decay", on("decay")
    )
    rows = G.attach(rows, state, "1d", {"bias": "struct_1d", "decay": "decay_1d", "strong": "_strong", "atr_norm": "atr_daily_norm"}, p)
    rows = G.attach(rows, state, "4h", {"structure": "struct_4h", "decay": "decay_4h", "poi_up": "_pu", "poi_dn": "_pd", "midpoint": "_mid"}, p)
    rows = G.attach(rows, state, "1h", {
        "structure": "struct_1h", "decay": "decay_1h", "after_choch": "_choch", "ema20_dist": "_e20", "ema50_dist": "_e50", "atr_norm": "atr_1h_norm",
        "rsi_norm": "rsi_1h", "adx_training": "_adx", "n_bars": "_n1h", "liq_above_count": "liq_above_count", "liq_below_count": "liq_below_count"}, p)
    rows = G.attach(rows, state, "15m", {
        "structure": "struct_15m", "decay": "decay_15m", "zone_up": "_zu", "zone_dn": "_zd",
        **{c: c for c in ("fvg_bull_active", "fvg_bear_active", "ob_bull_active", "ob_bear_active")}}, p)
    flag = lambda c: F.coalesce(c, F.lit(False))
    num = lambda c, d=0.0: F.coalesce(F.col(c).cast("double"), F.lit(d))
    bias = F.coalesce("struct_1d", F.lit(0))
    up, dn = bias > 0, bias < 0
    pick = lambda a, b: flag((up & F.col(a)) | (dn & F.col(b)))
    same = lambda c: flag(((bias > 0) & (F.col(c) > 0)) | ((bias < 0) & (F.col(c) < 0)))
    flags = {
        "bias": bias != 0, "bias_strong": flag(F.col("_strong")), "h4": same("struct_4h"), "h4_poi": pick("_pu", "_pd"), "h1": same("struct_1h"),
        "h1_choch": flag(F.col("_choch")), "zone": pick("_zu", "_zd"), "trigger": pick("trigger_up", "trigger_dn"),
        "volume": (F.col("bar_idx") >= 20) & F.col("_vol"),
    }
    # the feature is the plain weighted sum, without the 1.3 lift of sparse scores
    total = F.lit(0.0)
    for name, weight in scores.WEIGHTS.items():
        hit = flags[name] & {"bias_strong": flags["bias"], "h1_choch": flags["h1"]}.get(name, F.lit(True))
        total = total + F.when(hit, weight).otherwise(0.0)
    sin, cos = scores.hour_cycle(F.col("ts"))
    dp = F.when(F.col("close") > F.col("_mid"), 1.0).when(F.col("close") < F.col("_mid"), -1.0).otherwise(0.0)
    long1h = F.col("_n1h") > 50
    values = {
        **{f"struct_{tf}": num(f"struct_{tf}") for tf in ("1d", "4h", "1h", "15m", "5m")},
        **{f"decay_{tf}": num(f"decay_{tf}") for tf in ("1d", "4h", "1h", "15m", "5m")},
        "bias_strong": flags["bias_strong"].cast("double"), "premium_discount": dp, "daily_bias": bias.cast("double"),
        "h4_confirms": flags["h4"].cast("double"), "h4_poi": flags["h4_poi"].cast("double"), "h1_confirms": flags["h1"].cast("double"),
        "h1_choch": flags["h1_choch"].cast("double"), "has_entry_zone": flags["zone"].cast("double"),
        "precision_trigger": flags["trigger"].cast("double"), "volume_ok": flags["volume"].cast("double"),
        "ema20_dist_5m": num("ema20_dist_5m"), "ema50_dist_5m": num("ema50_dist_5m"),
        "ema20_dist_1h": F.when(long1h, num("_e20")).otherwise(0.0), "ema50_dist_1h": F.when(long1h, num("_e50")).otherwise(0.0),
        "atr_5m_norm": num("atr_5m_norm"), "atr_1h_norm": num("atr_1h_norm"), "atr_daily_norm": num("atr_daily_norm"),
        "rsi_5m": num("rsi_5m", 0.5), "rsi_1h": num("rsi_1h", 0.5), "volume_ratio": num("volume_ratio", 1.0),
        "adx_1h": F.when(F.col("_n1h") > 30, F.least(F.col("_adx") / 50, F.lit(2.0))).otherwise(0.5),
        "alignment_score": F.least(total, F.lit(1.0)), "hour_sin": sin, "hour_cos": cos,
        **{c: num(c) for c in FEATURES[34:40]},
    }
    return rows.select(F.col("sym").alias("symbol"), "ts", "bar_idx", "n_bars", "open", "high", "low", "close", *[v.alias(k) for k, v in values.items()])


def with_symbol_ranks(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rank of each symbol by volatility, traded value and range, one row per symbol."""
    from tapeline.operators.ranking import percent_rank

    ranked = profiles.withColumn("_g", F.lit(0))
    ranks = {"atr_pct": "symbol_volatility_rank", "usd_volume": "symbol_liquidity_rank", "range_pct": "symbol_spread_rank"}
    for source, out in ranks.items():
        ranked = percent_rank(ranked, ["_g"], source, out)
    side = ranked.select("symbol", *ranks.values())
    return features.join(side, "symbol", "left").fillna(0.5, list(ranks.values()))


def training_set(base: DataFrame, p: G.SignalParams, horizon: int, post_bars: int = 200, decision_tf: str = "5m") -> DataFrame:
    """Features joined to the simulated outcome of each candidate entry.

    A candidate is a bar with a daily bias and a confirmation, zone or trigger;
    entry is the next open, the target at least one R.  The teacher that finds
    candidates looks ahead; the features do not.
    """
    t = G.structure_tables(G.series_table(base, decision_tf), p, look_ahead=True)
    state = materialize(G.running_state(t, p))
    bars = t["bars"].filter(F.col("tf") == decision_tf).select(F.col("sym").alias("symbol"), "ts", "bar_idx", "n_bars", "open", "high", "low", "close")
    bars = materialize(bars)
    rows = G.scored_bars(t, state, p, decision_tf).filter((F.col("bias") != 0) & (F.col("h1_ok") | F.col("has_zone") | F.col("precision")))
    nxt = bars.select(F.col("symbol").alias("sym"), (F.col("bar_idx") - 1).alias("bar_idx"), F.col("open").alias("_open"))
    rows = rows.drop("entry").join(nxt, ["sym", "bar_idx"]).withColumnRenamed("_open", "entry").filter(F.col("bar_idx") + 11 < F.col("n_bars"))
    widened = G.SignalParams(**{**p.__dict__, "min_rr": 1.0, "min_stop_pct": 0.001})
    entries = G.signals_from(rows.withColumn("reason", F.lit("passed")), t, widened, searched=True)  # the next open may lie outside the coarse bar
    sig = materialize(entries.select(
        F.concat_ws("-", "sym", "bar_idx").alias("sig_id"), F.col("sym").alias("symbol"), "ts", "bar_idx", "n_bars", "direction", "entry", "stop", "target",
        F.col("risk_reward").alias("label_tp_rr"),
    ))
    sim = O.simulate(sig, bars, horizon, post_bars).select("sig_id", "outcome", "net_rr", "bars_held", "mfe_rr", "mae_rr", "exit_mechanism", "post_tp_max_rr")
    code = F.when(F.col("outcome") == "win", 1).when(F.col("outcome") == "loss", 2).otherwise(3)
    labelled = sig.join(sim, "sig_id").withColumns({"label_outcome": code, "mfe": F.col("mfe_rr"), "mae": F.col("mae_rr")})
    labelled = labelled.withColumns(L.hindsight_targets())
    keep = labelled.select(
        "symbol", "ts", F.when(F.col("direction") > 0, 1).otherwise(2).alias("label_action"), F.col("net_rr").alias("label_rr"), "label_outcome",
        F.col("exit_mechanism").alias("label_exit_mechanism"), F.col("bars_held").alias("label_exit_bar"), F.col("mfe").alias("label_max_favorable_rr"),
        F.col("mae").alias("label_mae_rr"), "label_tp_rr", F.col("post_tp_max_rr").alias("label_post_tp_max_rr"), "optimal_entry", "optimal_sl_rr",
        "optimal_tp_rr", "optimal_size",
    )
    features = feature_matrix(base, p, decision_tf).drop("bar_idx", "n_bars", "open", "high", "low", "close")
    return features.join(keep, ["symbol", "ts"], "left").fillna({"label_action": 0, "label_outcome": 0})
