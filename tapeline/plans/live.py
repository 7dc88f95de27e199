"""The graded live score and the short observation vector of decision bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import scores
from tapeline.operators import market as M
from tapeline.operators import recursive as X
from tapeline.operators import zones as Z
from tapeline.operators.bars import KEYS, true_range
from tapeline.operators.blocks import framed
from tapeline.plans import signals as G
from tapeline.session import materialize

AGE = 3  # the rated zone is taken to be three bars old


def live_scores(t: dict[str, DataFrame], state: DataFrame, p: G.SignalParams, decision_tf: str = "5m", asset_class: Column | None = None,
                volume_profile: Column | None = None) -> DataFrame:
    """Graded score per decision bar, from the same tables as the signals.

    ``asset_class`` and ``volume_profile`` are expressions over the scored rows
    (``sym``, ``entry``, ...); without them all symbols are crypto and the
    profile is neutral.
    """
    asset_class = F.lit("crypto") if asset_class is None else asset_class
    volume_profile = F.lit(0.5) if volume_profile is None else volume_profile
    rows = G.scored_bars(t, state, p, decision_tf).filter("bias <> 0")
    bars = t["bars"]
    hourly = bars.filter("tf = '1h'")
    trend = X.macd(X.simple_rsi(X.adx(hourly)))
    trend = materialize(trend.select("sym", "symbol", "tf", "ts", "bar_idx", "n_bars", "adx", "rsi_simple", "macd_hist", "macd_prev"))
    means = X.ema(bars.filter("tf <> '5m'"), {"_e20": 20, "_e50": 50})
    means = materialize(means.select("sym", "symbol", "tf", "ts", "bar_idx", "n_bars", F.signum(F.col("_e20") - F.col("_e50")).alias("lean")))
    quality = framed(
        framed(bars.filter("tf = '15m'"), KEYS, lambda w: {"_tr": true_range(w)}, before=1), KEYS,
        lambda w: {
            "zatr": F.when(F.col("bar_idx") >= 14, F.avg("_tr").over(w.rowsBetween(-13, 0))).otherwise(0.0),
            **{f"z{c}": F.lag(c, AGE).over(w) for c in ("open", "high", "low", "close")},
            "c1": F.lag("close", 1).over(w), "c2": F.lag("close", 2).over(w),
        },
        before=14,
    )
    quality = materialize(quality.select("sym", "symbol", "tf", "ts", "zatr", "zopen", "zhigh", "zlow", "zclose", "c1", "c2"))
    volume = M.volume_measures(bars.filter(F.col("tf") == decision_tf)).select("sym", "bar_idx", "relative_score", "volume")
    poi = Z.recent_zone(bars, G.zone_events(t).filter(F.col("symbol").endswith("|4h")), 10, "ob").select(
        F.regexp_extract("symbol", r"^(.*)\|", 1).alias("sym"), F.col("bar_idx").alias("idx_4h"), F.col("sign").alias("direction"),
        F.col("zone_top").alias("poi_top"), F.col("zone_bottom").alias("poi_bottom"),
    )
    rows = rows.join(volume, ["sym", "bar_idx"]).join(poi, ["sym", "idx_4h", "direction"], "left")
    rows = G.attach(rows, trend, "1h", {c: c for c in ("adx", "rsi_simple", "macd_hist", "macd_prev")}, p)
    rows = G.attach(rows, quality, "15m", {c: c for c in ("zatr", "zopen", "zhigh", "zlow", "zclose", "c1", "c2")}, p)
    for tf in ("15m", "1h", "4h", "1d"):
        rows = G.attach(rows, means, tf, {"lean": f"lean_{tf}", "n_bars": f"n_{tf}"}, p)
    up = F.col("direction") > 0
    known = [F.col(f"n_{tf}") >= 50 for tf in ("15m", "1h", "4h", "1d")]
    agrees = [k & (F.col(f"lean_{tf}") == F.col("direction")) for k, tf in zip(known, ("15m", "1h", "4h", "1d"))]
    count = lambda cs: sum((F.coalesce(c, F.lit(False)).cast("int") for c in cs), F.lit(0))
    agreement = F.when(count(known) > 0, count(agrees) / count(known)).otherwise(0.0)
    top, bottom = F.col("zone_top"), F.col("zone_bottom")
    through = lambda c: F.when(up, F.col(c) < bottom).otherwise(F.col(c) > top)
    inside = lambda c: F.when(up, F.col(c) < top).otherwise(F.col(c) > bottom)
    untouched = F.when(through("c1") | through("c2"), 0.0).when(inside("c1") | inside("c2"), 0.5).otherwise(1.0)
    overlap = F.coalesce((F.col("poi_bottom") <= top) & (F.col("poi_top") >= bottom), F.lit(False))
    form = scores.formation_quality(F.col("zopen"), F.col("zhigh"), F.col("zlow"), F.col("zclose"))
    zone = F.when(
        F.col("has_zone"),
        scores.zone_quality(F.lit(AGE), untouched, scores.zone_size_score(F.abs(top - bottom), F.col("zatr")), form, overlap),
    ).otherwise(0.0)
    dollars = scores.dollar_volume_ok(F.col("entry"), F.col("volume"), asset_class)
    parts = {
        "zone": zone, "volume": scores.volume_score(F.col("relative_score"), volume_profile, dollars), "adx": F.coalesce("adx", F.lit(0.0)),
        "session": scores.session_score(asset_class, F.hour("ts")),
        "momentum": F.coalesce(scores.momentum_score(up, F.col("rsi_simple"), F.col("macd_hist"), F.col("macd_prev")), F.lit(0.0)),
        "agreement": agreement, "freshness": F.when(F.col("has_zone"), F.exp(F.lit(-0.15 * AGE))).otherwise(0.0),
    }
    flags = {
        "bias": F.col("bias") != 0, "bias_strong": F.col("bias_strong"), "h4": F.col("h4_ok"), "h4_poi": F.col("poi_top").isNotNull(),
        "h1": F.col("h1_ok"), "h1_choch": F.col("choch1h"), "trigger": F.col("precision"),
    }
    wrong = F.coalesce(F.col("dp_zone") == F.col("direction"), F.lit(False))
    return rows.withColumns({**{f"part_{k}": v for k, v in parts.items()}, "live_score": scores.live_score(flags, parts, wrong)})


def observations(bars: DataFrame) -> DataFrame:
    """The bar part of the short observation vector; zero before 50 bars."""
    rows = X.simple_rsi(X.simple_atr(X.ema(bars, {"ema20": 20, "ema50": 50})))
    rows = framed(
        materialize(rows), KEYS,
        lambda w: {
            "_v20": F.avg("volume").over(w.rowsBetween(-19, 0)),
            **{f"_c{k}": F.lag("close", k).over(w) for k in (1, 5, 20)},
        },
        before=20,
    )
    ok = (F.col("bar_idx") >= 49) & (F.col("close") > 0)
    x = F.col("close")
    ret = lambda k: F.when(F.col(f"_c{k}") > 0, (x - F.col(f"_c{k}")) / F.col(f"_c{k}")).otherwise(0.0)
    values = {
        "atr_share": F.col("atr_simple") / x, "ema20_distance": (x - F.col("ema20")) / x, "ema50_distance": (x - F.col("ema50")) / x,
        "ema_cross": (F.col("ema20") > F.col("ema50")).cast("double"), "volume_ratio": F.least(F.col("volume") / F.col("_v20"), F.lit(5.0)),
        "return_1": ret(1), "return_5": ret(5), "return_20": ret(20), "range_share": (F.col("high") - F.col("low")) / x,
        "rsi": F.col("rsi_simple") / 100,
    }
    return rows.select("symbol", "ts", "bar_idx", *[F.when(ok, v).otherwise(0.0).alias(k) for k, v in values.items()])


# Numbers of setup tiers and trade styles; unknown ones take the middle.
TIERS, STYLES, UNKNOWN = {"AAA+": 0.5, "AAA++": 1.0}, {"scalp": 0.0, "day": 0.5, "swing": 1.0}, 0.5
VECTOR = [
    "alignment_score", "direction_sign", "atr_share", "ema20_distance", "ema50_distance", "ema_cross", "volume_ratio", "return_1", "return_5", "return_20", "range_share", "rsi",
    "setup_tier", "trade_style", "rr_ratio", "daily_atr_pct", "adx", "session_score", "zone_quality", "volume_score", "momentum_score", "tf_agreement", "spread_quality", "asset_class_id",
]
# What a signal has where it says nothing.
UNSAID = {"alignment_score": 0.0, "rr_ratio": 3.0, "daily_atr_pct": 0.01, "adx": 0.0, "session_score": 0.5, "zone_quality": 0.0, "volume_score": 0.0, "momentum_score": 0.0, "tf_agreement": 0.0, "spread": 0.0}


def observation_vectors(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """``sig_id, symbol, ts`` and the 24 values of ``VECTOR`` of every signal, all zero before 50 bars.

    ``signals``: ``sig_id, symbol, bar_idx, direction``, and what else of
    ``UNSAID``, ``setup_tier``, ``trade_style`` and ``asset_class`` they have.
    """
    from tapeline.operators.outcomes import CLASS_IDS

    have = signals.columns
    said = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(UNSAID[c])) if c in have else F.lit(UNSAID[c])
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    named = lambda c, t, other: F.coalesce(table(t)[F.col(c)], F.lit(other)) if c in have else F.lit(other)
    unit = lambda c: scores.clip(c, 0.0, 1.0)
    own = {
        "alignment_score": said("alignment_score"), "direction_sign": F.when(F.col("direction") > 0, 1.0).otherwise(-1.0),
        "setup_tier": named("setup_tier", TIERS, UNKNOWN), "trade_style": named("trade_style", STYLES, UNKNOWN), "rr_ratio": F.least(said("rr_ratio") / 10, F.lit(1.0)),
        "daily_atr_pct": F.least(said("daily_atr_pct") * 10, F.lit(1.0)), "adx": F.least(said("adx"), F.lit(1.0)),
        **{c: unit(said(c)) for c in ("session_score", "zone_quality", "volume_score", "momentum_score", "tf_agreement")},
        "spread_quality": unit(1 - said("spread")), "asset_class_id": unit(named("asset_class", CLASS_IDS, 0.0)),
    }
    rows = signals.select("sig_id", "symbol", "bar_idx", *[v.alias(k) for k, v in own.items()]).join(observations(bars), ["symbol", "bar_idx"])
    close = bars.select("symbol", "bar_idx", F.col("close").alias("_close"))
    rows = rows.join(close, ["symbol", "bar_idx"])
    ready = (F.col("bar_idx") >= 49) & (F.col("_close") > 0)
    return rows.select("sig_id", "symbol", "ts", *[F.when(ready, F.col(c)).otherwise(0.0).alias(c) for c in VECTOR])
