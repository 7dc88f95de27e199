"""Models, live scores, observation vectors, parameter variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import TICKS, bars_cte, breaks_cte, swings_cte, with_
from tapeline.catalog.registry import R, query, r
from tapeline.catalog.structure_queries import _MOVES, _ema_cte
from tapeline.operators import models as M
from tapeline.operators import structure as S
from tapeline.operators import validation as V
from tapeline.operators.bars import bars_from_ticks
from tapeline.plans import live as E
from tapeline.plans import signals as G
from tapeline.session import materialize
from tapeline.sources import tables as T

FEATURES = ["x_price", "x_tax", "x_quantity"]


def _entries(spark, sf):
    s = T.samples(spark, sf).filter("label_action > 0")
    return materialize(s.select("sample_id", "window", *FEATURES, "label_rr", (F.col("label_outcome") == 1).cast("int").alias("y")))


def _profiles(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.stddev_samp("l_quantity").alias("spread"),
        F.sum("l_quantity").alias("volume"), F.avg("l_discount").alias("edge"),
    )


_P = ["price", "spread", "volume", "edge"]


@query("model_cluster_profiles")
def model_cluster_profiles(spark, sf):
    """Instruments in clusters of similar profile, with named centres."""
    c = M.cluster_profiles(materialize(_profiles(spark, sf)), _P, 4)
    out = M.name_clusters(materialize(c), _P)
    return out.select("cluster", "members", "name", *[r(x, 4).alias(x) for x in _P])


@query("model_entry_head_scores")
def model_entry_head_scores(spark, sf):
    """Win probability of late entries from a model of the early ones, and the gate on it."""
    e = _entries(spark, sf)
    model = M.fit_entry_head(e.filter("window < 4"), FEATURES, "y", trees=5, depth=3)
    scored = M.score(model, e.filter("window >= 4"), FEATURES, "probability")
    gated = M.gate(scored.withColumns({"tp": F.lit(3.0), "sl": F.lit(1.0)}), "probability", "tp", "sl", accept=0.5)
    return gated.groupBy("window", "accepted").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("wins"), r(F.avg("probability"), 4).alias("mean_probability"))


@query("model_value_head_errors")
def model_value_head_errors(spark, sf):
    e = _entries(spark, sf)
    model = M.fit_value_head(e.filter("window < 4"), FEATURES, "label_rr", trees=3, depth=3)
    scored = M.score(model, e.filter("window >= 4"), FEATURES, "predicted")
    return scored.groupBy("window").agg(
        F.count(F.lit(1)).alias("rows"), r(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("label_rr"), 2))), 4).alias("rmse")
    )


@query("model_permutation_importance")
def model_permutation_importance(spark, sf):
    e = _entries(spark, sf)
    model = M.fit_entry_head(e.filter("window < 4"), FEATURES, "y", trees=3, depth=3)
    return M.permutation_importance(model, e.filter("window >= 4"), FEATURES, "y", "sample_id").select("feature", "repeat", r("importance", 4).alias("importance"))


@query(
    "model_feature_stability",
    """WITH i AS (SELECT year(l_shipdate)::INT AS fold, 'part_' || (l_partkey % 30) AS feature, avg(l_extendedprice) AS importance FROM lineitem GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS r FROM i) SELECT feature, count(*) FILTER (r <= 10) AS folds_in_top,
    """ + R("avg(importance)", 3) + " AS mean_importance FROM k GROUP BY feature",
)
def model_feature_stability(spark, sf):
    from tapeline.operators.labels import feature_stability

    i = T.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("fold"), F.concat(F.lit("part_"), F.col("l_partkey") % 30).alias("feature")).agg(
        F.avg("l_extendedprice").alias("importance"))
    return feature_stability(i, 10).select("feature", "folds_in_top", r("mean_importance", 3).alias("mean_importance"))


@query(
    "model_parameter_variants",
    """WITH b AS (SELECT avg(l_discount) + 0.7 AS threshold, avg(l_quantity) / 10 AS min_rr FROM lineitem), m(variant, parameter, factor) AS (VALUES (0, 'threshold', 0.9::DOUBLE), (1, 'threshold', 1.1::DOUBLE), (2, 'min_rr', 0.5::DOUBLE), (3, 'min_rr', 2.0::DOUBLE))
    SELECT variant, parameter, """ + R("least(greatest(CASE WHEN parameter = 'threshold' THEN threshold * factor ELSE threshold END, 0.5), 0.8)") + " AS threshold, "
    + R("least(greatest(CASE WHEN parameter = 'min_rr' THEN min_rr * factor ELSE min_rr END, 1.5), 4)") + " AS min_rr FROM b, m",
)
def model_parameter_variants(spark, sf):
    base = T.table(spark, sf, "lineitem").agg((F.avg("l_discount") + 0.7).alias("threshold"), (F.avg("l_quantity") / 10).alias("min_rr"))
    out = V.variants_around(base, {"threshold": [0.9, 1.1], "min_rr": [0.5, 2.0]}, {"threshold": (0.5, 0.8), "min_rr": (1.5, 4.0)})
    return out.select("variant", "parameter", r("threshold").alias("threshold"), r("min_rr").alias("min_rr"))


@query(
    "observation_vectors",
    "WITH RECURSIVE " + ",\n".join([TICKS, bars_cte(), _MOVES, _ema_cte({"e20": 20, "e50": 50})])
    + f""", o AS (SELECT m.symbol, m.ts, m.bar_idx, close, high, low, volume, e20, e50, avg(tr) OVER w AS atr, avg(gain) OVER w AS g, avg(loss) OVER w AS l,
      avg(volume) OVER v AS v20, lag(close, 1) OVER x AS c1, lag(close, 5) OVER x AS c5, lag(close, 20) OVER x AS c20 FROM moves m JOIN emas e ON e.symbol = m.symbol AND e.bar_idx = m.bar_idx
      WINDOW w AS (PARTITION BY m.symbol ORDER BY m.bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), v AS (PARTITION BY m.symbol ORDER BY m.bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        x AS (PARTITION BY m.symbol ORDER BY m.bar_idx))
    SELECT symbol, ts, {R('atr / close')} AS atr_share, {R('(close - e20) / close')} AS ema20_distance, {R('least(volume / v20, 5)')} AS volume_ratio,
      {R('CASE WHEN c1 > 0 THEN (close - c1) / c1 ELSE 0 END')} AS return_1, {R('CASE WHEN c20 > 0 THEN (close - c20) / c20 ELSE 0 END')} AS return_20,
      {R('CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g / l) END / 100')} AS rsi FROM o WHERE bar_idx >= 49 AND close > 0""",
)
def observation_vectors(spark, sf):
    o = E.observations(T.bars(spark, sf)).filter("bar_idx >= 49")
    return o.select("symbol", "ts", *[r(c).alias(c) for c in ("atr_share", "ema20_distance", "volume_ratio", "return_1", "return_20", "rsi")])


_OWN = {
    "alignment_score": "b.bar_idx % 10 / 10.0", "direction_sign": "CASE WHEN k.sign > 0 THEN 1 ELSE -1 END",
    "setup_tier": "CASE b.bar_idx % 3 WHEN 1 THEN 1.0 ELSE 0.5 END", "trade_style": "CASE b.bar_idx % 4 WHEN 0 THEN 0.0 WHEN 2 THEN 1.0 ELSE 0.5 END", "rr_ratio": "least((2 + b.bar_idx % 12) / 10.0, 1)",
    "daily_atr_pct": "0.1", "adx": "least(b.bar_idx % 7 / 5.0, 1)", "session_score": "hour(b.ts) / 24.0", "zone_quality": "0.0", "volume_score": "least(b.volume / 10, 1)", "momentum_score": "0.0",
    "tf_agreement": "0.0", "spread_quality": "1 - (b.bar_idx % 5) / 5.0", "asset_class_id": "CASE length(b.symbol) % 4 WHEN 1 THEN 0.33 WHEN 2 THEN 0.66 WHEN 3 THEN 1.0 ELSE 0.0 END",
}
_BAR = {
    "atr_share": "atr / close", "ema20_distance": "(close - e20) / close", "ema50_distance": "(close - e50) / close", "ema_cross": "(e20 > e50)::INT", "volume_ratio": "least(volume / v20, 5)",
    "return_1": "CASE WHEN c1 > 0 THEN (close - c1) / c1 ELSE 0 END", "return_5": "CASE WHEN c5 > 0 THEN (close - c5) / c5 ELSE 0 END", "return_20": "CASE WHEN c20 > 0 THEN (close - c20) / c20 ELSE 0 END",
    "range_share": "(high - low) / close", "rsi": "CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g / l) END / 100",
}


@query(
    "observation_signal_vectors",
    "WITH RECURSIVE " + ",\n".join([TICKS, bars_cte(), _MOVES, _ema_cte({"e20": 20, "e50": 50}), swings_cte(5), breaks_cte()])
    + f""", o AS (SELECT m.symbol, m.ts, m.bar_idx, close, high, low, volume, e20, e50, avg(tr) OVER w AS atr, avg(gain) OVER w AS g, avg(loss) OVER w AS l,
      avg(volume) OVER v AS v20, lag(close, 1) OVER x AS c1, lag(close, 5) OVER x AS c5, lag(close, 20) OVER x AS c20 FROM moves m JOIN emas e ON e.symbol = m.symbol AND e.bar_idx = m.bar_idx
      WINDOW w AS (PARTITION BY m.symbol ORDER BY m.bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), v AS (PARTITION BY m.symbol ORDER BY m.bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        x AS (PARTITION BY m.symbol ORDER BY m.bar_idx)),
    b AS (SELECT o.*, k.sign FROM o JOIN breaks k ON k.symbol = o.symbol AND k.bar_idx = o.bar_idx)
    SELECT b.symbol || '-' || b.bar_idx AS sig_id, """
    + ", ".join(R(f"CASE WHEN b.bar_idx >= 49 AND close > 0 THEN {v.replace('k.sign', 'b.sign')} ELSE 0 END") + f" AS {c}" for c, v in {**_OWN, **_BAR}.items()) + " FROM b",
)
def observation_signal_vectors(spark, sf):
    """All 24 values of every break signal, the early ones too."""
    bars = T.bars(spark, sf)
    i = F.col("bar_idx")
    kind = F.element_at(F.array(*[F.lit(c) for c in ("crypto", "forex", "stocks", "commodities")]), F.length("symbol") % 4 + 1)
    sig = S.breaks(S.swings(bars, 5)).select("symbol", "bar_idx", "sign").join(bars.select("symbol", "bar_idx", "ts", "volume"), ["symbol", "bar_idx"]).select(
        F.concat_ws("-", "symbol", "bar_idx").alias("sig_id"), "symbol", "bar_idx", F.col("sign").alias("direction"), (i % 10 / 10).alias("alignment_score"),
        F.when(i % 3 == 0, "AAA+").when(i % 3 == 1, "AAA++").alias("setup_tier"), F.when(i % 4 == 0, "scalp").when(i % 4 == 1, "day").when(i % 4 == 2, "swing").alias("trade_style"),
        (2 + i % 12).alias("rr_ratio"), (i % 7 / 5).alias("adx"), (F.hour("ts") / 24).alias("session_score"), (F.col("volume") / 10).alias("volume_score"), (i % 5 / 5).alias("spread"), kind.alias("asset_class"))
    out = E.observation_vectors(sig, bars)
    return out.select("sig_id", *[r(c).alias(c) for c in E.VECTOR])


@query("signal_live_scores")
def signal_live_scores(spark, sf):
    p = G.SignalParams(swing_length=3, threshold=0.40)
    t = G.structure_tables(G.series_table(materialize(bars_from_ticks(T.ticks(spark, sf), "5m"))), p)
    out = E.live_scores(t, materialize(G.running_state(t, p)), p)
    return out.select(F.col("sym").alias("symbol"), "ts", "direction", r("live_score").alias("live_score"), r("part_zone").alias("zone_quality"), r("part_agreement").alias("agreement"))
