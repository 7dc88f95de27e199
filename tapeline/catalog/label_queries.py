"""Labels, weights, what-if results, samples and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import SAMPLES, TRADES, with_
from tapeline.catalog.registry import R, query, r
from tapeline.operators import labels as L
from tapeline.operators import sampling as P
from tapeline.operators import training_rows as R_
from tapeline.sources import tables as T

SM = with_(SAMPLES)
CLIP_RR = "least(greatest(label_rr, -1), 20)"


@query(
    "label_hindsight_targets",
    SM + f"""SELECT sample_id, (mfe >= 1 AND mfe > mae * 1.5 AND label_outcome = 1)::INT AS optimal_entry,
    {R('least(greatest(mae * 1.1::DOUBLE, 1), 3)')} AS optimal_sl_rr, {R('least(greatest(mfe * 0.85::DOUBLE, 0.5), 10)')} AS optimal_tp_rr,
    {R('least(greatest(mfe / greatest(mae, 0.3::DOUBLE), 0.5), 2)')} AS optimal_size FROM samples""",
)
def label_hindsight_targets(spark, sf):
    t = T.samples(spark, sf).withColumns(L.hindsight_targets())
    return t.select("sample_id", "optimal_entry", *[r(c).alias(c) for c in ("optimal_sl_rr", "optimal_tp_rr", "optimal_size")])


@query(
    "label_model_heads",
    SM + f"""SELECT sample_id, {R('least(greatest(label_rr, -1), 10)')} AS label_size,
    {R('least(greatest(coalesce(post_tp, mfe), 0), 20)')} AS label_tp,
    {R('CASE label_outcome WHEN 2 THEN CASE WHEN mfe >= 1.5 THEN 1 WHEN mfe >= 1 THEN 0.7 ELSE 0 END WHEN 1 THEN least(mfe * 0.4::DOUBLE, 2.5) ELSE 1.5 END')} AS label_be,
    {R('CASE label_outcome WHEN 1 THEN CASE WHEN mae < 0.3::DOUBLE THEN 1 WHEN mae < 0.6::DOUBLE THEN 0.5 ELSE 0 END WHEN 2 THEN CASE WHEN mfe >= 1 THEN -1 WHEN mfe >= 0.5 THEN -0.5 ELSE 0 END ELSE 0 END')} AS label_sl
    FROM samples""",
)
def label_model_heads(spark, sf):
    t = T.samples(spark, sf).withColumns(L.head_labels())
    return t.select("sample_id", *[r(c).alias(c) for c in ("label_size", "label_tp", "label_be", "label_sl")])


@query(
    "label_sample_weights",
    with_(SAMPLES, "w AS (SELECT *, abs(label_rr) AS rr, least(greatest(mfe / greatest(tp_rr, 0.1::DOUBLE), 0), 1.5) AS way FROM samples)")
    + f"""SELECT sample_id, {R('''CASE mech WHEN 1 THEN least(greatest(rr, 1), 5)
      WHEN 2 THEN least(greatest(rr, 0.1), 1.5) * CASE WHEN way > 0.60::DOUBLE THEN 0.3 WHEN way > 0.20::DOUBLE THEN 0.7 ELSE 1 END
      WHEN 3 THEN CASE WHEN way >= 0.30::DOUBLE THEN 0.3 ELSE 0.1 END
      WHEN 4 THEN CASE WHEN way >= 0.60::DOUBLE THEN least(greatest(way * least(greatest(rr, 0.1), 5), 0.5), 4) WHEN way >= 0.20::DOUBLE THEN 0.3 ELSE 0.5 END
      ELSE CASE WHEN label_outcome = 1 THEN least(greatest(rr, 1), 5) ELSE least(greatest(rr, 0.1), 1.5) END END''')} AS weight FROM w""",
)
def label_sample_weights(spark, sf):
    return T.samples(spark, sf).select("sample_id", r(L.sample_weight()).alias("weight"))


_GRADES = ["A+", "A", "B+", "B", "C", "D"]
_REASONS = ["tp_hit", "sl_hit", "timeout", "be_stop", "manual"]


@query(
    "label_live_weights",
    with_(SAMPLES, f"""w AS (SELECT *, abs(label_rr) AS rr, least(greatest(mfe / greatest(tp_rr, 0.1::DOUBLE), 0), 1.5) AS way, label_outcome = 1 AS won,
      ({_GRADES})[((mech + label_action) % 6 + 1)::INT] AS grade, ({_REASONS})[mech + 1] AS er FROM samples),
      x AS (SELECT *, CASE WHEN (er = 'tp_hit' AND NOT won) OR (er = 'sl_hit' AND won) THEN 'manual' ELSE er END AS e2 FROM w)""")
    + f"""SELECT sample_id, grade, {R('''least(greatest(2 * CASE grade WHEN 'A+' THEN 1.5::DOUBLE WHEN 'A' THEN 1.5 WHEN 'C' THEN 0.8 WHEN 'D' THEN 0.5 ELSE 1 END
      * CASE e2 WHEN 'tp_hit' THEN greatest(rr, 1)
        WHEN 'sl_hit' THEN greatest(least(rr, 1.5) * CASE WHEN way > 0.60::DOUBLE THEN 0.3::DOUBLE WHEN way > 0.20::DOUBLE THEN 0.7::DOUBLE ELSE 1 END, 0.1)
        WHEN 'timeout' THEN CASE WHEN way >= 0.60::DOUBLE THEN least(way * greatest(rr, 1), 4) WHEN way >= 0.20::DOUBLE THEN 0.3 ELSE 0.5 END
        WHEN 'be_stop' THEN CASE WHEN way >= 0.30::DOUBLE THEN 0.3 ELSE 0.1 END ELSE 1 END
      * CASE WHEN grade = 'D' AND NOT won THEN 3 ELSE 1 END, 0.1), 10)''')} AS weight FROM x""",
)
def label_live_weights(spark, sf):
    s = T.samples(spark, sf)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    g = pick(_GRADES, (F.col("mech") + F.col("label_action")) % 6 + 1)
    way = L.clip(F.col("mfe") / F.greatest(F.col("tp_rr"), F.lit(0.1)), 0.0, 1.5)
    w = L.live_weight(g, pick(_REASONS, F.col("mech") + 1), F.col("label_outcome") == 1, F.abs("label_rr"), way)
    return s.select("sample_id", g.alias("grade"), r(w).alias("weight"))


@query(
    "label_counterfactual_rows",
    SM + """SELECT sample_id, CASE WHEN label_outcome = 1 THEN 1 WHEN label_outcome = 2 THEN 0
      ELSE CASE WHEN mfe / 100 / (abs(100 + tp_rr * 2 - 100) / 100) > 0.6::DOUBLE THEN 1 ELSE 0 END END AS label, 0.3::DOUBLE AS sample_weight FROM samples WHERE label_action = 0""",
)
def label_counterfactual_rows(spark, sf):
    s = T.samples(spark, sf).filter("label_action = 0")
    outcome = F.when(F.col("label_outcome") == 1, "win").when(F.col("label_outcome") == 2, "loss").otherwise("timeout")
    label = L.counterfactual_label(outcome, F.col("mfe") / 100, F.lit(100.0), F.lit(99.0), 100 + F.col("tp_rr") * 2)
    return s.select("sample_id", label.alias("label"), F.lit(0.3).alias("sample_weight"))


@query(
    "label_missed_wins",
    SM + """SELECT sample_id, 1 AS label, 1.0::DOUBLE AS sample_weight FROM samples WHERE label_action = 0
      AND CASE WHEN x_tax / 2 < 0.005::DOUBLE THEN label_outcome = 1 WHEN x_tax / 2 > 0.02::DOUBLE THEN mech = 1 ELSE label_outcome = 1 AND mech < 3 END""",
)
def label_missed_wins(spark, sf):
    s = T.samples(spark, sf).filter("label_action = 0").withColumn("style", L.style_id(F.col("x_tax") / 2))
    win = F.col("label_outcome") == 1
    by_style = F.when(F.col("style") == 0.0, win).when(F.col("style") == 1.0, F.col("mech") == 1).otherwise(win & (F.col("mech") < 3))
    return s.filter(by_style).select("sample_id", F.lit(1).alias("label"), F.lit(1.0).alias("sample_weight"))


@query(
    "label_trade_grades",
    with_(SAMPLES, """p AS (SELECT *, (mech IN (1, 2))::INT + (mech IN (1, 3))::INT + (label_action = 1)::INT + (mae > 0.3::DOUBLE)::INT + (mfe >= tp_rr)::INT
      + (abs(x_tax * 100) < 5)::INT + (label_rr > 0)::INT - (mech = 4)::INT + (mech = 1 AND label_rr > 0)::INT AS points FROM samples)""")
    + """SELECT CASE WHEN points >= 7 THEN 'A+' WHEN points >= 6 THEN 'A' WHEN points >= 5 THEN 'B+' WHEN points >= 4 THEN 'B'
      WHEN points >= 2 THEN 'C' ELSE 'D' END AS grade, count(*) AS trades FROM p GROUP BY 1""",
)
def label_trade_grades(spark, sf):
    c = F.col
    g = L.grade(c("mech").isin(1, 2), c("mech").isin(1, 3), c("label_action") == 1, ~(c("mae") > 0.3), c("mfe") >= c("tp_rr"),
                c("x_tax") * 100, c("label_rr"), F.when(c("mech") == 4, "timeout").when(c("mech") == 1, "tp_hit").otherwise("sl_hit"))
    return T.samples(spark, sf).groupBy(g.alias("grade")).agg(F.count(F.lit(1)).alias("trades"))


@query(
    "label_shaped_reward",
    SM + f"""SELECT sample_id, {R('''label_rr / 100 * CASE WHEN label_rr > 0 AND tp_rr > 0 THEN 1 + 0.2::DOUBLE * least(label_rr / tp_rr, 2) ELSE 1 END
      * CASE WHEN mech = 1 THEN 1.5 WHEN mech = 2 THEN 1.2 ELSE 1 END - CASE WHEN label_outcome = 2 AND x_quantity * 50 <= 3 THEN 0.5 ELSE 0 END''', 8)} AS reward FROM samples""",
)
def label_shaped_reward(spark, sf):
    c = F.col
    tier = F.when(c("mech") == 1, "AAA++").when(c("mech") == 2, "AAA+").otherwise("-")
    rew = L.shaped_reward(c("label_rr") / 100, c("label_rr"), c("tp_rr"), tier, c("x_quantity") * 50, c("label_outcome") == 2)
    return T.samples(spark, sf).select("sample_id", r(rew, 8).alias("reward"))


_FEATURES = ["x_price", "x_tax", "x_quantity"]


@query(
    "label_feature_preparation",
    SM + """SELECT sample_id, least(greatest(x_price, -3), 3)::FLOAT AS x_price, x_tax::FLOAT AS x_tax,
      (CASE WHEN mech = 3 THEN 5 ELSE x_quantity END)::FLOAT AS x_quantity,
      (list_position(['crypto', 'forex', 'stocks', 'commodities'], asset_class) - 1)::FLOAT AS asset_class_id, 0.5::FLOAT AS style_id FROM samples""",
)
def label_feature_preparation(spark, sf):
    s = T.samples(spark, sf).withColumn("x_quantity", F.when(F.col("mech") == 3, float("inf")).otherwise(F.col("x_quantity")))
    return L.prepare_features(s, _FEATURES, {"x_price": (-3.0, 3.0)}).select("sample_id", *_FEATURES, "asset_class_id", "style_id")


@query(
    "label_range_violations",
    with_(SAMPLES, "n AS (SELECT count(*) AS n FROM samples)")
    + """SELECT (SELECT n FROM n) AS "rows", 'x_price' AS "column", count(*) FILTER (x_price < 0.95 OR x_price > 1.5) AS violations FROM samples
      UNION ALL SELECT (SELECT n FROM n), 'x_tax', count(*) FILTER (x_tax < 0.01 OR x_tax > 0.07) FROM samples
      UNION ALL SELECT (SELECT n FROM n), 'post_tp', count(*) FILTER (post_tp IS NULL OR post_tp < 0 OR post_tp > 5) FROM samples""",
)
def label_range_violations(spark, sf):
    return L.range_violations(T.samples(spark, sf), {"x_price": (0.95, 1.5), "x_tax": (0.01, 0.07), "post_tp": (0.0, 5.0)})


_ENTRY = with_(SAMPLES, "e AS (SELECT * FROM samples WHERE label_action > 0)")
_VAR = {
    "original": CLIP_RR,
    "tp_adjusted": f"""(SELECT least(greatest(CASE WHEN coalesce(post_tp, mfe) >= t THEN t - cost_rr ELSE {CLIP_RR} END, -1), 20) FROM (SELECT CASE
      WHEN x_quantity * 6 < tp_rr * 0.7::DOUBLE THEN greatest(x_quantity * 6 * 0.85::DOUBLE, 0.5) WHEN x_quantity * 6 > tp_rr * 1.3::DOUBLE
      THEN least(x_quantity * 6 * 0.8::DOUBLE, tp_rr * 1.5) ELSE tp_rr END AS t))""",
    "fixed_be": f"CASE WHEN label_outcome = 2 AND mfe >= 1.5 THEN -cost_rr ELSE {CLIP_RR} END",
    "model_be": f"CASE WHEN label_outcome = 2 AND x_quantity * 3 > 0.1::DOUBLE AND mfe >= x_quantity * 3 THEN -cost_rr ELSE {CLIP_RR} END",
    "sl_adjusted": f"""(SELECT least(greatest(CASE WHEN m < 1 AND mae > m THEN -m - cost_rr WHEN m > 1 AND label_outcome = 2 AND mae < m THEN -cost_rr ELSE {CLIP_RR} END, -2), 20)
      FROM (SELECT CASE WHEN p > 0.75 THEN 0.5::DOUBLE WHEN p > 0.25 THEN 0.7::DOUBLE WHEN p < -0.75 THEN 1.3::DOUBLE WHEN p < -0.25 THEN 1.15::DOUBLE ELSE 1 END AS m
            FROM (SELECT x_quantity * 2 - 1 AS p)))""",
}


@query(
    "what_if_exits",
    _ENTRY + f"""SELECT variant, count(*) AS n_trades, {R('avg(rr) / greatest(stddev_pop(rr), 1e-6)')} AS sharpe,
      {R('sum(greatest(rr, 0)) / greatest(abs(sum(least(rr, 0))), 0.001)')} AS pf, {R('avg((rr > 0)::INT)')} AS win_rate,
      {R('min(c - pk)', 4)} AS max_dd FROM (SELECT *, max(c) OVER (PARTITION BY variant ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS pk FROM (
      SELECT *, sum(rr) OVER (PARTITION BY variant ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) AS c FROM ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS variant, ts, sample_id, {x} AS rr FROM e" for n, x in _VAR.items()) + "))) GROUP BY variant",
)
def what_if_exits(spark, sf):
    e = T.samples(spark, sf).filter("label_action > 0")
    q = F.col("x_quantity")
    variants = {
        "original": L.clip(F.col("label_rr"), -1.0, 20.0), "tp_adjusted": L.what_if_tp(q * 6), "fixed_be": L.what_if_be(F.lit(1.5)),
        "model_be": L.what_if_be(q * 3), "sl_adjusted": L.what_if_sl(q * 2 - 1),
    }
    out = L.r_metrics(e, variants, "ts", "sample_id")
    return out.select("variant", "n_trades", r("sharpe").alias("sharpe"), r("pf").alias("pf"), r("win_rate").alias("win_rate"), r("max_dd", 4).alias("max_dd"))


_STOP, _TARGET, _LEVEL = "(0.5 + x_quantity)", "(x_quantity * 4)", "(x_quantity * 3)"
_SCALED = f"""(CASE WHEN {_STOP} < 0.99 AND mae > {_STOP} THEN -{_STOP} - cost_rr WHEN {_STOP} > 1.01 AND label_outcome = 2 AND mae < {_STOP} AND mfe >= 1 THEN mfe * 0.5 / {_STOP} - cost_rr
  WHEN ({_STOP} < 0.99 OR {_STOP} > 1.01) AND label_outcome = 1 THEN label_rr / {_STOP} ELSE label_rr END)"""
_TARGETED = f"(CASE WHEN abs({_TARGET} - tp_rr) > 0.01 AND coalesce(post_tp, mfe) >= {_TARGET} THEN {_TARGET} - cost_rr ELSE {{}} END)"
_LEVELLED = f"(CASE WHEN {_LEVEL} > 0.1 AND label_outcome = 2 AND mfe >= {_LEVEL} THEN -cost_rr ELSE {{}} END)"


@query(
    "what_if_exit_combos",
    SM + "SELECT sample_id, " + ", ".join(f"{R(f'least(greatest({x}, -2), 20)')} AS {n}" for n, x in {
        "stop_only": _SCALED, "target_only": _TARGETED.format("label_rr"), "level_only": _LEVELLED.format("label_rr"), "all_three": _LEVELLED.format(_TARGETED.format(_SCALED))}.items())
    + " FROM samples WHERE label_action > 0",
)
def what_if_exit_combos(spark, sf):
    q = F.col("x_quantity")
    stop, target, level = q + 0.5, q * 4, q * 3
    combos = {"stop_only": L.what_if_combo(stop), "target_only": L.what_if_combo(target=target), "level_only": L.what_if_combo(level=level), "all_three": L.what_if_combo(stop, target, level)}
    return T.samples(spark, sf).filter("label_action > 0").select("sample_id", *[r(c).alias(n) for n, c in combos.items()])


@query(
    "what_if_accepted_variants",
    with_(SAMPLES, "v(variant, threshold) AS (VALUES ('loose', 0.3::DOUBLE), ('base', 0.6::DOUBLE), ('tight', 0.9::DOUBLE))",
          """p AS (SELECT variant, asset_class, label_rr, CASE WHEN label_outcome = 1 THEN abs(label_rr) * 0.005 ELSE -0.005 END - 0.0008 AS pnl FROM samples JOIN v ON x_quantity >= threshold)""")
    + f"""SELECT variant, asset_class, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, {R('100.0 * count(*) FILTER (pnl > 0) / count(*)')} AS win_rate,
    {R('least(sum(greatest(pnl, 0)) / CASE WHEN sum(greatest(-pnl, 0)) > 0 THEN sum(greatest(-pnl, 0)) ELSE 0.001 END, 99.9)')} AS pf, {R('avg(abs(label_rr))')} AS avg_rr,
    {R('sum(pnl) * 100', 4)} AS total_pnl_pct, {R('CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) * sqrt(252) ELSE 0 END', 4)} AS sharpe FROM p GROUP BY ALL""",
)
def what_if_accepted_variants(spark, sf):
    v = spark.createDataFrame([("loose", 0.3), ("base", 0.6), ("tight", 0.9)], "variant string, threshold double")
    out = L.accepted_result(T.samples(spark, sf), v, "x_quantity")
    digits = {"win_rate": 6, "pf": 6, "avg_rr": 6, "total_pnl_pct": 4, "sharpe": 4}
    return out.select("variant", "asset_class", "trades", "wins", *[r(c, d).alias(c) for c, d in digits.items()])


@query(
    "what_if_sizing",
    with_(SAMPLES, f"""t AS (SELECT a, a * least(greatest(p / 3, 0.33::DOUBLE), 1.5) AS s, p FROM (SELECT {CLIP_RR} AS a, x_quantity * 4 AS p FROM samples WHERE label_action > 0))""")
    + f"""SELECT count(*) AS n_trades, {R('avg(a) / greatest(stddev_pop(a), 1e-6)')} AS uniform_sharpe, {R('sum(greatest(a, 0)) / greatest(abs(sum(least(a, 0))), 0.001)')} AS uniform_pf,
      {R('avg(s) / greatest(stddev_pop(s), 1e-6)')} AS model_sharpe, {R('sum(greatest(s, 0)) / greatest(abs(sum(least(s, 0))), 0.001)')} AS model_pf,
      {R('corr(p, a)')} AS pred_corr, {R('sqrt(avg((p - a) * (p - a)))')} AS rmse FROM t""",
)
def what_if_sizing(spark, sf):
    out = L.sizing_comparison(T.samples(spark, sf).filter("label_action > 0"), F.col("x_quantity") * 4)
    return out.select("n_trades", *[r(c).alias(c) for c in out.columns if c != "n_trades"])


@query(
    "sample_window_stats",
    SM + f"""SELECT "window", asset_class, count(*) AS rows, count(*) FILTER (label_action > 0) AS entries,
      count(*) FILTER (label_action > 0 AND label_outcome = 1) AS wins, {R('count(*) FILTER (label_action > 0 AND label_outcome = 1) / count(*) FILTER (label_action > 0)')} AS win_rate
      FROM samples GROUP BY ALL""",
)
def sample_window_stats(spark, sf):
    entry = F.col("label_action") > 0
    win = F.count_if(entry & (F.col("label_outcome") == 1))
    return T.samples(spark, sf).groupBy("window", "asset_class").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(entry).alias("entries"), win.alias("wins"), r(win / F.count_if(entry)).alias("win_rate")
    )


@query(
    "sample_folds",
    with_(SAMPLES, "f AS (SELECT DISTINCT \"window\" AS w FROM samples WHERE \"window\" >= 4)")
    + """SELECT f.w - 4 AS fold, CASE WHEN s."window" = f.w THEN 'test' WHEN s."window" = f.w - 1 THEN 'validation' ELSE 'train' END AS role,
      count(*) AS rows, count(*) FILTER (label_outcome = 1) AS wins FROM samples s JOIN f ON s."window" <= f.w GROUP BY ALL""",
)
def sample_folds(spark, sf):
    folds = P.expanding_folds(T.samples(spark, sf), min_train=3)
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label_outcome") == 1).alias("wins"))


@query(
    "sample_group_split",
    with_(SAMPLES, 'e AS (SELECT min("window") + floor((max("window") - min("window") + 1) * 0.8::DOUBLE) AS edge FROM samples)')
    + """SELECT CASE WHEN "window" < edge THEN 'train' ELSE 'test' END AS role, count(*) AS rows FROM samples, e GROUP BY 1""",
)
def sample_group_split(spark, sf):
    return P.group_split(T.samples(spark, sf), "window").groupBy("role").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sample_class_holdout",
    SM + "SELECT CASE WHEN asset_class = 'crypto' THEN 'test' ELSE 'train' END AS role, count(*) AS rows FROM samples GROUP BY 1",
)
def sample_class_holdout(spark, sf):
    return P.holdout(T.samples(spark, sf), "asset_class", "crypto").groupBy("role").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sample_late_windows",
    with_(SAMPLES, 'e AS (SELECT floor((max("window") + 1) * (2 / 3::DOUBLE)) AS edge FROM samples)')
    + 'SELECT "window", count(*) AS rows FROM samples, e WHERE "window" >= edge GROUP BY 1',
)
def sample_late_windows(spark, sf):
    return P.out_of_sample_part(T.samples(spark, sf), "window").groupBy("window").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sample_no_trade_counts",
    SM + """SELECT asset_class, count(*) FILTER (label_action > 0) AS entries,
      least(floor(count(*) FILTER (label_action > 0) * 0.25)::BIGINT, count(*) FILTER (label_action = 0)) AS no_trade FROM samples GROUP BY 1""",
)
def sample_no_trade_counts(spark, sf):
    s = P.subsample_no_trade(T.samples(spark, sf), 0.25, "sample_id")
    return s.groupBy("asset_class").agg(F.count_if(F.col("label_action") > 0).alias("entries"), F.count_if(F.col("label_action") == 0).alias("no_trade"))


@query("sample_stratified_counts", SM + "SELECT asset_class, label_outcome, round(count(*) * 0.3)::BIGINT AS rows FROM samples GROUP BY ALL")
def sample_stratified_counts(spark, sf):
    s = P.stratified(T.samples(spark, sf), ["asset_class", "label_outcome"], 0.3, "sample_id")
    return s.groupBy("asset_class", "label_outcome").agg(F.count(F.lit(1)).alias("rows"))


@query("sample_balanced_counts", with_(SAMPLES, "c AS (SELECT label_outcome, count(*) AS n FROM samples GROUP BY 1)") + "SELECT label_outcome, (SELECT min(n) FROM c) AS rows FROM c")
def sample_balanced_counts(spark, sf):
    s = P.balanced(T.samples(spark, sf), "label_outcome", "sample_id")
    return s.groupBy("label_outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sample_capped_counts",
    with_(SAMPLES, 'c AS (SELECT "window", count(*) AS n FROM samples GROUP BY 1)')
    + 'SELECT "window", floor(n * least(1, 20000 / (SELECT sum(n) FROM c)::DOUBLE))::BIGINT AS rows FROM c',
)
def sample_capped_counts(spark, sf):
    s = P.cap_rows(T.samples(spark, sf), "window", 20_000, "sample_id")
    return s.groupBy("window").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sample_recency_weights",
    with_(SAMPLES, """n AS (SELECT *, row_number() OVER (PARTITION BY asset_class ORDER BY ts, sample_id) - 1 AS i, count(*) OVER (PARTITION BY asset_class) AS n FROM samples)""")
    + f"SELECT sample_id, {R('exp(-ln(2) * (n - 1 - i) / 500)')} AS recency_weight FROM n",
)
def sample_recency_weights(spark, sf):
    s = T.samples(spark, sf).select("sample_id", "asset_class", "ts")
    return P.recency_weight(s, ["asset_class"], "ts", "sample_id", 500.0).select("sample_id", r("recency_weight").alias("recency_weight"))


@query(
    "sample_window_weights",
    with_(SAMPLES, 'm AS (SELECT max("window") AS m FROM samples)')
    + f"""SELECT "window", {R('exp(("window" - m) / (0.3::DOUBLE * greatest(m, 1)))')} AS recency_weight, count(*) AS rows FROM samples, m GROUP BY ALL""",
)
def sample_window_weights(spark, sf):
    w = P.window_weight(T.samples(spark, sf))
    return w.groupBy("window", r("recency_weight").alias("recency_weight")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "sample_fused_sources",
    with_(SAMPLES, """live AS (SELECT *, row_number() OVER (ORDER BY ts, sample_id) - 1 AS i, count(*) OVER () AS n FROM samples WHERE label_action = 1)""")
    + """SELECT 'live' AS source, CASE WHEN i >= floor(n * (1 - 0.3::DOUBLE)) THEN 'validation' ELSE 'train' END AS role, count(*) AS rows FROM live GROUP BY ALL
      UNION ALL SELECT CASE label_action WHEN 0 THEN 'counterfactual' ELSE 'backtest' END, 'train', count(*) FROM samples WHERE label_action <> 1 GROUP BY ALL""",
)
def sample_fused_sources(spark, sf):
    s = T.samples(spark, sf).select("sample_id", "ts", "label_action", "label_outcome")
    part = lambda a: s.filter(F.col("label_action") == a)
    return P.fuse(part(2), part(1), part(0), "ts", "sample_id").groupBy("source", "role").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "walk_forward_windows",
    with_(TRADES, """lim AS (SELECT DATE '1995-01-01' AS a, max(exit_time)::DATE AS z FROM trades),
    w AS (SELECT i AS window_id, (a + to_months((i * 3)::INT))::DATE AS train_start, (a + to_months((i * 3 + 6)::INT))::DATE AS train_end,
      (a + to_months((i * 3 + 6)::INT))::DATE AS test_start, (a + to_months((i * 3 + 9)::INT))::DATE AS test_end FROM lim, range(0, 40) t(i))""")
    + """SELECT w.*, count(t.trade_id) AS test_trades FROM w LEFT JOIN trades t ON t.entry_time >= test_start AND t.entry_time < test_end
      WHERE test_end <= DATE '2001-10-01' GROUP BY ALL""",
)
def walk_forward_windows(spark, sf):
    w = P.walk_forward_windows(spark, "1995-01-01", "2001-10-01")
    t = T.trades(spark, sf).select("trade_id", "entry_time")
    inside = (F.col("entry_time") >= F.col("test_start").cast("timestamp")) & (F.col("entry_time") < F.col("test_end").cast("timestamp"))
    hits = t.join(F.broadcast(w), inside).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("window_id", F.col("window_id").cast("long")).join(hits, "window_id", "left").withColumn(
        "test_trades", F.coalesce("n", F.lit(0))
    ).drop("n")


_REJECTED = """rej AS (SELECT sample_id, symbol, (mech % 2)::INT AS direction, ts, mfe / 100 AS mfe, 100 + tp_rr * 2 AS tp, x_price, x_tax, x_quantity, mech, label_outcome, x_tax * 10 AS style,
    CASE label_outcome WHEN 1 THEN 'win' WHEN 2 THEN 'loss' ELSE 'timeout' END AS scalp, CASE WHEN label_outcome = 1 AND mech < 3 THEN 'win' ELSE 'loss' END AS day, CASE WHEN mech = 1 THEN 'win' ELSE 'loss' END AS swing
    FROM samples WHERE label_action = 0)"""


def _spacing(source):
    """Greedy spacing of half an hour, row by row."""
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY ts, sample_id) AS rn FROM {source}),
    g AS (SELECT symbol, direction, rn, ts AS kept, true AS keep FROM n WHERE rn = 1
      UNION ALL SELECT n.symbol, n.direction, n.rn, CASE WHEN n.ts >= g.kept + INTERVAL 1800 SECOND THEN n.ts ELSE g.kept END, n.ts >= g.kept + INTERVAL 1800 SECOND FROM g JOIN n ON n.symbol = g.symbol AND n.direction = g.direction AND n.rn = g.rn + 1),
    k AS (SELECT n.* FROM n JOIN g USING (symbol, direction, rn) WHERE g.keep)"""


def rejected(spark, sf):
    """Samples without a trade as rejected signals; every fifth kind lacks a feature."""
    s = T.samples(spark, sf).filter("label_action = 0")
    say = lambda c, other="loss": F.when(c, "win").otherwise(other)
    pair = lambda k, c: (F.lit(k), F.col(c) * 10 if k == "style_id" else F.col(c))
    full = F.create_map(*[x for k, c in (("x_price", "x_price"), ("x_tax", "x_tax"), ("style_id", "x_tax"), ("x_quantity", "x_quantity")) for x in pair(k, c)])
    part = F.create_map(*[x for k, c in (("x_price", "x_price"), ("x_tax", "x_tax"), ("style_id", "x_tax")) for x in pair(k, c)])
    won = F.col("label_outcome") == 1
    return s.select(
        "sample_id", "symbol", (F.col("mech") % 2).alias("direction"), "ts", F.lit(100.0).alias("entry_price"), F.lit(99.0).alias("sl_price"), (100 + F.col("tp_rr") * 2).alias("tp_price"),
        F.when(F.col("mech") == 4, part).otherwise(full).alias("entry_features"), (F.col("mfe") / 100).alias("mfe_scalp"), F.when(won, "win").when(F.col("label_outcome") == 2, "loss").otherwise("timeout").alias("outcome_scalp"),
        say(won & (F.col("mech") < 3)).alias("outcome_day"), say(F.col("mech") == 1).alias("outcome_swing"))


@query(
    "label_counterfactual_spaced",
    "WITH RECURSIVE " + ",\n".join([SAMPLES, _REJECTED, _spacing("rej")])
    + """ SELECT sample_id, CASE scalp WHEN 'win' THEN 1 WHEN 'loss' THEN 0 ELSE CASE WHEN mfe / (abs(tp - 100) / 100) > 0.6::DOUBLE THEN 1 ELSE 0 END END AS label, 0.3::DOUBLE AS sample_weight FROM k WHERE mech <> 4""",
)
def label_counterfactual_spaced(spark, sf):
    return R_.counterfactual_rows(rejected(spark, sf), ["x_price", "x_tax", "x_quantity"], tie="sample_id").select("sample_id", "label", "sample_weight")


@query(
    "label_missed_win_rows",
    "WITH RECURSIVE " + ",\n".join([SAMPLES, _REJECTED, """w AS (SELECT * FROM rej WHERE mech <> 4 AND 'win' = CASE WHEN style <= 0.25 THEN scalp WHEN style > 0.75 THEN swing ELSE day END)""", _spacing("w")])
    + " SELECT sample_id, CASE WHEN style <= 0.25 THEN 0.0 WHEN style > 0.75 THEN 1.0 ELSE 0.5 END::DOUBLE AS style, 1 AS label, 1.0::DOUBLE AS sample_weight FROM k",
)
def label_missed_win_rows(spark, sf):
    return R_.missed_win_rows(rejected(spark, sf), ["x_price", "x_tax", "x_quantity"], tie="sample_id").select("sample_id", "style", "label", "sample_weight")


@query(
    "label_live_training_rows",
    with_(TRADES) + f"""SELECT trade_id, asset_class, {R('score')} AS score, 0.0::DOUBLE AS absent, CASE outcome WHEN 'win' THEN 1 WHEN 'loss' THEN 2 ELSE 3 END AS label_outcome,
    CASE outcome WHEN 'win' THEN 1 WHEN 'loss' THEN 2 ELSE 4 END AS label_exit_mechanism, {R('rr_target')} AS label_tp_rr,
    {R('CASE WHEN leverage % 2 = 0 THEN least(abs(pnl_pct) * 1.5::DOUBLE / (abs(entry_price * 0.98::DOUBLE - entry_price) / entry_price), 20) ELSE 0 END')} AS mfe_rr,
    {R('CASE WHEN leverage % 2 = 0 THEN least(abs(pnl_pct) * 3 / (abs(entry_price * 0.98::DOUBLE - entry_price) / entry_price), 5) ELSE 0 END')} AS mae_rr, 2.0::DOUBLE AS sample_weight FROM trades WHERE outcome IS NOT NULL""",
)
def label_live_training_rows(spark, sf):
    """Trades as training rows; half of them have no stop distance to measure by."""
    t = T.trades(spark, sf).withColumns({
        "exit_reason": F.when(F.col("outcome") == "win", "tp_hit").when(F.col("outcome") == "loss", "sl_hit"), "sl_original": F.when(F.col("leverage") % 2 == 0, F.col("entry_price") * 0.98).otherwise(F.col("entry_price")),
        "max_favorable_pct": F.abs("pnl_pct") * 1.5, "max_adverse_pct": F.abs("pnl_pct") * 3, "entry_features": F.create_map(F.lit("score"), F.col("score").cast("double"))})
    out = R_.live_rows(t, ["score", "absent"])
    return out.select("trade_id", "asset_class", r("score").alias("score"), "absent", "label_outcome", "label_exit_mechanism", r("label_tp_rr").alias("label_tp_rr"),
                      r("label_max_favorable_rr").alias("mfe_rr"), r("label_mae_rr").alias("mae_rr"), "sample_weight")


@query(
    "label_value_faults",
    with_(SAMPLES, """v AS (SELECT mech, post_tp, CASE mech WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE x_price END AS x FROM samples)""",
          "n AS (SELECT count(*) AS n, count(*) FILTER (mech = 0) AS a, count(*) FILTER (mech = 1) AS b, count(*) FILTER (mech = 2) AS c, count(*) FILTER (post_tp IS NULL) AS d FROM v)")
    + """SELECT 'x' AS "column", n AS "rows", 0::BIGINT AS nulls, a AS nans, b AS plus_infinite, c AS minus_infinite FROM n UNION ALL SELECT 'post_tp', n, d, 0, 0, 0 FROM n""",
)
def label_value_faults(spark, sf):
    bad = F.when(F.col("mech") == 0, float("nan")).when(F.col("mech") == 1, float("inf")).when(F.col("mech") == 2, float("-inf")).otherwise(F.col("x_price"))
    return L.value_faults(T.samples(spark, sf).select("post_tp", bad.alias("x")), ["x", "post_tp"])
