"""Overfitting statistics and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import SAMPLES, TRADES, with_
from tapeline.catalog.registry import R, query, r
from tapeline.operators import drift as D
from tapeline.operators import journal as J
from tapeline.operators import validation as V
from tapeline.plans import grid as G
from tapeline.session import materialize
from tapeline.sources import tables as T

PERF = """perf AS (SELECT (l_suppkey % 20)::INT AS trial, ((month(l_shipdate) - 1) // 2)::INT AS window_id,
  avg(l_discount - 0.05) / stddev_samp(l_discount) AS value FROM lineitem GROUP BY ALL)"""


def performance(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 20).cast("int").alias("trial"), F.floor((F.month("l_shipdate") - 1) / 2).cast("int").alias("window_id")).agg(
        (F.avg(F.col("l_discount") - 0.05) / F.stddev_samp("l_discount")).alias("value")
    )


PBO = with_(PERF, "masks AS (SELECT m::BIGINT AS mask FROM range(64) t(m) WHERE bit_count(m::BIGINT) = 3)",
            """means AS (SELECT mask, trial, round(avg(value) FILTER ((mask >> window_id) & 1 = 1), 12) AS ism, round(avg(value) FILTER ((mask >> window_id) & 1 = 0), 12) AS oos
              FROM perf, masks GROUP BY ALL)""",
            "best AS (SELECT mask, arg_max(trial, ism) AS best_trial, arg_max(oos, ism) AS star FROM means GROUP BY mask)",
            """rk AS (SELECT b.mask, b.best_trial, (count(*) FILTER (m.oos < b.star) + (count(*) FILTER (m.oos = b.star) + 1) / 2.0) / (count(*) + 1) AS omega
              FROM means m JOIN best b USING (mask) GROUP BY ALL)""")


@query("overfit_pbo_splits", PBO + f"SELECT mask, best_trial, {R('omega')} AS omega, {R('ln(omega / (1 - omega))')} AS logit FROM rk")
def overfit_pbo_splits(spark, sf):
    out = V.pbo(materialize(performance(spark, sf)), V.half_splits(spark, 6))
    return out.select("mask", "best_trial", r("omega").alias("omega"), r("logit").alias("logit"))


@query("overfit_pbo", PBO + f"SELECT {R('avg((omega < 0.5)::INT)')} AS pbo, count(*) AS n_splits, {R('median(ln(omega / (1 - omega)))')} AS lambda_median FROM rk")
def overfit_pbo(spark, sf):
    out = V.pbo_summary(V.pbo(materialize(performance(spark, sf)), V.half_splits(spark, 6)))
    return out.select(r("pbo").alias("pbo"), "n_splits", r("lambda_median").alias("lambda_median"))


@query(
    "overfit_trial_variance",
    with_(PERF) + f"SELECT {R('var_samp(value)', 9)} AS trial_var, count(*) AS n_trials FROM perf",
)
def overfit_trial_variance(spark, sf):
    return V.trial_variance(performance(spark, sf), "value").select(r("trial_var", 9).alias("trial_var"), "n_trials")


CPCV = [TRADES, "tw AS (SELECT *, (year(exit_time) - 1995)::INT AS window_id FROM trades WHERE exit_time IS NOT NULL)",
        "ws AS (SELECT DISTINCT window_id FROM tw)",
        """splits AS (SELECT a.window_id || '-' || b.window_id AS split, unnest([a.window_id, b.window_id]) AS window_id FROM ws a JOIN ws b ON a.window_id < b.window_id)""",
        "pool AS (SELECT split, exit_time, pnl FROM tw JOIN splits USING (window_id))",
        "daily AS (SELECT split, exit_time::DATE AS day, sum(pnl) AS pnl FROM pool GROUP BY ALL)",
        "spine AS (SELECT split, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY split)",
        """eqd AS (SELECT split, day, 100000 + sum(coalesce(pnl, 0)) OVER (PARTITION BY split ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity
          FROM spine LEFT JOIN daily USING (split, day))""",
        "rets AS (SELECT *, equity / lag(equity) OVER (PARTITION BY split ORDER BY day) - 1 AS ret FROM eqd)"]


def _cpcv(spark, sf):
    t = T.trades(spark, sf).filter("exit_time is not null").withColumn("window_id", F.year("exit_time") - 1995)
    t = materialize(t.select("trade_id", "exit_time", "pnl", "outcome", F.col("rr_actual").alias("actual_rr"), "window_id"))
    splits = V.cpcv_splits(t.select("window_id").distinct(), 2)
    evaluate = lambda pool, keys: J.return_moments(J.daily_returns(pool, keys), keys)
    trials = performance(spark, sf).groupBy("trial").agg((F.avg("value") * F.sqrt(F.lit(365.0))).alias("sharpe"))
    return V.cpcv_evaluate(t, splits, evaluate, trials)


@query("overfit_cpcv_splits", with_(*CPCV) + f"""SELECT split, count(ret) AS n, {R('avg(ret) / stddev_samp(ret) * sqrt(365)')} AS sharpe,
    {R('skewness(ret)', 4)} AS skew, {R('kurtosis(ret) + 3', 3)} AS kurt_nonexcess FROM rets WHERE ret IS NOT NULL GROUP BY split""")
def overfit_cpcv_splits(spark, sf):
    return _cpcv(spark, sf).select("split", "n", r("sharpe").alias("sharpe"), r("skew", 4).alias("skew"), r("kurt_nonexcess", 3).alias("kurt_nonexcess"))


@query("overfit_cpcv_deflated")
def overfit_cpcv_deflated(spark, sf):
    return _cpcv(spark, sf).select("split", r("sharpe").alias("sharpe"), r("dsr").alias("dsr"))


@query("overfit_cpcv_summary")
def overfit_cpcv_summary(spark, sf):
    out = V.cpcv_summary(_cpcv(spark, sf))
    return out.select("n_splits", *[r(c).alias(c) for c in out.columns if c != "n_splits"])


@query("overfit_drawdown_simulation")
def overfit_drawdown_simulation(spark, sf):
    t = T.trades(spark, sf).filter("exit_time is not null").select("trade_id", F.col("rr_actual").alias("rr"), F.lit(0.002).alias("risk"))
    out = V.drawdown_tail(V.shuffled_drawdowns(V.with_median_risk(t, "risk"), 1000, "trade_id"), 1000)
    return out.select(*[r(c).alias(c) for c in out.columns if c != "robust"], "robust")


@query("overfit_bootstrap_interval")
def overfit_bootstrap_interval(spark, sf):
    t = T.trades(spark, sf).filter("exit_time is not null").select("trade_id", "rr_actual")
    out = V.bootstrap_interval(V.bootstrap(t, "rr_actual", 100, "trade_id"))
    return out.select(*[r(c).alias(c) for c in out.columns])


REGION = """g AS (SELECT (l_suppkey % 8)::INT AS threshold, l_linenumber AS rr, avg(l_discount) * 10 AS dsr, avg(l_tax) * 30 AS sharpe FROM lineitem GROUP BY l_suppkey, l_linenumber)"""


def region(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("rr")).agg(
        (F.avg("l_discount") * 10).alias("dsr"), (F.avg("l_tax") * 30).alias("sharpe")
    ).withColumn("threshold", (F.col("l_suppkey") % 8).cast("int"))


@query("overfit_region_grid", with_(REGION) + "SELECT rr, " + ", ".join(R(f"median(dsr) FILTER (threshold = {i})") + f' AS "t{i}"' for i in range(8)) + " FROM g GROUP BY rr")
def overfit_region_grid(spark, sf):
    wide = V.region_grid(region(spark, sf), "threshold", "rr", "dsr", list(range(8)))
    return wide.select("rr", *[r(F.col(f"`{i}`")).alias(f"t{i}") for i in range(8)])


@query(
    "overfit_region_summary",
    with_(REGION, "cells AS (SELECT rr, threshold, median(dsr) AS d, median(sharpe) AS s FROM g GROUP BY ALL)",
          "rk AS (SELECT *, row_number() OVER (ORDER BY d DESC, rr, threshold) AS r, count(*) OVER () AS n FROM cells)",
          "top AS (SELECT * FROM rk WHERE r <= greatest(1, ceil(n * 0.10)))",
          """z AS (SELECT max(n) AS n_cells_valid, count(*) AS n_cells_top, max(d) AS top_cells_max, min(d) AS top_cells_min,
             quantile_cont(d, 0.9) - quantile_cont(d, 0.1) AS spread_q90_q10,
             (quantile_cont(s, 0.9) - quantile_cont(s, 0.1)) / greatest(abs(median(s)), 1e-6) AS sharpe_rel_spread FROM top)""")
    + f"""SELECT n_cells_valid, n_cells_top, {R('top_cells_max')} AS top_cells_max, {R('top_cells_min')} AS top_cells_min, {R('spread_q90_q10')} AS spread_q90_q10,
      {R('sharpe_rel_spread')} AS sharpe_rel_spread, spread_q90_q10 < 0.10 AS dsr_gate_pass, n_cells_top >= 2 AND sharpe_rel_spread < 0.15 AS sharpe_gate_pass FROM z""",
)
def overfit_region_summary(spark, sf):
    out = V.region_summary(region(spark, sf), "threshold", "rr", "dsr", "sharpe")
    return out.select("n_cells_valid", "n_cells_top", *[r(c).alias(c) for c in ("top_cells_max", "top_cells_min", "spread_q90_q10", "sharpe_rel_spread")],
                      "dsr_gate_pass", "sharpe_gate_pass")


@query("overfit_acceptance_gates")
def overfit_acceptance_gates(spark, sf):
    t = materialize(T.trades(spark, sf).filter("exit_time is not null"))
    m = G.metrics_of(t.withColumn("actual_rr", F.col("rr_actual")), ["asset_class"])
    m = m.withColumn("dsr", V.deflated_sharpe(F.col("sharpe"), F.lit(0.5), F.lit(20), F.col("n"), F.col("skew"), F.col("kurt_nonexcess")))
    out = V.acceptance_gates(m)
    return out.select("asset_class", "passed", F.array_join("failed", ",").alias("failed"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "model_agreement",
    with_(SAMPLES) + f"""SELECT mfe >= 2.5 AS old, x_price >= 1.2::DOUBLE AS new, count(*) AS rows, count(*) FILTER (label_outcome = 1) AS wins,
    {R('sum(label_rr)', 4)} AS total_rr FROM samples WHERE label_action > 0 GROUP BY ALL""",
)
def model_agreement(spark, sf):
    s = T.samples(spark, sf).filter("label_action > 0")
    return s.groupBy((F.col("mfe") >= 2.5).alias("old"), (F.col("x_price") >= 1.2).alias("new")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label_outcome") == 1).alias("wins"), r(F.sum("label_rr"), 4).alias("total_rr")
    )


@query(
    "threshold_sweep",
    with_(SAMPLES) + f"""SELECT t / 10.0::DOUBLE AS threshold, count(*) AS accepted, {R('sum(label_rr)', 4)} AS sum_r FROM samples, range(1, 10) u(t)
    WHERE label_action > 0 AND x_quantity >= t / 10.0::DOUBLE GROUP BY ALL""",
)
def threshold_sweep(spark, sf):
    s = T.samples(spark, sf).filter("label_action > 0").select("x_quantity", "label_rr")
    out = V.threshold_sweep(s, "x_quantity", "label_rr", [t / 10 for t in range(1, 10)])
    return out.select("threshold", "accepted", r("sum_value", 4).alias("sum_r"))


FOLD = with_(SAMPLES) + f"""SELECT "window" AS fold, asset_class, count(*) AS trades, {R('avg((label_outcome = 1)::INT)')} AS win_rate,
    {R('avg(least(greatest(label_rr, -1), 20))')} AS mean_rr,
    {R('sum(greatest(least(greatest(label_rr, -1), 20), 0)) / greatest(abs(sum(least(greatest(label_rr, -1), 0))), 0.001)')} AS profit_factor,
    {R('avg(least(greatest(label_rr, -1), 20)) / greatest(stddev_pop(least(greatest(label_rr, -1), 20)), 1e-6)')} AS sharpe
    FROM samples WHERE label_action > 0 GROUP BY ALL"""


@query("fold_trading_metrics", FOLD)
def fold_trading_metrics(spark, sf):
    x = F.least(F.greatest("label_rr", F.lit(-1.0)), F.lit(20.0))
    return T.samples(spark, sf).filter("label_action > 0").groupBy(F.col("window").alias("fold"), "asset_class").agg(
        F.count(F.lit(1)).alias("trades"), r(F.avg((F.col("label_outcome") == 1).cast("double"))).alias("win_rate"), r(F.avg(x)).alias("mean_rr"),
        r(F.sum(F.greatest(x, F.lit(0.0))) / F.greatest(F.abs(F.sum(F.least(x, F.lit(0.0)))), F.lit(0.001))).alias("profit_factor"),
        r(F.avg(x) / F.greatest(F.stddev_pop(x), F.lit(1e-6))).alias("sharpe"),
    )


_AUC = """sc AS (SELECT "window" AS w, x_quantity AS score, label_outcome = 1 AS y FROM samples WHERE label_action > 0),
    fp AS (SELECT f.w AS fold, CASE WHEN f.w = sc.w THEN 'test' ELSE 'train' END AS part, score, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg
      FROM sc JOIN (SELECT DISTINCT w FROM sc) f ON f.w >= sc.w GROUP BY ALL),
    rs AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold, part ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM fp),
    au AS (SELECT fold, part, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / sum(pos) / sum(neg) ELSE 0 END AS auc FROM rs GROUP BY ALL),
    gap AS (SELECT fold, coalesce(max(auc) FILTER (part = 'test'), 0) AS test_auc, coalesce(max(auc) FILTER (part = 'train'), 0) AS train_auc FROM au GROUP BY fold)"""


@query(
    "fold_classification_metrics",
    with_(SAMPLES, "p AS (SELECT \"window\" AS fold, x_quantity >= 0.5::DOUBLE AS pred, label_outcome = 1 AS y FROM samples WHERE label_action > 0)",
          "c AS (SELECT fold, count(*) FILTER (pred AND y) AS tp, count(*) FILTER (pred AND NOT y) AS fp, count(*) FILTER (NOT pred AND y) AS fn, count(*) AS n, count(*) FILTER (pred = y) AS ok FROM p GROUP BY fold)")
    + f""", {_AUC}
    SELECT fold, {R('ok / n')} AS accuracy, {R('tp / (tp + fp)')} AS "precision", {R('tp / (tp + fn)')} AS recall, {R('2 * tp / (2 * tp + fp + fn)')} AS f1,
    {R('test_auc')} AS test_auc, {R('train_auc')} AS train_auc, {R('train_auc - test_auc')} AS auc_gap, round(train_auc - test_auc, 12) > 0.10 AS overfit_flag FROM c JOIN gap USING (fold)""",
)
def fold_classification_metrics(spark, sf):
    from tapeline.operators import models as M

    s = materialize(T.samples(spark, sf).filter("label_action > 0").select(
        F.col("window").alias("fold"), (F.col("x_quantity") >= 0.5).alias("pred"), (F.col("label_outcome") == 1).alias("y"), "x_quantity"
    ))
    out = M.classification_metrics(s, ["fold"]).join(M.fold_gaps(s, "fold", "x_quantity", "y"), "fold")
    return out.select("fold", *[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "test_auc", "train_auc", "auc_gap")], "overfit_flag")


@query(
    "model_retrain_gates",
    with_(SAMPLES, """p AS (SELECT asset_class, x_quantity AS score, count(*) FILTER (label_outcome = 1) AS pos, count(*) FILTER (label_outcome <> 1) AS neg FROM samples WHERE label_action > 0 GROUP BY ALL)""",
          "b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY asset_class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p)",
          """g AS (SELECT asset_class, sum(pos * (below + neg / 2)) / sum(pos) / sum(neg) AS auc, sum(pos) FILTER (score >= 0.5) / greatest(sum(neg) FILTER (score >= 0.5), 1) AS pf FROM b GROUP BY asset_class)""")
    + f"""SELECT asset_class, {R('auc')} AS auc, {R('pf')} AS profit_factor, round(auc, 12) >= 0.499 AND pf >= 1 AS accepted,
    CASE WHEN round(auc, 12) < 0.499 THEN 'auc' WHEN pf < 1 THEN 'profit_factor' END AS reason FROM g""",
)
def model_retrain_gates(spark, sf):
    from tapeline.operators import models as M

    s = T.samples(spark, sf).filter("label_action > 0").select("asset_class", "x_quantity", (F.col("label_outcome") == 1).alias("y"))
    out = M.retrain_gates(materialize(s), ["asset_class"], "x_quantity", "y", 0.499)
    return out.select("asset_class", r("auc").alias("auc"), r("profit_factor").alias("profit_factor"), "accepted", "reason")


@query(
    "overfit_cpcv_purged",
    with_(TRADES, "s AS (SELECT trade_id, entry_time AS ts, rr_actual AS rr FROM trades WHERE exit_time IS NOT NULL)",
          "w AS (SELECT y - 1995 AS window_id, make_timestamp(y, 2, 1, 0, 0, 0) AS test_start, make_timestamp(y, 11, 30, 0, 0, 0) AS test_end FROM range(1995, 1999) t(y))",
          "sp AS (SELECT a.window_id || '-' || b.window_id AS split, [a.window_id, b.window_id] AS ids FROM w a JOIN w b ON a.window_id < b.window_id)",
          """m AS (SELECT s.*, list(w.window_id) FILTER (w.test_start <= s.ts AND w.test_end >= s.ts) AS own,
             list(w.window_id) FILTER (w.test_start <= s.ts + INTERVAL 40 DAY AND w.test_end >= s.ts) AS met FROM s, w GROUP BY ALL)""",
          "f AS (SELECT split, rr, coalesce(list_has_any(own, ids), false) AS tested, coalesce(list_has_any(met, ids), false) AS hit FROM m, sp)")
    + f"""SELECT split, count(*) FILTER (tested) AS n_test, count(*) FILTER (NOT tested AND NOT hit) AS n_train, count(*) FILTER (NOT tested AND hit) AS n_purged,
    {R('avg(rr) FILTER (tested)')} AS test_mean, {R('avg(rr) FILTER (NOT tested AND NOT hit)')} AS train_mean FROM f GROUP BY split""",
)
def overfit_cpcv_purged(spark, sf):
    """Trades of every combinatorial split after purge and embargo; test windows run from February to November of each year."""
    t = T.trades(spark, sf).filter("exit_time is not null").select(F.col("entry_time").cast("timestamp").alias("ts"), F.col("rr_actual").alias("rr"))
    w = spark.range(1995, 1999).select((F.col("id") - 1995).alias("window_id"), F.expr("make_timestamp(id, 2, 1, 0, 0, 0)").alias("test_start"), F.expr("make_timestamp(id, 11, 30, 0, 0, 0)").alias("test_end"))
    out = V.cpcv_purged(t, w, V.cpcv_splits(w, 2), 10 * 86400, 30 * 86400, "rr")
    return out.select("split", "n_test", "n_train", "n_purged", r("test_mean").alias("test_mean"), r("train_mean").alias("train_mean"))


LATTICE = """runs AS (SELECT (l_suppkey % 5)::INT * 4 + 70 AS threshold, (l_linenumber % 4)::INT * 2 + 20 AS min_rr, (year(l_shipdate) - 1992)::INT AS window_id, (l_discount - 0.045) AS edge FROM lineitem),
    results AS (SELECT threshold || '/' || min_rr AS combo_id, threshold, min_rr, window_id, count(*) AS total_trades, sum(greatest(edge, 0)) / sum(greatest(-edge, 0)) AS pf_real,
      avg(edge) / stddev_samp(edge) AS sharpe FROM runs GROUP BY ALL),
    whole AS (SELECT combo_id, threshold, min_rr, sum(total_trades) AS total_trades, avg(pf_real) AS pf_real, avg(sharpe) AS sharpe, min(pf_real) AS worst, min(sharpe) AS low FROM results GROUP BY ALL),
    moved AS (SELECT a.combo_id, abs(b.pf_real - a.pf_real) / a.pf_real * 100 AS c FROM whole a JOIN whole b ON (a.min_rr = b.min_rr AND a.threshold <> b.threshold AND abs(a.threshold - b.threshold) * 10 <= a.threshold)
      OR (a.threshold = b.threshold AND a.min_rr <> b.min_rr AND abs(a.min_rr - b.min_rr) * 10 <= a.min_rr)),
    stab AS (SELECT w.combo_id, count(c) AS neighbours, coalesce(max(c), 0) AS change FROM whole w LEFT JOIN moved m ON m.combo_id = w.combo_id GROUP BY w.combo_id)"""


def lattice(spark, sf):
    """Results of a small parameter lattice by window, and over all windows."""
    li = T.table(spark, sf, "lineitem").select(
        ((F.col("l_suppkey") % 5) * 4 + 70).cast("int").alias("threshold"), ((F.col("l_linenumber") % 4) * 2 + 20).cast("int").alias("min_rr"),
        (F.year("l_shipdate") - 1992).alias("window_id"), (F.col("l_discount") - 0.045).alias("edge"))
    pf = F.sum(F.greatest("edge", F.lit(0.0))) / F.sum(F.greatest(-F.col("edge"), F.lit(0.0)))
    rows = li.groupBy(F.concat_ws("/", "threshold", "min_rr").alias("combo_id"), "threshold", "min_rr", "window_id").agg(
        F.count(F.lit(1)).alias("total_trades"), pf.alias("pf_real"), (F.avg("edge") / F.stddev_samp("edge")).alias("sharpe"))
    rows = materialize(rows)
    whole = rows.groupBy("combo_id", "threshold", "min_rr").agg(
        F.sum("total_trades").alias("total_trades"), F.avg("pf_real").alias("pf_real"), F.avg("sharpe").alias("sharpe"), F.min("pf_real").alias("worst"), F.min("sharpe").alias("low"))
    return rows, materialize(whole)


@query("overfit_lattice_stability", "WITH " + LATTICE + f" SELECT combo_id, neighbours, {R('change')} AS max_pf_change_pct, round(change, 9) < 4 AS stable FROM stab")
def overfit_lattice_stability(spark, sf):
    out = V.lattice_stability(lattice(spark, sf)[1], ["threshold", "min_rr"], limit=4.0)
    return out.select("combo_id", "neighbours", r("max_pf_change_pct").alias("max_pf_change_pct"), "stable")


@query(
    "overfit_qualified_trials",
    "WITH " + LATTICE + f""", ever AS (SELECT combo_id, min(pf_real) >= 1.15 AS e, min(total_trades) > 0 AS a, avg(sharpe) AS sharpe FROM results GROUP BY combo_id),
    few AS (SELECT count(*) FILTER (e) < 5 AS used_fallback FROM ever)
    SELECT combo_id, {R('sharpe')} AS sharpe, used_fallback FROM ever, few WHERE CASE WHEN used_fallback THEN a ELSE e END""",
)
def overfit_qualified_trials(spark, sf):
    rows, whole = lattice(spark, sf)
    marked = rows.join(whole.select("combo_id", (F.col("worst") >= 1.15).alias("is_evergreen")), "combo_id")
    return V.qualified_trials(marked).select("combo_id", r("sharpe").alias("sharpe"), "used_fallback")


@query(
    "overfit_gate_reasons",
    "WITH " + LATTICE + f""", m AS (SELECT w.*, change, round(change, 9) < 4 AS stable, CASE threshold % 3 WHEN 0 THEN 'forex' ELSE 'crypto' END AS asset_class, total_trades % 60 AS n_real, pf_real - 1.2 AS expectancy,
      low * 2 AS max_drawdown, 0.15 + (min_rr - 20) / 20.0 AS winrate_real, (threshold - 70) / 20.0 AS be_rate, 0.5 + sharpe AS dsr, low AS mc_worst_dd, worst > 1.1 AS mc_robust FROM whole w JOIN stab s ON s.combo_id = w.combo_id)
    SELECT combo_id, concat_ws(',', CASE WHEN pf_real < 1.5 THEN 'profit_factor' END, CASE WHEN total_trades < CASE asset_class WHEN 'forex' THEN 5 ELSE 20 END THEN 'min_trades' END, CASE WHEN sharpe < 0.5 THEN 'sharpe' END,
      CASE WHEN max_drawdown < -0.10 THEN 'max_dd' END, CASE WHEN NOT (winrate_real > 0.20 AND expectancy > 0) THEN 'quality' END, CASE WHEN dsr < 0.70 THEN 'dsr' END,
      CASE WHEN NOT (mc_worst_dd >= -0.10 AND mc_robust) THEN 'monte_carlo' END, CASE WHEN NOT (n_real < 30 OR stable) THEN 'stability' END) AS failed,
    concat_ws(',', CASE WHEN be_rate > 0.50 THEN 'high_be_rate' END, CASE WHEN n_real < 30 AND NOT stable THEN 'stability_skipped' END) AS warnings FROM m""",
)
def overfit_gate_reasons(spark, sf):
    """All eight gates over a lattice whose metrics spread over both sides of every limit."""
    _, whole = lattice(spark, sf)
    m = whole.join(V.lattice_stability(whole, ["threshold", "min_rr"], limit=4.0), "combo_id").withColumns({
        "asset_class": F.when(F.col("threshold") % 3 == 0, "forex").otherwise("crypto"), "n_real": F.col("total_trades") % 60, "expectancy": F.col("pf_real") - 1.2,
        "max_drawdown": F.col("low") * 2, "winrate_real": 0.15 + (F.col("min_rr") - 20) / 20, "be_rate": (F.col("threshold") - 70) / 20, "dsr": 0.5 + F.col("sharpe"),
        "mc_worst_dd": F.col("low"), "mc_robust": F.col("worst") > 1.1})
    return V.acceptance_gates(m).select("combo_id", F.array_join("failed", ",").alias("failed"), F.array_join("warnings", ",").alias("warnings"))


_FEATURES = ["x_price", "x_tax", "x_quantity"]
DRIFT = [SAMPLES, "tr AS (SELECT * FROM samples WHERE \"window\" < 4)", "lv AS (SELECT * FROM samples WHERE \"window\" >= 4)",
         "tall AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, round({f}, 9) AS value, 1 AS t, 0 AS l FROM tr UNION ALL SELECT '{f}', round({f}, 9), 0, 1 FROM lv" for f in _FEATURES) + ")",
         "vc AS (SELECT feature, value, sum(t) AS t, sum(l) AS l FROM tall GROUP BY ALL)",
         """ks AS (SELECT feature, max(abs(ct / nt - cl / nl)) AS ks FROM (SELECT feature, sum(t) OVER w AS ct, sum(l) OVER w AS cl,
           sum(t) OVER (PARTITION BY feature) AS nt, sum(l) OVER (PARTITION BY feature) AS nl FROM vc WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)) GROUP BY feature)""",
         "q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM tall WHERE t = 1 GROUP BY feature)",
         """bk AS (SELECT v.feature, least(len(list_filter(q, lambda e: e <= value)), len(q) - 1) AS b, sum(t) AS t, sum(l) AS l FROM vc v JOIN q USING (feature)
           WHERE value >= q[1] AND value <= q[len(q)] GROUP BY ALL)""",
         "ab AS (SELECT feature, unnest(range(1, len(q))) AS b FROM q)",
         """sh AS (SELECT feature, coalesce(t, 0) / greatest(sum(coalesce(t, 0)) OVER (PARTITION BY feature), 1) AS e, coalesce(l, 0) / greatest(sum(coalesce(l, 0)) OVER (PARTITION BY feature), 1) AS a
           FROM ab LEFT JOIN bk USING (feature, b))""",
         "psi AS (SELECT feature, sum((aa - ee) * ln(aa / ee)) AS psi FROM (SELECT feature, CASE WHEN a = 0 THEN 1e-6 ELSE a END AS aa, CASE WHEN e = 0 THEN 1e-6 ELSE e END AS ee FROM sh) GROUP BY feature)",
         "rep AS (SELECT ks.feature, ks, psi, CASE WHEN ks > 0.25 OR psi > 0.25 THEN 'MAJOR' WHEN ks > 0.10 OR psi > 0.10 THEN 'MINOR' ELSE 'OK' END AS severity FROM ks JOIN psi USING (feature))"]


def _drift(spark, sf):
    # Quotients that are equal on paper are equal values here.
    s = T.samples(spark, sf).select("window", *[F.round(f, 9).alias(f) for f in _FEATURES])
    return D.drift_report(s.filter("window < 4"), s.filter("window >= 4"), _FEATURES, ["x_price"], ["x_tax"])


@query(
    "drift_report",
    with_(*DRIFT) + f"""SELECT r.feature, {R('ks')} AS ks, {R('psi')} AS psi, severity,
    {R('(SELECT avg(value) FROM tall t WHERE t.feature = r.feature AND l = 1)')} AS live_mean, {R('(SELECT avg(value) FROM tall t WHERE t.feature = r.feature AND t.t = 1)')} AS train_mean,
    {R('(SELECT stddev_pop(value) FROM tall t WHERE t.feature = r.feature AND l = 1)')} AS live_std, {R('(SELECT stddev_pop(value) FROM tall t WHERE t.feature = r.feature AND t.t = 1)')} AS train_std FROM rep r""",
)
def drift_report(spark, sf):
    return _drift(spark, sf).select("feature", "severity", *[r(c).alias(c) for c in ("ks", "psi", "live_mean", "train_mean", "live_std", "train_std")])


@query(
    "drift_alert_level",
    with_(*DRIFT) + """SELECT count(*) FILTER (severity = 'MAJOR') AS major, count(*) FILTER (severity = 'MINOR') AS minor,
    CASE WHEN count(*) FILTER (severity = 'MAJOR' AND feature = 'x_price') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (severity = 'MAJOR' AND feature = 'x_tax') > 0 THEN 'WARNING' ELSE 'INFO' END AS level FROM rep""",
)
def drift_alert_level(spark, sf):
    return D.alert_level(_drift(spark, sf))


@query(
    "dataset_feature_stats",
    with_(SAMPLES) + " UNION ALL ".join(f"""SELECT '{f}' AS feature, {R(f'avg({f}) FILTER ("window" < 4)')} AS old_mean, {R(f'stddev_samp({f}) FILTER ("window" < 4)')} AS old_std,
      {R(f'avg({f}) FILTER ("window" >= 4)')} AS new_mean, {R(f'stddev_samp({f}) FILTER ("window" >= 4)')} AS new_std FROM samples""" for f in _FEATURES),
)
def dataset_feature_stats(spark, sf):
    t = T.samples(spark, sf).select("window", *_FEATURES).unpivot(["window"], _FEATURES, "feature", "value")
    old, new = F.when(F.col("window") < 4, F.col("value")), F.when(F.col("window") >= 4, F.col("value"))
    return t.groupBy("feature").agg(*[r(f(c)).alias(n) for n, f, c in (
        ("old_mean", F.avg, old), ("old_std", F.stddev_samp, old), ("new_mean", F.avg, new), ("new_std", F.stddev_samp, new))])


@query(
    "walk_forward_callables",
    with_(SAMPLES, """e AS (SELECT "window" AS w, x_price AS x, label_outcome = 1 AS y, label_rr FROM samples WHERE label_action > 0)""",
          "f AS (SELECT DISTINCT w FROM e WHERE w > (SELECT min(w) FROM e))",
          "m AS (SELECT f.w, (avg(x) FILTER (y) + avg(x) FILTER (NOT y)) / 2 AS middle, avg(x) FILTER (y) >= avg(x) FILTER (NOT y) AS up FROM f JOIN e ON e.w < f.w GROUP BY f.w)",
          "s AS (SELECT e.*, (round(x - middle, 12) >= 0) = up AS pred FROM e JOIN m USING (w))")
    + f"""SELECT w AS "window", count(*) AS n, {R('count(*) FILTER (pred = y) / count(*)')} AS accuracy, count(*) FILTER (pred) AS taken, {R('coalesce(sum(label_rr) FILTER (pred), 0)', 4)} AS total_rr FROM s GROUP BY w""",
)
def walk_forward_callables(spark, sf):
    """A cut between the mean prices of winners and losers, fitted before each window."""
    from tapeline.plans.walk_forward import walk_forward

    entries = T.samples(spark, sf).filter("label_action > 0").select("window", F.col("x_price").alias("x"), "label_outcome", "label_rr")
    mean = lambda c: F.avg(F.when(c, F.col("x")))
    won, lost = mean(F.col("y")), mean(~F.col("y"))
    return walk_forward(
        entries, label=lambda d: d.withColumn("y", F.col("label_outcome") == 1), fit=lambda d: d.agg(((won + lost) / 2).alias("middle"), (won >= lost).alias("up")),
        score=lambda m, d: d.crossJoin(F.broadcast(m)).withColumn("pred", (F.round(F.col("x") - F.col("middle"), 12) >= 0) == F.col("up")),
        evaluate=lambda d: d.agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("pred") == F.col("y")).cast("double"))).alias("accuracy"), F.count_if("pred").alias("taken"),
                                 r(F.coalesce(F.sum(F.when(F.col("pred"), F.col("label_rr"))), F.lit(0.0)), 4).alias("total_rr")))
