"""Training labels, weights and what-if results, as column expressions.

Sample columns: ``label_action`` (0 none, 1 long, 2 short), ``label_outcome``
(1 win, 2 loss, 3 break-even), ``label_rr``, ``mfe``, ``mae``, ``tp_rr``,
``cost_rr`` (all in R), ``mech`` (1 target, 2 stop, 3 break-even, 4 timeout).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.functions.scores import clip
from tapeline.operators.journal import day_number

# Bounds of the hindsight targets.
SL_BUFFER, SL_FLOOR, SL_CAP = 1.1, 1.0, 3.0
TP_CAPTURE, TP_FLOOR, TP_CAP = 0.85, 0.5, 10.0
SIZE_FLOOR, SIZE_CAP, SIZE_MAE_FLOOR = 0.5, 2.0, 0.3
# Weight of a live trade by its grade.
GRADE_WEIGHTS = {"A+": 1.5, "A": 1.5, "B+": 1.0, "B": 1.0, "C": 0.8, "D": 0.5}
# Numbers of the asset classes.
CLASS_IDS = {"crypto": 0, "forex": 1, "stocks": 2, "commodities": 3}


def _c(name: str) -> Column:
    return F.col(name)


def hindsight_targets() -> dict[str, Column]:
    """Entry worth taking, stop, target and size with hindsight."""
    mfe, mae = F.greatest(_c("mfe"), F.lit(0.0)), F.greatest(_c("mae"), F.lit(0.0))
    worth = (mfe >= 1.0) & (mfe > mae * 1.5) & (_c("label_outcome") == 1)
    return {
        "optimal_entry": worth.cast("int"),
        "optimal_sl_rr": clip(mae * SL_BUFFER, SL_FLOOR, SL_CAP),
        "optimal_tp_rr": clip(mfe * TP_CAPTURE, TP_FLOOR, TP_CAP),
        "optimal_size": clip(mfe / F.greatest(mae, F.lit(SIZE_MAE_FLOOR)), SIZE_FLOOR, SIZE_CAP),
    }


def head_labels() -> dict[str, Column]:
    """Targets of the sizing, take-profit, break-even and stop heads."""
    out, mfe, mae = _c("label_outcome"), _c("mfe"), _c("mae")
    be = (
        F.when(out == 2, F.when(mfe >= 1.5, 1.0).when(mfe >= 1.0, 0.7).otherwise(0.0))
        .when(out == 1, clip(mfe * 0.4, 0.0, 2.5))
        .when(out == 3, 1.5)
        .otherwise(0.0)
    )
    sl = (
        F.when(out == 1, F.when(mae < 0.3, 1.0).when(mae < 0.6, 0.5).otherwise(0.0))
        .when(out == 2, F.when(mfe >= 1.0, -1.0).when(mfe >= 0.5, -0.5).otherwise(0.0))
        .otherwise(0.0)
    )
    return {
        "label_size": clip(_c("label_rr"), -1.0, 10.0),
        "label_tp": clip(F.coalesce("post_tp", "mfe"), 0.0, 20.0),
        "label_be": be,
        "label_sl": sl,
    }


def sample_weight() -> Column:
    """Weight by exit and by how much of the way to the target was made."""
    rr = F.abs("label_rr")
    way = clip(_c("mfe") / F.greatest(_c("tp_rr"), F.lit(0.1)), 0.0, 1.5)
    stop = clip(rr, 0.1, 1.5) * F.when(way > 0.60, 0.3).when(way > 0.20, 0.7).otherwise(1.0)
    timeout = (
        F.when(way >= 0.60, clip(way * clip(rr, 0.1, 5.0), 0.5, 4.0)).when(way >= 0.20, 0.3).otherwise(0.5)
    )
    return (
        F.when(_c("mech") == 1, clip(rr, 1.0, 5.0))
        .when(_c("mech") == 2, stop)
        .when(_c("mech") == 3, F.when(way >= 0.30, 0.3).otherwise(0.1))
        .when(_c("mech") == 4, timeout)
        .when(_c("label_outcome") == 1, clip(rr, 1.0, 5.0))
        .otherwise(clip(rr, 0.1, 1.5))
    )


def live_weight(grade: Column, exit_reason: Column, won: Column, rr: Column, way: Column) -> Column:
    """Weight of a live trade: grade, exit reason, D-graded losses tripled."""
    by_grade = F.lit(1.0)
    for name, value in GRADE_WEIGHTS.items():
        by_grade = F.when(grade == name, value).otherwise(by_grade)
    mislabelled = ((exit_reason == "tp_hit") & ~won) | ((exit_reason == "sl_hit") & won)
    reason = F.when(mislabelled, "manual").otherwise(exit_reason)
    stop = F.greatest(F.least(rr, F.lit(1.5)) * F.when(way > 0.60, 0.3).when(way > 0.20, 0.7).otherwise(1.0), F.lit(0.1))
    timeout = F.when(way >= 0.60, F.least(way * F.greatest(rr, F.lit(1.0)), F.lit(4.0))).when(way >= 0.20, 0.3).otherwise(0.5)
    factor = (
        F.when(reason == "tp_hit", F.greatest(rr, F.lit(1.0)))
        .when(reason == "sl_hit", stop)
        .when(reason == "timeout", timeout)
        .when(reason.contains("be"), F.when(way >= 0.30, 0.3).otherwise(0.1))
        .otherwise(1.0)
    )
    return clip(2.0 * by_grade * factor * F.when((grade == "D") & ~won, 3.0).otherwise(1.0), 0.1, 10.0)


def counterfactual_label(outcome: Column, mfe: Column, entry: Column, stop: Column, target: Column) -> Column:
    """1 when a rejected signal should have been taken; a timeout counts past 60 % of the way."""
    way = mfe / (F.abs(target - entry) / entry)
    ok = (entry > 0) & (target > 0) & (stop > 0)
    return F.when(outcome == "win", 1).when(outcome == "loss", 0).otherwise(F.when(ok & (way > 0.6), 1).otherwise(0))


def style_id(atr_share: Column) -> Column:
    return F.when(atr_share < 0.005, 0.0).when(atr_share > 0.02, 1.0).otherwise(0.5)


def grade(bos: Column, gap: Column, block: Column, tighter: Column, realistic: Column, offset: Column, pnl: Column, reason: Column) -> Column:
    """Letter grade from up to eight points."""
    points = sum((x.cast("int") for x in (bos, gap, block, ~tighter, realistic, F.abs(offset) < 5, pnl > 0)), F.lit(0))
    points = points - (reason == "timeout").cast("int") + ((reason == "tp_hit") & (pnl > 0)).cast("int")
    return (
        F.when(points >= 7, "A+").when(points >= 6, "A").when(points >= 5, "B+").when(points >= 4, "B")
        .when(points >= 2, "C").otherwise("D")
    )


def shaped_reward(pnl_pct: Column, rr: Column, expected_rr: Column, tier: Column, bars: Column, hit_stop: Column) -> Column:
    """Result raised for efficient targets and good tiers, lowered for stops within three bars."""
    efficient = (pnl_pct > 0) & (expected_rr > 0)
    quality = 1.0 + 0.2 * F.least(F.greatest(rr, F.lit(0.0)) / expected_rr, F.lit(2.0))
    tiered = F.when(tier == "AAA++", 1.5).when(tier == "AAA+", 1.2).otherwise(1.0)
    return pnl_pct * F.when(efficient, quality).otherwise(1.0) * tiered - F.when(hit_stop & (bars <= 3), 0.5).otherwise(0.0)


def prepare_features(samples: DataFrame, features: list[str], clips: dict[str, tuple[float, float]]) -> DataFrame:
    """Float features: clipped, without NaN or infinity, plus class and style ids."""
    inf = float("inf")

    def clean(name):
        x = F.col(name).cast("double")
        if name in clips:
            x = F.when(F.isnan(x), x).otherwise(clip(x, *clips[name]))
        return F.when(x.isNull() | F.isnan(x), 0.0).when(x == inf, 5.0).when(x == -inf, -5.0).otherwise(x)

    ids = F.lit(0)
    for name, number in CLASS_IDS.items():
        ids = F.when(F.col("asset_class") == name, number).otherwise(ids)
    atr = F.col("atr_5m_norm") if "atr_5m_norm" in samples.columns else F.lit(0.01)
    return samples.withColumns(
        {**{f: clean(f).cast("float") for f in features}, "asset_class_id": ids.cast("float"), "style_id": style_id(atr).cast("float")}
    )


def align_schema(df: DataFrame, wanted: list[str], max_missing: int = 5) -> DataFrame:
    """Add missing columns as zero; more than ``max_missing`` is a different schema."""
    missing = [c for c in wanted if c not in df.columns]
    if len(missing) > max_missing:
        raise ValueError(f"{len(missing)} columns missing: {missing}")
    return df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df


def value_faults(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, rows, nulls, nans, plus_infinite, minus_infinite``: one scan, one aggregation."""
    inf = float("inf")
    kinds = {"nulls": lambda c: c.isNull(), "nans": F.isnan, "plus_infinite": lambda c: c == inf, "minus_infinite": lambda c: c == -inf}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(*[F.count_if(F.coalesce(f(F.col(c).cast("double")), F.lit(False))).alias(k) for k, f in kinds.items()]).alias(c) for c in columns])
    return counts.unpivot(["rows"], columns, "column", "_v").select("column", "rows", "_v.*")


def range_violations(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows outside or without a value, per column: one scan, one aggregation."""
    outside = lambda c, lo, hi: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.col(c) < lo) | (F.col(c) > hi))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[outside(c, lo, hi).alias(c) for c, (lo, hi) in bounds.items()])
    return counts.unpivot(["rows"], list(bounds), "column", "violations")


# ---- what-if -------------------------------------------------------------


def what_if_tp(predicted: Column) -> Column:
    """R when the target is pulled in or pushed out to the predicted excursion."""
    tp, cost = _c("tp_rr"), _c("cost_rr")
    reached = F.coalesce("post_tp", "mfe")
    rr = clip(_c("label_rr"), -1.0, 20.0)
    shorter = predicted < tp * 0.7
    longer = predicted > tp * 1.3
    target = F.when(shorter, F.greatest(predicted * 0.85, F.lit(0.5))).when(
        longer, F.least(predicted * 0.8, tp * 1.5)
    ).otherwise(tp)
    return clip(F.when(reached >= target, target - cost).otherwise(rr), -1.0, 20.0)


def what_if_be(level: Column) -> Column:
    """R when a break-even stop at ``level`` had saved the losses that reached it."""
    saved = (_c("label_outcome") == 2) & (level > 0.1) & (_c("mfe") >= level)
    return F.when(saved, -_c("cost_rr")).otherwise(clip(_c("label_rr"), -1.0, 20.0))


def what_if_sl(predicted: Column) -> Column:
    """R when the stop is tightened or widened; only changed outcomes change."""
    mult = (
        F.when(predicted > 0.75, 0.5).when(predicted > 0.25, 0.7).when(predicted < -0.75, 1.3)
        .when(predicted < -0.25, 1.15).otherwise(1.0)
    )
    rr = clip(_c("label_rr"), -1.0, 20.0)
    tight = (mult < 1) & (_c("mae") > mult)
    wide = (mult > 1) & (_c("label_outcome") == 2) & (_c("mae") < mult)
    return clip(F.when(tight, -mult - _c("cost_rr")).when(wide, -_c("cost_rr")).otherwise(rr), -2.0, 20.0)


def what_if_combo(stop: Column | None = None, target: Column | None = None, level: Column | None = None) -> Column:
    """R under a scaled stop, another target and a break-even level together; each is left as it was if not given.

    A wider or tighter stop rescales what the trade earns in units of it; a
    target that the excursion reaches replaces the result of the stop; a
    break-even level saves losses that came that far.
    """
    rr, cost, mfe, outcome = _c("label_rr"), _c("cost_rr"), _c("mfe"), _c("label_outcome")
    out = rr
    if stop is not None:
        tighter, wider = stop < 0.99, stop > 1.01
        rescued = wider & (outcome == 2) & (_c("mae") < stop) & (mfe >= 1.0)
        out = (
            F.when(tighter & (_c("mae") > stop), -stop - cost)
            .when(rescued, mfe * 0.5 / stop - cost)
            .when((tighter | wider) & (outcome == 1), rr / stop)
            .otherwise(out)
        )
    if target is not None:
        moved = F.abs(target - _c("tp_rr")) > 0.01
        out = F.when(moved & (F.coalesce("post_tp", "mfe") >= target), target - cost).otherwise(out)
    if level is not None:
        out = F.when((level > 0.1) & (outcome == 2) & (mfe >= level), -cost).otherwise(out)
    return clip(out, -2.0, 20.0)


def accepted_result(rows: DataFrame, variants: DataFrame, score: str, risk: float = 0.005, commission: float = 0.0008) -> DataFrame:
    """Per variant ``variant, threshold`` and asset class: what the accepted samples earn at a fixed risk, net of commission.

    A win earns its R, any other sample loses one R.  Thresholds are few, and
    rows are reduced per threshold band before they meet the variants.
    """
    won = F.col("label_outcome") == 1
    pnl = F.when(won, F.abs("label_rr") * risk).otherwise(-risk) - commission
    gain = F.greatest(pnl, F.lit(0.0))
    banded = rows.groupBy("asset_class", F.col(score).alias("_score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pnl > 0).alias("w"), F.sum(gain).alias("g"), F.sum(gain - pnl).alias("l"),
        F.sum(pnl * pnl).alias("q"), F.sum(F.abs("label_rr")).alias("r"),
    )
    total = banded.join(variants, F.col("_score") >= F.col("threshold")).groupBy("variant", "asset_class").agg(
        *[F.sum(c).alias(c) for c in ("n", "w", "g", "l", "q", "r")]
    )
    mean = (F.col("g") - F.col("l")) / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return total.select(
        "variant", "asset_class", F.col("n").alias("trades"), F.col("w").alias("wins"), (F.col("w") / F.col("n") * 100).alias("win_rate"),
        F.least(F.col("g") / F.when(F.col("l") > 0, F.col("l")).otherwise(0.001), F.lit(99.9)).alias("pf"), (F.col("r") / F.col("n")).alias("avg_rr"),
        ((F.col("g") - F.col("l")) * 100).alias("total_pnl_pct"), F.when(spread > 1e-12, mean / spread * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
    )


def r_metrics(rows: DataFrame, variants: dict[str, Column], ts: str, tie: str) -> DataFrame:
    """Sharpe, profit factor, win rate and drawdown of R series, one row per variant."""
    names = list(variants)
    wide = rows.select(ts, tie, *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(variants.values())])
    # All variants share one order: the rows are shuffled and sorted once, in days; a day gives its total, highest and lowest sum and worst fall.
    in_day = Window.partitionBy("_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    each = range(len(names))
    run = wide.withColumn("_b", day_number(ts)).withColumns({f"_s{i}": F.sum(F.coalesce(f"_v{i}", F.lit(0.0))).over(in_day) for i in each})
    run = run.withColumns({f"_m{i}": F.max(f"_s{i}").over(in_day) for i in each})
    days = run.groupBy("_b").agg(*[c for i in each for c in (
        F.sum(F.coalesce(f"_v{i}", F.lit(0.0))).alias(f"_t{i}"), F.max(f"_s{i}").alias(f"_h{i}"), F.min(f"_s{i}").alias(f"_l{i}"), F.max(F.col(f"_m{i}") - F.col(f"_s{i}")).alias(f"_f{i}"))])
    before = Window.orderBy(F.col("_b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = days.withColumns({f"_o{i}": F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0.0)) for i in each})
    days = days.withColumns({f"_p{i}": F.max(F.col(f"_o{i}") + F.col(f"_h{i}")).over(before) for i in each})
    falls = days.agg(*[F.max(F.greatest(f"_f{i}", F.col(f"_p{i}") - F.col(f"_o{i}") - F.col(f"_l{i}"))).alias(f"_d{i}") for i in each])

    def metrics(x):
        gain, loss = F.sum(F.when(x > 0, x).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)))
        return F.struct(
            F.count(F.lit(1)).alias("n_trades"), (F.avg(x) / F.greatest(F.stddev_pop(x), F.lit(1e-6))).alias("sharpe"),
            (gain / F.greatest(loss, F.lit(0.001))).alias("pf"), F.avg((x > 0).cast("double")).alias("win_rate"))

    sums = wide.agg(*[metrics(F.col(f"_v{i}")).alias(f"_r{i}") for i in each])
    table = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_r{i}").alias("_r"), (-F.col(f"_d{i}")).alias("max_dd")) for i, n in enumerate(names)])
    return sums.crossJoin(falls).select(F.inline(table)).select("variant", "_r.*", "max_dd").filter("n_trades > 0")


def sizing_comparison(rows: DataFrame, predicted: Column, target_rr: float = 3.0) -> DataFrame:
    """Model-sized against uniform portfolio."""
    actual = clip(_c("label_rr"), -1.0, 20.0)
    sized = actual * clip(predicted / target_rr, 0.33, 1.5)
    t = rows.select(actual.alias("a"), sized.alias("s"), predicted.alias("p"))
    sharpe = lambda c: F.avg(c) / F.greatest(F.stddev_pop(c), F.lit(1e-6))
    pf = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)) / F.greatest(
        F.abs(F.sum(F.when(F.col(c) < 0, F.col(c)).otherwise(0.0))), F.lit(0.001)
    )
    return t.agg(
        F.count(F.lit(1)).alias("n_trades"), sharpe("a").alias("uniform_sharpe"), pf("a").alias("uniform_pf"),
        sharpe("s").alias("model_sharpe"), pf("s").alias("model_pf"), F.corr("p", "a").alias("pred_corr"),
        F.sqrt(F.avg(F.pow(F.col("p") - F.col("a"), 2))).alias("rmse"),
    )


def feature_stability(importance: DataFrame, top_n: int = 20) -> DataFrame:
    """In how many folds a feature is among the best, and its mean importance."""
    w = Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("feature").agg(
        F.count_if(F.col("_r") <= top_n).alias("folds_in_top"), F.avg("importance").alias("mean_importance")
    )
