"""Training rows from the journal: live trades, rejected signals, missed wins.

``entry_features`` is a map of numbers; the wanted features become columns.
Rejected signals are rows ``id, ts, symbol, direction, entry_price, sl_price, tp_price, entry_features`` with
``outcome_<horizon>`` and ``mfe_<horizon>`` of the horizons scalp, day and swing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.greedy import greedy_keep
from tapeline.operators.labels import clip, counterfactual_label

# Numbers of outcomes and exit reasons, horizons by style id, seconds between two rejections that both count.
OUTCOMES, MECHANISMS = {"win": 1, "loss": 2, "breakeven": 3}, {"tp_hit": 1, "sl_hit": 2, "be_hit": 3, "timeout": 4}
HORIZONS = {0.0: "scalp", 0.5: "day", 1.0: "swing"}
APART = 1800


def complete(rows: DataFrame, features: list[str], column: str = "entry_features") -> DataFrame:
    """The features as columns, of rows that have them all."""
    have = F.map_keys(column)
    return rows.filter(F.forall(F.array(*[F.lit(f) for f in features]), lambda f: F.array_contains(have, f))).withColumns({f: F.col(column)[f] for f in features})


def spaced(rows: DataFrame, tie: str, seconds: int = APART) -> DataFrame:
    """Rows of a symbol and direction at least ``seconds`` after the last one that was kept."""
    timed = rows.withColumn("_start", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_until", F.col("_start") + seconds * 1_000_000)
    return greedy_keep(timed, ["symbol", "direction"], "_start", "_until", tie, 3650 * 86_400_000_000).drop("_start", "_until")


def counterfactual_rows(rejected: DataFrame, features: list[str], horizon: str = "scalp", tie: str = "id", weight: float = 0.3) -> DataFrame:
    """One row of each rejected setup with a known outcome: ``tie, symbol, direction, ts``, features, ``label, sample_weight``.

    Spacing comes first, then rows without all features go.
    """
    if horizon not in HORIZONS.values():
        raise ValueError(f"no horizon {horizon}")
    outcome, mfe = F.col(f"outcome_{horizon}"), F.coalesce(F.col(f"mfe_{horizon}"), F.lit(0.0))
    known = rejected.filter(outcome.isNotNull() & (F.size("entry_features") > 0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    label = counterfactual_label(outcome, mfe, zero("entry_price"), zero("sl_price"), zero("tp_price"))
    rows = complete(spaced(known, tie), features)
    return rows.select(tie, "symbol", "direction", "ts", *features, F.coalesce(label, F.lit(0)).alias("label"), F.lit(weight).alias("sample_weight"))


def nearest_style(style: Column) -> Column:
    """The nearest known style id; between two the smaller one, unknown ones are day trades."""
    return F.when(style <= 0.25, 0.0).when(style > 0.75, 1.0).otherwise(0.5)


def missed_win_rows(rejected: DataFrame, features: list[str], tie: str = "id") -> DataFrame:
    """Rejected signals that won on the horizon of their style, spaced; label and weight are 1."""
    style = nearest_style(F.coalesce(F.col("entry_features")["style_id"], F.lit(0.5)))
    outcome = F.col("outcome_day")
    for k, name in HORIZONS.items():
        outcome = F.when(style == k, F.col(f"outcome_{name}")).otherwise(outcome)
    wins = complete(rejected.filter((F.size("entry_features") > 0) & (outcome == "win")).withColumn("style", style), features)
    return spaced(wins, tie).select(tie, "symbol", "direction", "ts", "style", *features, F.lit(1).alias("label"), F.lit(1.0).alias("sample_weight"))


def live_rows(trades: DataFrame, features: list[str], cost_rr: float = 0.01, weight: float = 2.0) -> DataFrame:
    """Closed trades of the journal as training rows: features (missing ones 0) and labels in R.

    Excursions in percent are divided by the distance of the first stop; below
    0.005 % there is no such unit and they are 0.
    """
    look = lambda t, c, other: F.coalesce(F.create_map(*[F.lit(x) for kv in t.items() for x in kv])[F.col(c)], F.lit(other))
    unit = F.when((F.col("entry_price") != 0) & (F.col("sl_original") != 0), F.abs(F.col("sl_original") - F.col("entry_price")) / F.col("entry_price")).otherwise(0.0)
    in_r = lambda c, top: F.when(F.coalesce(unit, F.lit(0.0)) > 0.00005, clip(F.coalesce(F.col(c), F.lit(0.0)) / unit, 0.0, top)).otherwise(0.0)
    known = trades.filter(F.col("outcome").isin(list(OUTCOMES)))
    mfe = in_r("max_favorable_pct", 20.0)
    target = F.when(F.coalesce(F.col("rr_target"), F.lit(0.0)) != 0, F.col("rr_target")).otherwise(3.0)
    return known.select(
        "trade_id", F.coalesce("asset_class", F.lit("unknown")).alias("asset_class"), *[F.coalesce(F.col("entry_features")[f], F.lit(0.0)).alias(f) for f in features],
        look(OUTCOMES, "outcome", 0).alias("label_outcome"), look(MECHANISMS, "exit_reason", 4).alias("label_exit_mechanism"), F.coalesce("rr_actual", F.lit(0.0)).alias("label_rr"),
        target.alias("label_tp_rr"), mfe.alias("label_max_favorable_rr"), in_r("max_adverse_pct", 5.0).alias("label_mae_rr"), F.lit(cost_rr).alias("label_cost_rr"),
        mfe.alias("label_post_tp_max_rr"), F.lit(0.0).alias("label_post_tp_reversal_rr"), F.lit(weight).alias("sample_weight"))
