"""Overfitting statistics: deflated Sharpe, CPCV, PBO, drawdown tails, regions, gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tapeline.session import materialize, shuffles_dropped

EULER_MASCHERONI = 0.5772156649015329  # fixed value
_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def _ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda x: _NORMAL.inv_cdf(x) if 0 < x < 1 else np.nan)


@F.pandas_udf(DoubleType())
def _cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: _NORMAL.cdf(x) if x == x else np.nan)


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected best Sharpe among ``trials`` strategies without skill."""
    n = trials.cast("double")
    a = (1 - EULER_MASCHERONI) * _ppf(1 - 1 / n)
    b = EULER_MASCHERONI * _ppf(1 - 1 / (n * float(np.e)))
    return F.when((trials < 2) | (variance <= 0), 0.0).otherwise(F.sqrt(variance) * (a + b))


def deflated_sharpe(sharpe: Column, variance: Column, trials: Column, n_obs: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a Sharpe is more than the best of many lucky trials.

    Only aggregate rows reach the two Arrow functions of the normal
    distribution; all else is native.
    """
    spread = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    z = (sharpe - expected_max_sharpe(variance, trials)) * F.sqrt((n_obs - 1).cast("double")) / F.sqrt(spread)
    bad = (trials < 2) | (n_obs < 2) | (variance <= 0) | (spread <= 0)
    return F.when(bad, 0.0).otherwise(_cdf(F.when(bad, 0.0).otherwise(z)))


def trial_variance(trials: DataFrame, sharpe: str = "sharpe") -> DataFrame:
    """Sample variance and number of the usable trial Sharpes."""
    ok = F.when(~F.isnan(sharpe), F.col(sharpe))
    n = F.count(ok)
    return trials.agg(F.when(n >= 2, F.var_samp(ok)).otherwise(0.0).alias("trial_var"), n.alias("n_trials"))


def cpcv_splits(windows: DataFrame, k: int = 2) -> DataFrame:
    """Every choice of k test windows: one row per split and test window.

    ``windows`` is a parameter table; the self join makes C(N, k) rows of it.
    """
    base = windows.select(F.array("window_id").alias("test_idx"), F.col("window_id").alias("_last"))
    nxt = windows.select(F.col("window_id").alias("_n"))
    for _ in range(k - 1):
        base = base.join(nxt, F.col("_n") > F.col("_last")).select(
            F.array_append("test_idx", F.col("_n")).alias("test_idx"), F.col("_n").alias("_last")
        )
    name = F.array_join(F.col("test_idx").cast("array<string>"), "-")
    return base.select(name.alias("split"), F.explode("test_idx").alias("window_id"))


def cpcv_purged(signals: DataFrame, windows: DataFrame, splits: DataFrame, hold_seconds: int, embargo_seconds: int, value: str, ts: str = "ts") -> DataFrame:
    """Per split: tested, training and purged signals with the sum and mean of ``value`` of the first two.

    A training signal is purged when its time, holding time and embargo meet a
    test window of the split (closed ends).  ``windows`` (``window_id,
    test_start, test_end``) and ``splits`` are parameter tables.  Signals are
    first added up by their own window and the run of windows their span
    meets; splits then look at these few classes, so no signal is copied.
    """
    table = windows.agg(F.array_sort(F.collect_list(F.struct("test_start", "test_end", "window_id"))).alias("_w"))
    end = F.col(ts) + F.make_dt_interval(secs=F.lit(hold_seconds + embargo_seconds))
    ids = lambda cond: F.transform(F.filter("_w", cond), lambda w: w["window_id"])
    spanned = signals.crossJoin(F.broadcast(table)).select(
        ids(lambda w: (w["test_start"] <= F.col(ts)) & (w["test_end"] >= F.col(ts))).alias("own"),
        ids(lambda w: (w["test_start"] <= end) & (w["test_end"] >= F.col(ts))).alias("met"), F.col(value).alias("_v"))
    classes = spanned.groupBy("own", "met").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    sets = splits.groupBy("split").agg(F.collect_set("window_id").alias("_t"))
    j = sets.crossJoin(classes)  # windows x runs of windows, whatever the signals
    tested = F.arrays_overlap("own", "_t")
    purged = ~tested & F.arrays_overlap("met", "_t")
    trains = ~tested & ~purged
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_s"))), F.lit(0.0))
    out = j.groupBy("split").agg(
        n(tested).alias("n_test"), n(trains).alias("n_train"), n(purged).alias("n_purged"), total(tested).alias("test_sum"), total(trains).alias("train_sum"))
    return out.withColumns({f"{p}_mean": F.try_divide(F.col(f"{p}_sum"), F.col(f"n_{p}")) for p in ("test", "train")})


def cpcv_evaluate(trades: DataFrame, splits: DataFrame, metrics, trials: DataFrame) -> DataFrame:
    """Metrics of every split on the union of its test windows, with deflated Sharpe.

    ``metrics(trades, keys)`` is the caller's evaluation (DataFrame in and
    out).  A trade is copied once per split that tests its window.
    """
    pool = trades.join(splits, "window_id")
    rows = metrics(pool, ["split"]).crossJoin(F.broadcast(trial_variance(trials)))
    dsr = deflated_sharpe(
        F.col("sharpe"), F.col("trial_var"), F.col("n_trials"), F.col("n"), F.col("skew"), F.col("kurt_nonexcess")
    )
    return rows.withColumn("dsr", dsr)


def cpcv_summary(splits: DataFrame, funded: float = 0.95, research: float = 0.70) -> DataFrame:
    q = lambda p: F.percentile("dsr", F.lit(p))
    return splits.agg(
        F.count(F.lit(1)).alias("n_splits"),
        q(0.5).alias("median_dsr"),
        F.avg("dsr").alias("mean_dsr"),
        (q(0.75) - q(0.25)).alias("dsr_iqr"),
        F.percentile("sharpe", F.lit(0.5)).alias("median_sharpe"),
        F.avg((F.col("dsr") >= funded).cast("double")).alias("percent_passing_funded"),
        F.avg((F.col("dsr") >= research).cast("double")).alias("percent_passing_research"),
    )


def half_splits(spark: SparkSession, n_windows: int) -> DataFrame:
    """All in-sample halves of the windows, as bit masks."""
    return spark.range(1 << n_windows).filter(F.bit_count("id") == n_windows // 2).select(F.col("id").alias("mask"))


def pbo(performance: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split: the in-sample best trial, its out-of-sample rank and logit.

    ``performance`` is long: ``trial, window_id (0..), value``.  One grouped
    average per (split, trial) gives both halves; ranks are counts.
    """
    inside = F.getbit(F.col("mask"), F.col("window_id").cast("int")) == 1
    means = performance.crossJoin(splits).groupBy("mask", "trial").agg(
        F.avg(F.when(inside, F.col("value"))).alias("is_mean"), F.avg(F.when(~inside, F.col("value"))).alias("oos_mean")
    )
    best = means.groupBy("mask").agg(F.max("is_mean").alias("is_mean"))
    # the lowest trial number wins ties
    star = means.join(best, ["mask", "is_mean"]).groupBy("mask").agg(
        F.min("trial").alias("best_trial"), F.min_by("oos_mean", "trial").alias("_star")
    )
    joined = means.join(star, "mask")
    ranked = joined.groupBy("mask", "best_trial").agg(
        (F.count_if(F.col("oos_mean") < F.col("_star")) + (F.count_if(F.col("oos_mean") == F.col("_star")) + 1) / 2).alias("rank"),
        F.count(F.lit(1)).alias("n_trials"),
    )
    omega = F.least(F.greatest(F.col("rank") / (F.col("n_trials") + 1), F.lit(1e-6)), F.lit(1 - 1e-6))
    return ranked.withColumn("omega", omega).withColumn("logit", F.ln(F.col("omega") / (1 - F.col("omega"))))


def pbo_summary(ranked: DataFrame) -> DataFrame:
    return ranked.agg(
        F.avg((F.col("omega") < 0.5).cast("double")).alias("pbo"),
        F.count(F.lit(1)).alias("n_splits"),
        F.percentile("logit", F.lit(0.5)).alias("lambda_median"),
    )


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Even partitions, as many as the shuffle setting says, before every row is copied many times."""
    return df.repartition(F.col(key))


#: Places that a task sorts and packs at a time, places in a part of a permutation, and permutations whose places are made side by side (code for more of
#: them is too long to be compiled).
CHUNK, PART, BAND = 1 << 23, 1 << 21, 25
#: Steps that are in the shuffle at a time, some 10 GB if they have few sizes.
PASS = 1 << 31
_BLOCK = pa.schema([("sim", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary()), ("steps", pa.binary())])
BLOCK = "sim long, part int, n long, first long, width int, places binary, sizes binary, steps binary"


def _packed(batches: Iterator[pa.RecordBatch], n_simulations: int, parts: int, side: int, size: int) -> Iterator[pa.RecordBatch]:
    """Steps ``band, g, o0, o1, ...`` as one block for each simulation and part: places in order as differences, sizes as numbers of a dictionary if they are few."""
    def blocks(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        bands = chunk["band"].to_numpy()
        sizes, codes = np.unique(chunk["g"].to_numpy(), return_inverse=True)
        for band in np.unique(bands):
            rows, here = [], slice(None) if (bands == band).all() else bands == band
            for k in range(min(side, n_simulations - int(band) * side)):
                u = (chunk[f"o{k}"].to_numpy()[here].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(16)
                if len(sizes) <= 1 << 16:
                    both = np.sort((u << np.uint64(16)) | codes[here].astype(np.uint64))
                    u, c = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
                else:
                    order = np.argsort(u)
                    u, c = u[order], codes[here][order]
                few = len(sizes) <= 1 << 8
                c = c.astype(np.uint8) if few else sizes[c]
                apart = np.diff(u, prepend=u[:1])
                part = ((u * np.uint64(parts)) >> np.uint64(48)).astype(np.int64)
                edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(u)]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    d = apart[i + 1 : j]
                    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
                    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
                    rows.append((int(band) * side + k, int(part[i]), j - i, int(u[i]), width, pa.compress(planes.tobytes(), "zstd", asbytes=True),
                                 sizes.tobytes() if few else b"", pa.compress(c[i:j].tobytes(), "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _BLOCK, strict=True)], names=_BLOCK.names)

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows * min(side, n_simulations)
        if n >= size:
            yield from blocks(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from blocks(pa.Table.from_batches(held))


def _walked(key: tuple, blocks: pa.Table) -> pa.Table:
    """Sum, highest and lowest partial sum and worst fall of one part of a permutation."""
    places, steps, table = [], [], np.unique(np.frombuffer(b"".join(blocks["sizes"].to_pylist()), np.float64))
    few = len(table) <= 1 << 16 and all(blocks["sizes"].to_pylist())
    for b in blocks.to_pylist():
        apart = np.zeros((b["n"] - 1, 8), np.uint8)
        apart[:, : b["width"]] = np.frombuffer(pa.decompress(b["places"], (b["n"] - 1) * b["width"], "zstd", asbytes=True), np.uint8).reshape(b["width"], b["n"] - 1).T
        places.append(np.cumsum(np.concatenate([[b["first"]], apart.view(np.int64).ravel()])))
        raw = pa.decompress(b["steps"], b["n"] * (1 if b["sizes"] else 8), "zstd", asbytes=True)
        sizes = np.frombuffer(b["sizes"], np.float64)
        steps.append((np.searchsorted(table, sizes).astype(np.uint64) if few else sizes)[np.frombuffer(raw, np.uint8)] if b["sizes"] else np.frombuffer(raw, np.float64))
    u, g = np.concatenate(places), np.concatenate(steps)
    if few:  # place and number of the size in one word
        g = table[np.sort((u.view(np.uint64) << np.uint64(16)) | g) & np.uint64(0xFFFF)]
    else:
        order = np.argsort(u, kind="stable")
        g = g[np.lexsort((g, u)) if (np.diff(u[order]) == 0).any() else order]
    run = np.cumsum(g)
    fall = (run - np.maximum.accumulate(run)).min()
    return pa.table({"sim": [key[0].as_py()], "_part": pa.array([key[1].as_py()], pa.int32()), "_t": [run[-1]], "_high": [run.max()], "_low": [run.min()], "_fall": [fall]})


def shuffled_drawdowns(trades: DataFrame, n_simulations: int = 1000, tie: str = "trade_id", seed: int = 42, parts: int = 1) -> DataFrame:
    """Worst drawdown of each seeded permutation of the trades' R results.

    ``trades``: ``rr, risk``; counted first.  Equity compounds, so its
    logarithm is a running sum.  The permutation order is a hash (its first 48
    bits; steps equal in these go by size), cut by range into at least ``parts``
    pieces per simulation; pieces are reduced to (sum, highest and lowest partial
    sum, worst fall) and joined in order, so a long permutation is never in one
    task.  A step crosses the shuffle in a few bytes, see ``_packed``; bands of
    permutations run one after another, so that at most ``PASS`` steps are in it.
    """
    growth = F.greatest(1 + F.col("risk") * F.least(F.greatest(F.col("rr"), F.lit(-2.0)), F.lit(15.0)), F.lit(1e-12))
    spark = trades.sparkSession
    steps = materialize(_spread(trades.select(tie, F.ln(growth).alias("g")), tie))
    n = steps.count()
    parts = max(parts, min(1 << 15, n // PART))
    side = min(BAND, n_simulations)
    pack = lambda it, side=side, size=CHUNK: _packed(it, n_simulations, parts, side, size)

    places = [F.xxhash64(F.lit(seed), F.col("band") * side + k, tie).alias(f"o{k}") for k in range(side)]
    bands, at_once, found = -(-n_simulations // side), max(1, PASS // max(1, n * side)), []
    for first in range(0, bands, at_once):
        last = min(bands, first + at_once)
        # A task of this product has one band, so that what it packs together are steps of the same permutations.
        each = steps.hint("shuffle_replicate_nl").crossJoin(spark.range(first, last, 1, last - first).withColumnRenamed("id", "band"))
        packed = each.select("band", "g", *places).mapInArrow(pack, BLOCK)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * side * (last - first) // (8 * PART))
        walked = packed.repartition(tasks, "sim", "part").groupBy("sim", "part").applyInArrow(_walked, "sim long, _part int, _t double, _high double, _low double, _fall double")
        with shuffles_dropped(spark):
            found.append(materialize(walked))
    part = reduce(DataFrame.unionAll, found)
    by_sim = Window.partitionBy("sim").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    based = part.withColumn("_base", F.coalesce(F.sum("_t").over(by_sim), F.lit(0.0)))
    based = based.withColumn("_peak", F.max(F.col("_base") + F.col("_high")).over(by_sim))
    fall = F.least(F.col("_fall"), F.coalesce(F.col("_base") + F.col("_low") - F.col("_peak"), F.lit(0.0)))
    return based.withColumn("_dd", fall).groupBy("sim").agg(
        (F.exp(F.min("_dd")) - 1).alias("max_dd"), F.exp(F.sum("_t")).alias("final_growth")
    )


def with_median_risk(trades: DataFrame, risk: str, least: int = 5, fallback: float = 0.01) -> DataFrame:
    """Trades with ``risk`` set to the median of all, as the simulation uses it; none if there are fewer than ``least``."""
    middle = trades.agg(F.percentile(risk, F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return trades.drop("risk").crossJoin(F.broadcast(middle)).filter(F.col("_n") >= least).withColumn("risk", F.coalesce("_m", F.lit(fallback))).drop("_m", "_n")


def drawdown_tail(sims: DataFrame, n_simulations: int, confidence: float = 0.95, account: float = 100_000.0) -> DataFrame:
    """Value at risk and expected shortfall of the simulated drawdowns, and the interval of the final results.

    ``robust``: the lower end of the interval is a profit.
    """
    tail = max(1, int(np.ceil((1 - confidence) * n_simulations)))
    ranked = sims.withColumn("_r", F.row_number().over(Window.orderBy("max_dd", "sim")))  # one row per simulation
    in_tail = F.when(F.col("_r") <= tail, F.col("max_dd"))
    pnl = account * (F.col("final_growth") - 1)
    return ranked.agg(
        F.avg(in_tail).alias("cvar_dd"), F.max(in_tail).alias("var_dd"), F.percentile("max_dd", F.lit(0.5)).alias("median_dd"),
        F.avg("max_dd").alias("mean_dd"), F.avg((F.col("final_growth") > 1).cast("double")).alias("pct_profitable"),
        F.count(F.lit(1)).alias("n_simulations"), *[F.percentile(pnl, F.lit(q)).alias(n) for n, q in (
            ("median_final_pnl", 0.5), ("ci_lower_pnl", (1 - confidence) / 2), ("ci_upper_pnl", (1 + confidence) / 2))],
    ).withColumn("robust", F.coalesce(F.col("ci_lower_pnl") > 0, F.lit(False)))


def region_grid(grid: DataFrame, x: str, y: str, value: str, columns: list | None = None) -> DataFrame:
    """Median of a metric per parameter cell, as a wide pivot."""
    return grid.groupBy(y).pivot(x, columns).agg(F.percentile(value, F.lit(0.5)))


def region_summary(
    grid: DataFrame, x: str, y: str, dsr: str, sharpe: str, top_pct: float = 0.10, gate: float = 0.10, rel_gate: float = 0.15
) -> DataFrame:
    """Spread of the best cells: flat tops pass, ridges fail."""
    med = lambda c: F.percentile(c, F.lit(0.5))
    cells = grid.groupBy(y, x).agg(med(dsr).alias("_d"), med(sharpe).alias("_s")).filter("_d is not null")
    # the grid has one row per parameter cell: bounded by the parameter lists
    ranked = cells.withColumns(
        {
            "_r": F.row_number().over(Window.orderBy(F.desc("_d"), y, x)),
            "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))),
        }
    )
    top = ranked.filter(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * top_pct)))
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = top.agg(
        F.max("_n").alias("n_cells_valid"), F.count(F.lit(1)).alias("n_cells_top"),
        F.max("_d").alias("top_cells_max"), F.min("_d").alias("top_cells_min"),
        (q("_d", 0.9) - q("_d", 0.1)).alias("spread_q90_q10"),
        ((q("_s", 0.9) - q("_s", 0.1)) / F.greatest(F.abs(q("_s", 0.5)), F.lit(1e-6))).alias("sharpe_rel_spread"),
        F.count("_s").alias("_ns"),
    )
    return out.withColumns(
        {
            "dsr_gate_pass": F.col("spread_q90_q10") < gate,
            "sharpe_gate_pass": (F.col("_ns") >= 2) & (F.col("sharpe_rel_spread") < rel_gate),
        }
    ).drop("_ns")


def lattice_stability(results: DataFrame, axes: list[str], metric: str = "pf_real", key: str = "combo_id", reach: float = 0.10, limit: float = 50.0) -> DataFrame:
    """``key, neighbours, max_pf_change_pct, stable`` of every point of a parameter lattice.

    A neighbour differs in one axis only, by at most ``reach`` of the value.
    The other axes are equal, so each axis is an equi join of the lattice with
    itself; a point without neighbours is stable.
    """
    pairs = None
    for axis in axes:
        same = [a for a in axes if a != axis]
        other = results.select(*same, F.col(axis).alias("_x"), F.col(metric).alias("_m"))
        here = results.select(key, *same, F.col(axis).alias("_v"), F.col(metric).alias("_own"))
        joined = (here.join(other, same) if same else here.crossJoin(other)).filter((F.col("_x") != F.col("_v")) & (F.abs(F.col("_x") - F.col("_v")) <= reach * F.abs(F.col("_v")) * (1 + 1e-9)))
        moved = joined.select(key, (F.abs(F.col("_m") - F.col("_own")) / F.greatest(F.abs("_own"), F.lit(1e-9)) * 100).alias("_c"))
        pairs = moved if pairs is None else pairs.unionByName(moved)
    shift = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("neighbours"), F.max("_c").alias("max_pf_change_pct"))
    out = results.select(key).join(shift, key, "left").fillna({"neighbours": 0, "max_pf_change_pct": 0.0})
    return out.withColumn("stable", F.round("max_pf_change_pct", 9) < limit)


def qualified_trials(results: DataFrame, key: str = "combo_id", least: int = 5) -> DataFrame:
    """``key, sharpe, used_fallback``: the trials that count for the deflated Sharpe, with their mean over the windows.

    Evergreen combinations; where there are fewer than ``least``, those that
    traded in every window.
    """
    per = results.groupBy(key).agg(
        F.max("is_evergreen").alias("_e"), F.min(F.coalesce(F.col("total_trades"), F.lit(0)) > 0).alias("_all"), F.avg(F.when(~F.isnan("sharpe"), F.col("sharpe"))).alias("sharpe"))
    enough = per.agg((F.count_if(F.coalesce("_e", F.lit(False))) < least).alias("used_fallback"))
    kept = F.when(F.col("used_fallback"), F.col("_all")).otherwise(F.col("_e"))
    return per.crossJoin(F.broadcast(enough)).filter(kept & F.col("sharpe").isNotNull()).select(key, "sharpe", "used_fallback")


def acceptance_gates(metrics: DataFrame, dsr_threshold: float = 0.70, max_dd: float = -0.10, small_sample: int = 30) -> DataFrame:
    """All eight gates per run, the list of failed ones, and warnings.

    Columns that are missing skip their gate: ``mc_robust`` and ``mc_worst_dd``
    (simulated paths), ``stable`` and ``n_real`` (neighbouring parameters;
    fewer than ``small_sample`` real trades pass, with a warning), ``dsr``.
    """
    c, have = F.col, metrics.columns
    least_trades = F.when(c("asset_class").isin("forex", "commodities"), 5).otherwise(20)
    gates = {
        "profit_factor": c("pf_real") >= 1.5,
        "min_trades": c("total_trades") >= least_trades,
        "sharpe": c("sharpe") >= 0.5,
        "max_dd": c("max_drawdown") >= max_dd,
        "quality": (c("winrate_real") > 0.20) & (c("expectancy") > 0),
    }
    if "dsr" in have:
        gates["dsr"] = c("dsr") >= dsr_threshold
    if "mc_worst_dd" in have or "mc_robust" in have:
        gates["monte_carlo"] = (c("mc_worst_dd") >= max_dd if "mc_worst_dd" in have else F.lit(True)) & (c("mc_robust") if "mc_robust" in have else F.lit(True))
    warnings = [
        F.when(c("pf_real") > 10, F.lit("suspicious_pf")), F.when(c("winrate_real") > 0.80, F.lit("suspicious_wr")), F.when(c("be_rate") > 0.50, F.lit("high_be_rate")),
    ]
    if "stable" in have:
        few = (c("n_real") if "n_real" in have else F.lit(0)) < small_sample
        gates["stability"] = few | c("stable")
        warnings.append(F.when(few & ~c("stable"), F.lit("stability_skipped")))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))
    return metrics.withColumns({"failed": failed, "warnings": F.array_compact(F.array(*warnings))}).withColumn("passed", F.size("failed") == 0)


def threshold_sweep(rows: DataFrame, score: str, value: str, thresholds: list[float]) -> DataFrame:
    """``threshold, accepted, sum_value`` of the rows at or above each threshold.

    Rows are added up by the band between two thresholds; the sums of a
    threshold are those of the bands above it.  Null scores are accepted nowhere.
    """
    limits = sorted(thresholds)
    table = F.array(*[F.lit(float(t)) for t in limits])
    bands = rows.filter(F.col(score).isNotNull()).groupBy(F.size(F.filter(table, lambda t: t <= F.col(score))).alias("_band")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    each = bands.filter("_band > 0").select("_n", "_v", F.explode(F.sequence(F.lit(1), F.col("_band"))).alias("_k"))
    return each.groupBy(F.element_at(table, F.col("_k")).alias("threshold")).agg(F.sum("_n").alias("accepted"), F.sum("_v").alias("sum_value"))


def bootstrap(values: DataFrame, value: str, replicates: int, tie: str, seed: int = 42) -> DataFrame:
    """Mean and profit factor of resamples, by Poisson(1) weights per row.

    Every row draws its own number of copies in every replicate from a hash:
    no positions, no joins, one aggregation with map-side combine.
    """
    reps = values.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    u = (F.xxhash64(F.lit(seed), "replicate", F.col(tie)).cast("double") / float(2**63) + 1) / 2
    cuts, total, p = [], 0.0, float(np.exp(-1.0))
    k = 0
    while total + p > total:  # until a term no longer changes the sum
        total += p
        cuts.append(total)
        k += 1
        p /= k
    copies = sum((F.when(F.col("_u") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = _spread(values, tie).crossJoin(F.broadcast(reps)).withColumn("_u", u).withColumn("_k", copies)
    x = F.col(value) * F.col("_k")
    return rows.groupBy("replicate").agg(
        (F.sum(x) / F.sum("_k")).alias("mean"),
        (F.sum(F.greatest(x, F.lit(0.0))) / F.greatest(F.abs(F.sum(F.least(x, F.lit(0.0)))), F.lit(1e-9))).alias("pf"),
    )


def bootstrap_interval(reps: DataFrame, alpha: float = 0.05) -> DataFrame:
    q = lambda c, p: F.percentile(c, F.lit(p))
    return reps.agg(*[q(c, p).alias(f"{c}_{n}") for c in ("mean", "pf") for n, p in (("low", alpha / 2), ("high", 1 - alpha / 2))])


def variants_around(base: DataFrame, factors: dict[str, list[float]], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per factor of each parameter, others at their base value, clamped."""
    moves = [(name, f) for name, fs in factors.items() for f in fs]
    table = base.sparkSession.createDataFrame([(i, n, f) for i, (n, f) in enumerate(moves)], "variant int, parameter string, factor double")
    rows = base.crossJoin(F.broadcast(table))
    out = {}
    for name in factors:
        lo, hi = bounds[name]
        moved = F.when(F.col("parameter") == name, F.col(name) * F.col("factor")).otherwise(F.col(name))
        out[name] = F.least(F.greatest(moved, F.lit(lo)), F.lit(hi))
    return rows.withColumns(out)
