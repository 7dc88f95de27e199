"""Statistics with hand-computed or brute-force results."""

import itertools
import time
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.functions import scores
from tapeline.operators import bars as B
from tapeline.operators import drift as D
from tapeline.operators import journal as J
from tapeline.operators import portfolio as P
from tapeline.operators import sampling as K
from tapeline.operators import validation as V
from tapeline.session import shuffles_dropped


def test_equity_curve_example(spark):
    rows = [(f"2024-01-0{i + 1} 10:00:00", f"t{i}", float(p)) for i, p in enumerate((100, -50, 200, -25))]
    t = spark.createDataFrame(rows[::-1], "e string, trade_id string, pnl double").withColumn("exit_time", F.col("e").cast("timestamp"))
    got = [r.equity for r in J.equity_curve(t, account=10_000.0).orderBy("exit_time").collect()]
    assert got == [10100, 10050, 10250, 10225]


def test_moments_equal_pandas(spark):
    x = np.random.default_rng(0).normal(0, 1, 40)
    df = spark.createDataFrame([(1, float(v)) for v in x], "k int, daily_return double")
    m = J.return_moments(df, ["k"]).first()
    s = pd.Series(x)
    assert m.skew == pytest.approx(s.skew()) and m.kurt_nonexcess == pytest.approx(s.kurtosis() + 3)
    few = J.return_moments(df.limit(3), ["k"]).first()
    assert (few.skew, few.kurt_nonexcess) == (0.0, 3.0)


def test_deflated_sharpe(spark):
    rows = [(1.0, 0.5, 20, 100), (2.0, 0.5, 20, 100), (2.0, 0.5, 200, 100), (2.0, 0.0, 20, 100), (2.0, 0.5, 1, 100)]
    df = spark.createDataFrame(rows, "s double, v double, n int, o int")
    got = [r.d for r in df.select(V.deflated_sharpe(F.col("s"), F.col("v"), F.col("n"), F.col("o"), F.lit(0.0), F.lit(3.0)).alias("d")).collect()]
    nd = NormalDist()
    e = 0.5772156649015329

    def want(s, v, n, o):
        best = v**0.5 * ((1 - e) * nd.inv_cdf(1 - 1 / n) + e * nd.inv_cdf(1 - 1 / (n * np.e)))
        return nd.cdf((s - best) * (o - 1) ** 0.5 / (1 + 0.5 * s * s) ** 0.5)

    assert got[:3] == pytest.approx([want(*r) for r in rows[:3]])
    assert got[0] < got[1] and got[2] < got[1] and got[3:] == [0.0, 0.0]


def test_pbo_of_a_dominant_trial_is_zero(spark):
    m = np.outer(np.arange(1, 7), np.linspace(1, 2, 8))
    perf = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(6) for j in range(8)], "trial int, window_id int, value double")
    out = V.pbo_summary(V.pbo(perf, V.half_splits(spark, 8))).first()
    assert out.pbo == 0.0 and out.n_splits == 70


def test_cpcv_splits_are_all_pairs(spark):
    w = spark.range(6).select(F.col("id").cast("int").alias("window_id"))
    got = {r.split for r in V.cpcv_splits(w, 2).collect()}
    assert got == {f"{a}-{b}" for a, b in itertools.combinations(range(6), 2)}


def test_drawdown_simulation_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(200), "rr": rng.normal(0.1, 1.5, 200), "risk": 0.02})
    df = spark.createDataFrame(pdf)
    sims = V.shuffled_drawdowns(df, 5, "id", parts=7)
    got = {r.sim: r.max_dd for r in sims.collect()}
    order = df.crossJoin(spark.range(5).withColumnRenamed("id", "sim")).withColumn("o", F.xxhash64(F.lit(42), F.col("sim"), F.col("id")))
    for sim, g in order.toPandas().groupby("sim"):
        eq = np.cumprod(1 + 0.02 * g.sort_values("o")["rr"].clip(-2, 15).to_numpy())
        assert got[sim] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())
    tail = V.drawdown_tail(sims, 5).first()
    assert tail.cvar_dd <= tail.var_dd <= tail.median_dd


@pytest.mark.parametrize("sizes", [3, 2000])
def test_drawdown_simulation_sends_few_bytes_a_step(spark, sizes, monkeypatch):
    """Blocks of several chunks give the loop's result, at less than half the bytes of a row of place and step."""
    monkeypatch.setattr(V, "CHUNK", 1 << 13)
    monkeypatch.setattr(V, "BAND", 3)
    pdf = pd.DataFrame({"id": [f"t{i}" for i in range(20_000)], "rr": np.random.default_rng(6).integers(0, sizes, 20_000) / sizes - 0.4, "risk": 0.02})
    df = spark.createDataFrame(pdf).repartition(3)
    got = {r.sim: (r.max_dd, r.final_growth) for r in V.shuffled_drawdowns(df, 4, "id").collect()}
    order = df.crossJoin(spark.range(4).withColumnRenamed("id", "sim")).withColumn("o", F.xxhash64(F.lit(42), F.col("sim"), F.col("id")))
    for sim, g in order.toPandas().groupby("sim"):
        eq = np.exp(np.cumsum(np.log(1 + 0.02 * g.sort_values("o")["rr"].to_numpy())))
        assert got[sim] == pytest.approx(((eq / np.maximum.accumulate(eq) - 1).min(), eq[-1]))
    o = np.random.default_rng(7).integers(-(2**63), 2**63 - 1, 1 << 16)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(o), np.int64)), pa.array(pdf["rr"].to_numpy()[np.arange(len(o)) % 20_000]), pa.array(o)], names=["band", "g", "o0"])
    (block,) = V._packed(iter([batch]), 1, 8, 1, len(o))
    assert block.nbytes < (6 if sizes == 3 else 13) * len(o)


def test_bootstrap_is_centred_and_repeatable(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(2000)], "id int, x double")
    a = V.bootstrap(df, "x", 40, "id").agg(F.avg("mean").alias("m"), F.stddev("mean").alias("s")).first()
    assert a == V.bootstrap(df, "x", 40, "id").agg(F.avg("mean").alias("m"), F.stddev("mean").alias("s")).first()
    assert abs(a.m - 4.5) < 0.05 and 0.03 < a.s < 0.12


def test_drift_equals_numpy(spark):
    rng = np.random.default_rng(9)
    train, live = rng.normal(0, 1, 800), np.round(rng.normal(0.5, 1, 300), 1)
    make = lambda x: spark.createDataFrame([(float(v),) for v in x] + [(None,)], "f double")
    c = D.cumulated(D.value_counts(make(train), make(live), ["f"]), 32)
    allv = np.sort(np.concatenate([train, live]))
    ks = np.max(np.abs(np.searchsorted(np.sort(train), allv, "right") / 800 - np.searchsorted(np.sort(live), allv, "right") / 300))
    bins = np.unique(np.quantile(train, np.linspace(0, 1, 11)))
    e, a = np.histogram(train, bins)[0], np.histogram(live, bins)[0]
    e, a = e / e.sum(), a / a.sum()
    e, a = np.where(e == 0, 1e-6, e), np.where(a == 0, 1e-6, a)
    assert D.ks_statistic(c).first().ks == pytest.approx(ks)
    assert D.psi(c).first().psi == pytest.approx(np.sum((a - e) * np.log(a / e)))


def test_exact_quota_samples(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label_action"), F.lit("crypto").alias("asset_class"))
    out = K.subsample_no_trade(df, 2.0, "id").groupBy("label_action").count().collect()
    assert {r.label_action: r["count"] for r in out} == {0: 4000, 1: 2000}
    first = sorted(r.id for r in K.stratified(df, ["label_action"], 0.1, "id").collect())
    assert first == sorted(r.id for r in K.stratified(df.repartition(7), ["label_action"], 0.1, "id").collect())


def test_alignment_of_all_flag_combinations(spark):
    names = ["bias", "bias_strong", "h4", "h4_poi", "h1", "h1_choch", "zone", "trigger", "volume"]
    combos = list(itertools.product([False, True], repeat=9))
    df = spark.createDataFrame(combos, names)
    got = df.select(*names, scores.alignment({n: F.col(n) for n in names}).alias("s")).collect()
    for r in got:
        f = {n: r[n] for n in names}
        f["bias_strong"] &= f["bias"]
        f["h1_choch"] &= f["h1"]
        want = sum(w for n, w in scores.WEIGHTS.items() if f[n])
        if not (r.bias_strong or r.h4 or r.h4_poi or r.h1_choch or r.volume):
            want = min(want * 1.3, 1)
        assert r.s == pytest.approx(min(want, 1))


def test_risk_fraction_ends(spark):
    df = spark.createDataFrame([(0.5,), (0.78,), (0.89,), (1.0,)], "s double")
    got = [r.f for r in df.select(scores.risk_fraction(F.col("s")).alias("f")).collect()]
    assert got == pytest.approx([0.0, 0.0025, 0.00625, 0.01])


def _book(spark, moves, days):
    rows = [("k", f"t{i}", f"S{i}", f"2024-01-{d:02d} {10 + i % 10}:00:00", 1.0, 100.0 * (1 + m)) for i, (m, d) in enumerate(zip(moves, days))]
    df = spark.createDataFrame(rows, "acct string, trade_id string, symbol string, t string, score double, exit_price double")
    return df.selectExpr("*", "cast(t as timestamp) ts", "cast(t as timestamp) + interval 30 minutes exit_ts", "100.0D entry", "99.0D stop", "1 direction",
                         "'x' outcome", "0.0D cost_pct", "0.03D risk_cap")


def test_portfolio_adds_fixed_risk(spark):
    out = P.portfolio_run(_book(spark, [0.01, -0.01, 0.02], [1, 1, 9]), ["acct"]).orderBy("ts").collect()
    assert [round(r.equity, 6) for r in out] == [101000.0, 100000.0, 102000.0]
    assert [round(r.actual_rr, 9) for r in out] == [1.0, -1.0, 2.0]
    unscored = _book(spark, [0.01], [1]).withColumn("score", F.lit(0.5))
    assert P.portfolio_run(unscored, ["acct"]).count() == 0


def test_pause_run_equals_the_walk(spark):
    import random

    rng = random.Random(4)
    rows = [(k, f"{i:04d}", 1_700_000_000 + rng.randrange(40 * 86400), rng.choice([-0.02, -0.01, 0.005, 0.01])) for k in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "k string, trade_id string, s long, pnl_pct double").withColumn("ts", F.timestamp_seconds("s"))
    want = set()
    for k in "ab":
        day = week = None
        d = w = t = 0
        for _, i, s, x in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            x = round(x * 1000)
            if s // 86400 != day:
                day, d = s // 86400, 0
            if (day + 3) // 7 != week:
                week, w = (day + 3) // 7, 0
            if t > -400 and d > -30 and w > -50:
                d, w, t = d + x, w + x, t + x
                want.add((k, i))
    got = {(r.k, r.trade_id) for r in P.pause_run(df, ["k"], -0.03, -0.05, -0.4).collect()}
    assert got == want and 0 < len(got) < 800


def test_nothing_is_cut_off(spark):
    from tapeline.operators import market as M
    from tapeline.operators import models as L

    assert V.half_splits(spark, 12).count() == 924 and V.half_splits(spark, 12).distinct().count() == 924
    bars = spark.range(5100).select(F.lit("A").alias("symbol"), F.col("id").alias("bar_idx"), F.lit(5100).alias("n_bars"), *[F.lit(10.0).alias(c) for c in ("open", "low", "close", "volume")], (F.lit(10.0) + F.col("id")).alias("high"))
    assert M.symbol_profile(bars).first().bars == 5100 and M.symbol_profile(bars, first_rows=5000).first().bars == 5000
    scored = spark.range(2000).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") / 2000 - (F.col("id") % 2) * 0.0007).alias("p"))
    rank = sorted((i / 2000 - (i % 2) * 0.0007, i % 2) for i in range(2000))
    exact = (sum(j for j, (_, y) in enumerate(rank, 1) if y) - 1000 * 1001 / 2) / 1e6
    assert L.auc(scored, "y", "p") == pytest.approx(exact, abs=1e-12)
    ranked = spark.createDataFrame([(1, f"S{i}", "crypto", i, 0.9, False, False) for i in range(1, 15)], "cycle int, symbol string, asset_class string, rank int, score double, conflict boolean, held boolean")
    decided = P.allocate(ranked, "cycle").collect()
    assert len(decided) == 14 and sum(r.reason == "rank" for r in decided) == 4


def test_one_position_per_symbol(spark):
    two = _book(spark, [0.01, 0.01], [1, 1]).withColumn("symbol", F.lit("S")).withColumn("exit_ts", F.expr("ts + interval 5 hours"))
    assert P.portfolio_run(two, ["acct"]).count() == 1


def test_auc_of_groups_with_ties(spark):
    from tapeline.operators import models as M

    rng = np.random.default_rng(6)
    rows = [(g, float(s), bool(y)) for g, n in (("hot", 600), ("b", 40)) for s, y in zip(rng.integers(0, 50, n) / 7, rng.random(n) < 0.3, strict=True)]
    rows += [("one", 1.0, True), ("one", 2.0, True), ("b", None, True), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r.auc for r in M.auc_by_group(M.score_counts(df, ["g"], "s", "y"), ["g"], pieces=7).collect()}
    for g in ("hot", "b"):
        pos = np.array([s for k, s, y in rows if k == g and y and s is not None])
        neg = np.array([s for k, s, y in rows if k == g and y is False])
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
        assert abs(got[g] - want) < 1e-12
    assert got["one"] == 0.0


def test_fold_gap_uses_earlier_folds_only(spark):
    from tapeline.operators import models as M

    rows = [(0, 0.9, True), (0, 0.1, False), (1, 0.2, True), (1, 0.8, False), (2, 0.7, True), (2, 0.3, False)]
    got = {r.f: (r.test_auc, r.train_auc, r.overfit_flag) for r in M.fold_gaps(spark.createDataFrame(rows, "f int, s double, y boolean"), "f", "s", "y").collect()}
    assert got == {0: (1.0, 0.0, False), 1: (0.0, 1.0, True), 2: (1.0, 0.75, False)}


def test_purge_with_embargo(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    w = spark.createDataFrame([(0, day(1), day(5)), (1, day(10), day(15)), (2, day(20), day(25))], "window_id int, a string, b string").selectExpr(
        "window_id", "timestamp(a) test_start", "timestamp(b) test_end")
    s = spark.createDataFrame([(day(2), 1.0), (day(8), 2.0), (day(9), 4.0), (day(12), 8.0), (day(28), 16.0)], "t string, rr double").selectExpr("timestamp(t) ts", "rr")
    got = {r.split: (r.n_test, r.n_train, r.n_purged, r.test_sum, r.train_sum) for r in V.cpcv_purged(s, w, V.cpcv_splits(w, 1), 43_200, 43_200, "rr").collect()}
    # one day after its signal a trade is over: that of the 9th meets the second window, that of the 8th does not
    assert got == {"0": (1, 4, 0, 1.0, 30.0), "1": (1, 3, 1, 8.0, 19.0), "2": (0, 5, 0, 0.0, 31.0)}


def test_few_trades_give_no_simulation(spark):
    t = spark.createDataFrame([(i, 1.0, r) for i, r in enumerate([0.01, 0.03, 0.02, 0.5, 0.01])], "trade_id long, rr double, risk double")
    assert {r.risk for r in V.with_median_risk(t, "risk").collect()} == {0.02}
    assert V.with_median_risk(t.limit(4), "risk").collect() == []
    sims = V.shuffled_drawdowns(V.with_median_risk(t, "risk"), 20, "trade_id")
    tail = V.drawdown_tail(sims, 20).first()
    assert tail.robust and abs(tail.median_final_pnl - 100_000 * (1.02**5 - 1)) < 1e-6


def test_drift_stores_counts_and_no_samples(spark, monkeypatch):
    """The samples are read with the columns of the report only; their counts are stored and made once."""
    from tapeline.catalog import validation_queries as Q

    stored, keep = [], D.materialize
    for module in (Q, D):
        monkeypatch.setattr(module, "materialize", lambda df, *by: stored.append(df.columns) or keep(df, *by))
    assert Q.drift_report(spark, "/root/testdata/sf0.001").count() == 3
    assert ["feature", "value", "t", "l"] in stored and not any("sample_id" in c for c in stored)


def test_variant_metrics_equal_a_loop(spark):
    """Several variants over many days; rows without a time come last and count."""
    from tapeline.operators import labels as L

    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"day": [*rng.integers(0, 40, 300).tolist(), None, None], "id": [f"s{i:03d}" for i in range(302)], "a": rng.normal(0, 1, 302), "b": rng.normal(0.2, 2, 302)})
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "day double, id string, a double, b double").withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400))
    got = {r.variant: r for r in L.r_metrics(df, {"a": F.col("a"), "b": F.col("b")}, "ts", "id").collect()}
    for v in "ab":
        x = pdf.sort_values(["day", "id"], na_position="last")[v].to_numpy()
        c = np.cumsum(x)
        want = (302, x.mean() / x.std(), x[x > 0].sum() / -x[x < 0].sum(), (x > 0).mean(), (c - np.maximum.accumulate(c)).min())
        assert tuple(got[v])[1:] == pytest.approx(want)
    assert L.r_metrics(df.limit(0), {"a": F.col("a")}, "ts", "id").collect() == []


@pytest.mark.parametrize("together", [1, 4])
def test_walk_forward_equals_a_loop(spark, together):
    """The caller's model may be a plain value that its fit computes at once."""
    from tapeline.plans.walk_forward import walk_forward

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"window": rng.integers(0, 5, 200), "x": rng.random(200), "rr": rng.normal(0, 1, 200)})
    rows = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 0.5, 9.0)], "window long, x double, rr double"))
    run = lambda df: walk_forward(
        df, label=lambda d: d.withColumn("y", F.col("rr") > 0), fit=lambda d: d.filter("y").agg(F.avg("x")).first()[0], score=lambda m, d: d.withColumn("take", F.col("x") >= (m or 0.0)),
        evaluate=lambda d: d.agg(F.count_if("take").alias("taken"), F.sum(F.when(F.col("take"), F.col("rr"))).alias("sum_r")), together=together)
    got = {r.window: (r.taken, r.sum_r) for r in run(rows).collect()}
    for w in range(1, 5):
        train, test = pdf[pdf.window < w], pdf[pdf.window == w]
        take = test.x >= train[train.rr > 0].x.mean()
        assert got[w][0] == take.sum() and abs(got[w][1] - test[take].rr.sum()) < 1e-9
    assert set(got) == {1, 2, 3, 4}
    assert run(rows.filter("window = 0")).collect() == []


def test_equal_volumes_share_a_rank(spark):
    """The same prices on other days are added in another order."""
    prices = [0.1, 0.2, 0.3, 0.0, 0.0]
    rows = [(name, f"2024-01-{d + 1:02d}", x, 1.0) for name, xs in (("A", prices), ("B", prices[::-1]), ("C", [0.1] * 5)) for d, x in enumerate(xs)]
    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    bars = spark.createDataFrame(rows, "symbol string, day string, close double, volume double").withColumn("ts", F.to_timestamp("day"))
    got = {r.symbol: (r.usd_volume, r["rank"]) for r in B.liquidity_rank(bars, 30, 5).collect()}
    assert got == {"A": (0.6, 1), "B": (0.6, 1), "C": (0.5, 3)}


def test_repeated_bars_are_shuffled_once_in_their_own_columns(spark, tmp_path):
    """The journal has all its columns; columns the rows lack are put in after repeated bars are gone, and the export shuffles for its join only."""
    from tapeline.sources import files as S

    bars = spark.createDataFrame([("t1", 1, 0.1), ("t1", 1, 0.1), ("t1", 2, 0.3), ("t2", 1, 0.0)], "trade_id string, bar_index int, unrealized_pnl_pct double")
    S.write_journal(spark, bars, str(tmp_path / "j"), "trade_bars")
    got = S.read_journal(spark, str(tmp_path / "j"), "trade_bars")
    assert len(got.columns) == 15 and sorted((r.trade_id, r.bar_index, r.unrealized_pnl_pct, r.close) for r in got.collect()) == [("t1", 1, 0.1, None), ("t1", 2, 0.3, None), ("t2", 1, 0.0, None)]
    trades = spark.createDataFrame([("t1", "crypto", 0.2), ("t2", "forex", 0.1)], "trade_id string, asset_class string, pnl_pct double").withColumn("exit_time", F.lit("2024-01-01").cast("timestamp"))
    S.write_journal(spark, trades, str(tmp_path / "j"))
    called = []
    original = type(got).repartition
    type(got).repartition = lambda self, *a: called.append(a) or original(self, *a)
    try:
        S.export_episodes(spark, str(tmp_path / "j"), str(tmp_path / "e"))
    finally:
        type(got).repartition = original
    out = {(r.trade_id, r.bar_index): r.label_hold_better for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert out == {("t1", 1): 1, ("t1", 2): 0, ("t2", 1): 1} and not called


def test_breaker_equals_a_loop_and_shuffles_rows_once(spark, monkeypatch):
    """Hours, days and weeks that begin and end anywhere, equal times, a null key and null results; no row is stored."""
    import random
    from datetime import datetime, timezone

    rng, stored = random.Random(5), []
    times = [1_700_000_000 + rng.randrange(40 * 86_400) // 1_800 * 1_800 for _ in range(60)]
    rows = [(k, f"{i:03d}", rng.choice(times), rng.choice([-0.02, -0.01, 0.005, 0.01, None])) for k in ("a", "b", None) for i in range(300)] + [("a", "open", None, 0.5)]
    df = spark.createDataFrame(rows, "k string, trade_id string, s long, pnl_pct double").withColumn("exit_time", F.timestamp_seconds("s"))
    want = {}
    for k in ("a", "b", None):
        day = week = None
        d = w = t = peak = 0
        for _, i, s, x in sorted((r for r in rows if r[0] == k and r[2]), key=lambda r: (r[2], r[1])):
            x, at = round((x or 0) * 1000), datetime.fromtimestamp(s, timezone.utc)
            d, w, t = x + d * (at.date() == day), x + w * (at.isocalendar()[:2] == week), t + x
            day, week, peak = at.date(), at.isocalendar()[:2], max(peak, t)
            want[k, i] = (d, w, t - peak, min(max(30 + min(d, 0), 0), max(50 + min(w, 0), 0), max(80 + t - peak, 0)))
    monkeypatch.setattr(P, "materialize", lambda df: stored.append(df.columns) or df, raising=False)
    out = P.breaker_status(df, ["k"])
    got = {(r.k, r.trade_id): tuple(round(r[c] * 1000, 6) for c in ("daily", "weekly", "alltime_dd", "risk_budget")) for r in out.collect()}
    assert got == want and len(got) == 900 and not stored
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_pause_run_shuffles_rows_once(spark, monkeypatch):
    """Three limits over the same rows, also with a null key; no row is stored."""
    stored = []
    rows = [(k, f"{i:03d}", 1_700_000_000 + 600 * i, -0.004 if i % 9 < 6 else 0.003) for k in ("a", None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, trade_id string, s long, pnl_pct double").withColumn("ts", F.timestamp_seconds("s"))
    monkeypatch.setattr(P, "materialize", lambda df: stored.append(df.columns) or df, raising=False)
    out = P.pause_run(df, ["k"], -0.03, -0.05, -0.08)
    got = sorted((r.k or "", r.trade_id) for r in out.collect())
    assert [i for k, i in got if k] == [i for k, i in got if not k] and 0 < len(got) < 1200 and not stored
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in final.splitlines() if "REPARTITION_BY_COL" in x and "Reused" not in x]) == 1


def test_drawdown_simulation_in_passes(spark, monkeypatch):
    """Bands of permutations that run one after another give the result of one pass, and a pass leaves no shuffle files."""
    df = spark.createDataFrame([(i, float(i * 7 % 11) / 10 - 0.4, 0.02) for i in range(300)] + [(None, 1.0, 0.02)] * 3, "id long, rr double, risk double").repartition(3)
    whole = sorted(V.shuffled_drawdowns(df, 12, "id").collect())
    monkeypatch.setattr(V, "BAND", 5)
    monkeypatch.setattr(V, "PASS", 1)
    monkeypatch.setattr(V, "PART", 100)
    seen, keep = [], V.materialize
    monkeypatch.setattr(V, "materialize", lambda rows: (keep(rows), seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")))[0])
    cut = sorted(V.shuffled_drawdowns(df, 12, "id").collect())
    assert seen == ["false"] + ["true"] * 3 and [r.sim for r in cut] == list(range(12))
    for a, b in zip(whole, cut, strict=True):
        assert a.max_dd == pytest.approx(b.max_dd) and a.final_growth == pytest.approx(b.final_growth)
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    with shuffles_dropped(spark):
        assert keep(spark.range(1000).repartition(50, "id")).count() == 1000
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_registered_simulation_draws_the_references_permutations(spark, tmp_path):
    day = "timestamp'2024-01-01'"
    spark.range(1).selectExpr("0L as o_orderkey", "'F' as o_orderstatus", f"{day} as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).selectExpr("0L as l_orderkey", "cast(id as int) as l_linenumber", "id as l_partkey", "id as l_suppkey", "10.0D as l_quantity", "1000.0D as l_extendedprice",
                               "id % 11 / 100 as l_discount", "0.0D as l_tax", f"{day} as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    from tapeline.catalog import load

    assert load()[0]["overfit_drawdown_simulation"](spark, str(tmp_path)).first().n_simulations == 1000


def test_bars_of_a_trade_are_dealt_together_to_bounded_tasks(spark, tmp_path, monkeypatch):
    """Repeated bars are dropped, and bars joined, in tasks of a bounded number of rows; bars of a trade lie in one file, and no shuffle files stay."""
    from tapeline.sources import files as S

    monkeypatch.setattr(S, "TASK_ROWS", 60)
    bars = spark.range(200).selectExpr("concat('t', id) as trade_id", "explode(array(1, 2, 3)) as bar_index", "0.1D as unrealized_pnl_pct").repartition(3)
    trades = spark.range(200).selectExpr("concat('t', id) as trade_id", "'crypto' as asset_class", "0.2D as pnl_pct", "timestamp'2024-01-01' as exit_time")
    S.write_journal(spark, trades, str(tmp_path / "j"))
    S.write_journal(spark, bars.unionByName(bars), str(tmp_path / "j"), "trade_bars")
    files = S.read_journal(spark, str(tmp_path / "j"), "trade_bars").withColumn("f", F.input_file_name())
    assert files.count() == 600 and files.select("f").distinct().count() >= 18
    assert files.groupBy("trade_id").agg(F.countDistinct("f").alias("n")).filter("n > 1").isEmpty()
    seen, keep = [], S.shuffle_partitions
    monkeypatch.setattr(S, "shuffle_partitions", lambda spark, n: seen.append(n) or keep(spark, n))
    S.export_episodes(spark, str(tmp_path / "j"), str(tmp_path / "e"))
    assert seen == [10] and spark.read.parquet(str(tmp_path / "e")).agg(F.sum("label_hold_better")).first()[0] == 600
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
