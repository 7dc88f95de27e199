"""Block-wise computations equal a whole-series pass, also across block edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import blocks as B
from tapeline.operators.greedy import greedy_keep

KEYS = ["symbol"]


def by_symbol(df, column):
    pdf = df.select("symbol", "bar_idx", column).toPandas().sort_values(["symbol", "bar_idx"])
    return pdf[column].to_numpy(dtype=float)


def test_numbering_matches_time_order(walk_df, walk):
    out = B.number_rows(walk_df.drop("bar_idx", "n_bars"), KEYS, "ts", 3600)
    got = out.toPandas().sort_values(["symbol", "ts"])
    assert got["bar_idx"].tolist() == walk.sort_values(["symbol", "ts"])["bar_idx"].tolist()
    assert got.groupby("symbol")["n_bars"].first().to_dict() == {"A": 900, "B": 200, "C": 60}


def test_running_values(walk_df, walk):
    odd = F.when(F.col("bar_idx") % 7 == 3, F.col("close"))
    out = B.running(
        walk_df, KEYS,
        {"s": ("sum", F.col("close")), "m": ("max", F.col("close")), "l": ("last", odd), "p": ("last", odd, False)}, size=16,
    ).cache()
    g = walk.groupby("symbol")
    odd_pd = walk["close"].where(walk["bar_idx"] % 7 == 3)
    np.testing.assert_allclose(by_symbol(out, "s"), g["close"].cumsum())
    np.testing.assert_allclose(by_symbol(out, "m"), g["close"].cummax())
    last = odd_pd.groupby(walk["symbol"]).ffill()
    np.testing.assert_allclose(by_symbol(out, "l"), last)
    np.testing.assert_allclose(by_symbol(out, "p"), last.groupby(walk["symbol"]).shift())


@pytest.mark.parametrize("size", [8, 64])
def test_recursion_is_exact(walk_df, walk, size):
    a = 1 - 2 / 201
    u = F.when(F.col("bar_idx") == 0, F.col("close")).otherwise((1 - a) * F.col("close"))
    out = B.recursion(walk_df, KEYS, {"y": (u, a)}, size=size)
    want = walk.groupby("symbol")["close"].transform(lambda s: s.ewm(span=200, adjust=False).mean())
    np.testing.assert_allclose(by_symbol(out, "y"), want, rtol=1e-12)


def test_bounded_frames_cross_block_edges(walk_df, walk):
    out = B.framed(walk_df, KEYS, lambda w: {"x": F.avg("close").over(w.rowsBetween(-9, 0)), "n": F.lead("close", 3).over(w)}, 9, 3, size=16)
    out = out.cache()
    g = walk.groupby("symbol")["close"]
    np.testing.assert_allclose(by_symbol(out, "x"), g.transform(lambda s: s.rolling(10, 1).mean()))
    np.testing.assert_allclose(by_symbol(out, "n"), g.shift(-3))
    with pytest.raises(ValueError):
        B.halo(walk_df, before=20, size=16)


def test_curve_peaks_and_falls(walk_df, walk):
    moved = walk_df.withColumn("v", F.col("close") - F.col("open"))
    out = B.curve(moved, KEYS, "v", ["bar_idx"], F.floor(F.col("bar_idx") / 10).cast("long"), 50.0).cache()
    v = walk["close"] - walk["open"]
    equity = 50 + v.groupby(walk["symbol"]).cumsum()
    np.testing.assert_allclose(by_symbol(out, "equity"), equity)
    peak = np.maximum(equity.groupby(walk["symbol"]).cummax(), 50)
    np.testing.assert_allclose(by_symbol(out, "drawdown"), peak - equity)


def test_greedy_gap_fixture(spark):
    """Rows at 0, 20, 40, 60 minutes keep 0 and 40: 40 is 40 minutes from the last kept."""
    rows = spark.createDataFrame([("X", i, m * 60) for i, m in enumerate((0, 20, 40, 60))], "symbol string, id long, start long")
    kept = greedy_keep(rows.withColumn("until", F.col("start") + 1800), KEYS, "start", "until", "id", 1500)
    assert sorted(r.start // 60 for r in kept.collect()) == [0, 40]


def test_greedy_with_varying_holds_equals_sequential(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": rng.choice(["A", "A", "A", "B"], 1500), "start": np.sort(rng.integers(0, 40_000, 1500))})
    pdf["until"], pdf["id"] = pdf["start"] + rng.integers(0, 400, 1500), np.arange(1500)
    want = []
    for _, g in pdf.groupby("symbol"):
        busy = -1
        for r in g.sort_values(["start", "id"]).itertuples():
            if r.start >= busy:
                want.append(r.id)
                busy = r.until
    kept = greedy_keep(spark.createDataFrame(pdf), KEYS, "start", "until", "id", 1000)
    assert sorted(r.id for r in kept.collect()) == sorted(want)


def test_greedy_on_many_levels_equals_sequential(spark, monkeypatch):
    """Few rows a chunk and few chunks a node: one symbol has a third of the rows, many share one start."""
    from tapeline.operators import greedy

    rng = np.random.default_rng(4)
    symbol = np.where(np.arange(3000) % 3 == 0, "HOT", np.char.add("S", (np.arange(3000) % 40).astype(str)))
    pdf = pd.DataFrame({"symbol": symbol, "start": np.sort(rng.integers(-90_000, 90_000, 3000))})
    pdf.loc[pdf.index % 10 == 0, "start"] = 500
    pdf["until"], pdf["id"] = pdf["start"] + rng.choice([0, 5, 600, 30_000], 3000, p=[0.1, 0.6, 0.29, 0.01]), np.arange(3000)
    want = []
    for _, g in pdf.groupby("symbol"):
        busy = -(10**9)
        for r in g.sort_values(["start", "id"]).itertuples():
            if r.start >= busy:
                want.append(r.id)
                busy = r.until
    for name, value in (("ROWS", 40), ("FAN", 3), ("GROUP", 16)):
        monkeypatch.setattr(greedy, name, value)
    kept = greedy.greedy_keep(spark.createDataFrame(pdf), KEYS, "start", "until", "id", 20_000)
    assert sorted(r.id for r in kept.collect()) == sorted(want)


def test_greedy_steps_compose():
    from tapeline.operators import greedy

    rng = np.random.default_rng(5)
    parts = []
    for c in range(6):
        start = np.sort(rng.integers(100 * c, 100 * (c + 1), 20))
        parts.append(greedy.chunk_summary(start, start + rng.integers(0, 150, 20)))
    upper, end = greedy.composed(*map(list, zip(*parts)))
    for blocked in [-1, *range(0, 760, 3)]:
        entry = greedy.walk([*(u for u, _ in parts), np.zeros(0, np.int64)], [*(e for _, e in parts), np.zeros(0, np.int64)], blocked)
        k = np.searchsorted(upper, blocked, side="left")
        assert entry[-1] == (end[k] if k < len(upper) else blocked)


def test_greedy_of_nothing(spark):
    rows = spark.createDataFrame([], "symbol string, id long, start long, until long")
    assert greedy_keep(rows, KEYS, "start", "until", "id", 100).collect() == []
