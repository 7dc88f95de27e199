"""Detectors against row-by-row models, level search against scans, causality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import models
from tapeline.operators import recursive as X
from tapeline.operators import structure as S
from tapeline.operators import touch as T

LENGTH = 4


def test_swings_and_breaks_equal_the_model(walk_df, walk):
    swung = S.swings(walk_df, LENGTH, size=16)
    got = swung.select("symbol", "bar_idx", "swing").toPandas().sort_values(["symbol", "bar_idx"])
    broken = S.breaks(swung, size=16).toPandas()
    for symbol, g in walk.groupby("symbol"):
        mine = got[got.symbol == symbol]["swing"].tolist()
        assert [None if v != v else v for v in mine] == models.swings(g, LENGTH)
        b = broken[broken.symbol == symbol].sort_values("bar_idx")
        assert list(b[["bar_idx", "sign", "kind", "level", "broken_idx"]].itertuples(index=False, name=None)) == models.breaks(g, LENGTH)


def test_gap_needs_the_right_candle(spark):
    rows = [("X", i, 4, *bar) for i, bar in enumerate([(10.0, 11.0, 9.0, 10.0), (10.0, 13.0, 10.0, 13.0), (13.0, 15.0, 12.0, 14.0), (14.0, 14.0, 7.0, 8.0)])]
    bars = spark.createDataFrame(rows, "symbol string, bar_idx long, n_bars long, open double, high double, low double, close double")
    gap = S.gaps(bars).filter("gap is not null").collect()
    assert [(r.bar_idx, r.gap, r.gap_top, r.gap_bottom) for r in gap] == [(2, 1, 12.0, 11.0)]
    hit = S.gap_mitigation(S.gaps(bars).filter("gap is not null"), bars).collect()
    assert hit[0].mitigated_idx == 3


def test_order_block_reach(walk_df, walk):
    swung = S.swings(walk_df, LENGTH)
    broken = S.breaks(swung)
    got = {(r.symbol, r.bar_idx, r.ob): r.confirmed_idx for r in S.order_blocks(walk_df, broken).collect()}
    want = {}
    for symbol, g in walk.groupby("symbol"):
        o, c = g["open"].to_numpy(), g["close"].to_numpy()
        for i, sign, *_ in models.breaks(g, LENGTH):
            for j in range(i - 1, max(i - 20, -1), -1):
                if (c[j] < o[j]) if sign > 0 else (c[j] > o[j]):
                    want.setdefault((symbol, j, sign), i)
                    break
    assert got == want


@pytest.fixture(scope="module")
def tree(walk_df):
    return T.extreme_tree(walk_df, fan=4)


def test_level_search_equals_a_scan(spark, walk_df, walk, tree):
    rng = np.random.default_rng(1)
    g = walk[walk.symbol == "A"]
    rows = [("A", int(i), float(g["close"].iloc[i] + d), bool(f), bool(s))
            for i, d, f, s in zip(rng.integers(0, 900, 300), rng.integers(-25, 25, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "symbol string, at long, level double, down boolean, strict boolean")
    for backward in (False, True):
        out = T.search(df, tree, "at", F.col("level"), F.col("down"), F.col("strict"), "hit", backward, fan=4).collect()
        low, high = g["low"].to_numpy(), g["high"].to_numpy()
        for r in out:
            if r.down:
                ok = low < r.level if r.strict else low <= r.level
            else:
                ok = high > r.level if r.strict else high >= r.level
            idx = np.flatnonzero(ok)
            idx = idx[idx <= r.at] if backward else idx[idx >= r.at]
            want = None if not len(idx) else int(idx[-1] if backward else idx[0])
            assert r.hit == want


def test_range_extremes_equal_a_scan(spark, walk, tree):
    rng = np.random.default_rng(2)
    g = walk[walk.symbol == "A"]
    pairs = np.sort(rng.integers(0, 900, (200, 2)), axis=1)
    df = spark.createDataFrame([("A", int(a), int(b)) for a, b in pairs], "symbol string, a long, b long")
    for r in T.range_extremes(df, tree, "a", "b", "lo", "hi", fan=4).collect():
        part = g.iloc[r.a:r.b + 1]
        assert (r.lo, r.hi) == (part["low"].min(), part["high"].max())


def test_training_adx_equals_the_model(walk_df, walk):
    got = X.adx_training(walk_df, size=64).toPandas().sort_values(["symbol", "bar_idx"])
    for symbol, g in walk.groupby("symbol"):
        np.testing.assert_allclose(got[got.symbol == symbol]["adx_training"], models.capped_adx(g), rtol=1e-9)


def test_later_bars_do_not_change_earlier_results(walk_df):
    cut = walk_df.filter("bar_idx < 50")
    for fn in (lambda d: S.breaks(S.swings(d, LENGTH)).filter("bar_idx < 50"), lambda d: X.ema(d, {"e": 20}).filter("bar_idx < 50").select("symbol", "bar_idx", F.round("e", 9))):
        assert sorted(map(tuple, fn(walk_df).collect())) == sorted(map(tuple, fn(cut).collect()))


def test_each_symbol_has_its_own_swing_length(spark, walk_df):
    lengths = {"A": 2, "B": 7, "C": 40}
    own = spark.createDataFrame(list(lengths.items()), "symbol string, swing_length int")
    got = S.swings_by_symbol(walk_df.join(own, "symbol")).select("symbol", "bar_idx", "swing", "swing_level")
    for symbol, n in lengths.items():
        want = S.swings(walk_df.filter(F.col("symbol") == symbol), n).select("symbol", "bar_idx", "swing", "swing_level")
        assert sorted(map(str, got.filter(F.col("symbol") == symbol).collect())) == sorted(map(str, want.collect()))
