"""Signals: strict mode never looks ahead; the default sees the forming bar."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.plans import signals as G

P = dict(swing_length=3, threshold=0.3)


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(11)
    n = 1500
    close = 100 + np.cumsum(rng.normal(0, 0.6, n))
    open_ = np.concatenate([[100.0], close[:-1]])
    pdf = pd.DataFrame({
        "symbol": "A", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 900, unit="s"), "open": open_,
        "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n), "close": close,
        "volume": rng.integers(1, 50, n).astype(float), "tf": "15m",
    })
    return spark.createDataFrame(pdf).cache()


def scored(base, strict):
    p = G.SignalParams(**P, strict=strict)
    t = G.structure_tables(G.series_table(base, "15m"), p)
    cols = ["ts", "bias", "h4_ok", "h4_poi", "h1_ok", "choch1h", "has_zone", "precision", "volume_ok", "dp_zone", F.round("score", 9).alias("score")]
    return {r.ts: tuple(r) for r in G.scored_bars(t, G.running_state(t, p), p, "15m").select(*cols).collect()}


def test_strict_rows_do_not_change_with_later_bars(base):
    cut = base.filter("ts < '2024-01-14 07:20:00'")  # inside a 4h and a 1d bar
    early, full = scored(cut, True), scored(base, True)
    assert len(early) > 500 and early == {k: full[k] for k in early}


def test_signal_levels_are_consistent(base):
    out = G.generate(base, G.SignalParams(**P), "15m").collect()
    assert out
    for r in out:
        side = r.direction
        assert (r.entry - r.stop) * side > 0 or r.zone_type
        assert (r.target - r.entry) * side > 0
        assert r.risk_reward >= 2.0 and r.position_size > 0


def test_teacher_tables_look_ahead_and_signal_tables_do_not(base):
    from tapeline.operators import structure as S

    p = G.SignalParams(**P)
    series = G.series_table(base, "15m")
    teacher, causal = G.structure_tables(series, p, look_ahead=True), G.structure_tables(series, p)
    marks = lambda t: sorted((r.symbol, r.bar_idx, r.swing) for r in t["swings"].filter("swing is not null").collect())
    wanted = sorted((r.symbol, r.bar_idx, r.swing) for r in S.swings_centred(series, p.swing_length).filter("swing is not null").collect())
    assert marks(teacher) == wanted != marks(causal)
    gaps = lambda t: {(r.symbol, r.bar_idx) for r in t["gaps"].collect()}
    assert {(s, i + 1) for s, i in gaps(teacher)} >= {(s, i) for s, i in gaps(causal) if (s, i - 1) in gaps(teacher)} and gaps(teacher) != gaps(causal)


def brute_targets(bars, now, entry, stop, direction, length, min_rr):
    """Nearest unused gap and order block beyond the price, straight from the definition."""
    up, need = direction > 0, stop * min_rr
    sign = 1 if up else -1
    # below the price everything is mirrored
    hi, lo, op, cl = (sign * bars[c][: now + 1] for c in ((("high", "low") if up else ("low", "high")) + ("open", "close")))
    x, n = sign * entry + need, now + 1
    gaps = [hi[z] for z in range(2, n) if hi[z] < lo[z - 2] and hi[z] > x and not (lo[z + 1 :] <= lo[z - 2]).any()]
    blocks = []
    for z in range(length, n):
        if hi[z] >= hi[z - length : z].max():
            red = [i for i in range(max(0, z - 10), z) if cl[i] < op[i]]
            if red and lo[red[-1]] > x and not (lo[red[-1] + 1 :] <= lo[red[-1]]).any():
                blocks.append(lo[red[-1]])
    return [sign * min(found) if found else None for found in (gaps, blocks)]


def test_unused_zones_equal_the_definition(spark, base):
    p = G.SignalParams(**P)
    t = G.structure_tables(G.series_table(base, "15m"), p)
    zones = G.target_tables(t, p)
    rng = np.random.default_rng(1)
    frames = {s: g.sort_values("bar_idx").reset_index(drop=True) for s, g in zones["bars"].toPandas().groupby("symbol")}
    rows = []
    for s, g in frames.items():
        for k in range(200):
            now = int(rng.integers(0, len(g)))
            rows.append((s, k, now, float(g["close"][now] + rng.normal(0, 9)), float(rng.choice([0.05, 0.5, 1.5])), int(rng.choice([-1, 1]))))
    df = spark.createDataFrame(rows, "symbol string, k int, now long, entry double, stop double, direction int")
    up = F.col("direction") > 0
    beyond = F.col("entry") + F.col("direction") * F.col("stop") * 2.0
    got = {(r.symbol, r.k): (r.gap, r.ob) for r in G.alive_zones(df, zones, "now", up, beyond, "gap", "ob").collect()}
    hits = np.zeros(2)
    for s, k, now, entry, stop, direction in rows:
        want = brute_targets({c: frames[s][c].to_numpy() for c in ("open", "high", "low", "close")}, now, entry, stop, direction, p.swing_length, 2.0)
        assert got[s, k] == tuple(want), (s, k, now, entry, direction)
        hits += [w is not None for w in want]
    assert (hits > 4).all() and len(got) == len(rows)


def test_searched_targets_equal_the_short_form_on_the_bar_that_holds_the_entry(base):
    p = G.SignalParams(**P)
    t = G.structure_tables(G.series_table(base, "15m"), p)
    rows = G.scored_bars(t, G.running_state(t, p), p, "15m")
    pick = lambda s: sorted((r.ts, round(r.target, 9), r.tp_source) for r in G.signals_from(rows, t, p, s).collect())
    assert pick(True) == pick(False) != []


def test_lengths_by_symbol(spark, base):
    """A symbol's own length gives the signals of that length; a symbol without one has the default."""
    two = base.unionByName(base.withColumn("symbol", F.lit("B"))).cache()
    own = spark.createDataFrame([("B", 5)], "symbol string, swing_length int")
    rows = lambda df: sorted((r.ts, r.direction, round(r.target, 9), round(r.score, 9)) for r in df.collect())
    mixed = G.generate(two, G.SignalParams(**P), "15m", own).cache()
    assert rows(mixed.filter("sym = 'A'")) == rows(G.generate(base, G.SignalParams(**P), "15m"))
    assert rows(mixed.filter("sym = 'B'")) == rows(G.generate(base, G.SignalParams(**{**P, "swing_length": 5}), "15m"))
