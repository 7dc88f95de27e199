"""A stream over several files gives the batch result."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.catalog import stream_queries as Q
from tapeline.operators import outcomes as O
from tapeline.operators import recursive as X
from tapeline.streaming import candles as C


FAR = "3650 days"


def stream_of(spark, df, path, parts=4, seed=0):
    """``df`` dealt to shuffled files, opened one per trigger; the last file moves the clock on."""
    dealt = df.withColumn("_f", F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(parts))).cache()
    for k in range(parts):
        dealt.filter(F.col("_f") == k).drop("_f").orderBy(F.xxhash64(*df.columns)).coalesce(1).write.mode("append").parquet(str(path))
    later = F.lit(df.agg(F.max("ts")).first()[0]) + F.expr("interval 8000 days")
    spark.range(1).select(*[(later if c == "ts" else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns]).write.mode("append").parquet(str(path))
    return C.open_stream(spark, str(path), df.schema, max(1, parts // 5))


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_results_do_not_depend_on_files_and_triggers(spark, walk_df, tmp_path, parts):
    """Shuffled rows in 1, 7 and 150 files."""
    if parts == 150:
        rows = walk_df.filter("symbol = 'C'")
    else:
        rows = walk_df
    live = C.drain(C.incremental_indicators(stream_of(spark, rows, tmp_path / "a", parts), delay=FAR)).toPandas()
    batch = X.wilder(X.ema(rows, {"ema20": 20, "ema50": 50})).filter("bar_idx >= 14").toPandas()
    j = live.merge(batch, on=["symbol", "ts"], suffixes=("", "_b"))
    assert len(live) == rows.count() and len(j) == len(batch)
    for c in ("ema20", "ema50", "rsi", "atr"):
        np.testing.assert_allclose(j[c], j[f"{c}_b"], rtol=1e-9)


def test_silences_of_a_symbol(spark, tmp_path):
    ts = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    df = spark.createDataFrame([(k, ts(s)) for k, times in {"A": (0, 300, 600, 2000, 2100), "B": (0, 420, 840), "C": range(0, 4000, 400)}.items() for s in times], "symbol string, ts timestamp")
    want = {("A", ts(600)), ("A", ts(2100)), ("B", ts(840)), ("C", ts(3600))}
    for parts in (1, 5):
        got = C.drain(C.stale_symbols(stream_of(spark, df, tmp_path / f"s{parts}", parts), delay=FAR)).collect()
        assert sorted((r.symbol, r.last_ts) for r in got) == sorted(want)


def test_a_timer_reports_a_silent_symbol_before_it_sends_again(spark, tmp_path):
    ts = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    for rows in ([("A", ts(0)), ("B", ts(0))], [("B", ts(1000))], [("B", ts(1300))]):
        spark.createDataFrame(rows, "symbol string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got = C.drain(C.stale_symbols(C.open_stream(spark, str(tmp_path / "t"), "symbol string, ts timestamp", 1), delay="10 seconds")).collect()
    assert sorted((r.symbol, r.last_ts) for r in got) == [("A", ts(0)), ("B", ts(0))]


def test_counterfactual_tracker(spark, walk_df, tmp_path):
    sig = walk_df.filter("bar_idx % 9 = 4").selectExpr(
        "concat(symbol, '-', bar_idx) sig_id", "symbol", "ts", "bar_idx", "n_bars", "cast(if(bar_idx % 2 = 0, 1, -1) as int) direction",
        "close entry", "close - if(bar_idx % 2 = 0, 5, -5) stop", "close + if(bar_idx % 2 = 0, 7, -7) target",
    )
    hz = {"scalp": 12, "swing": 40}
    live = C.drain(C.counterfactual_tracker(stream_of(spark, C.feed(walk_df, sig), tmp_path / "b"), hz, 1000, FAR)).collect()
    got = {(r.sig_id, r.horizon): (r.outcome, round(r.mfe, 9)) for r in live}
    want = {}
    for r in O.counterfactual(sig, walk_df, hz).collect():
        for h in hz:
            if r[f"outcome_{h}"]:
                want[(r.sig_id, h)] = (r[f"outcome_{h}"], round(r[f"mfe_{h}"], 9))
    assert got == want


def test_tumbling_bars_drop_late_and_repeat(spark, walk_df, tmp_path):
    ticks = walk_df.select("symbol", "ts", F.col("bar_idx").alias("seq"), F.col("close").alias("price"), F.lit(1.0).alias("volume"))
    out = C.drain(C.tumbling_bars(stream_of(spark, ticks, tmp_path / "c"), "1h", "2 hours"))
    assert out.count() == out.select("symbol", "ts").distinct().count() > 0


def test_rejections_six_bars_apart(spark, tmp_path):
    rows = [(f"s{i}", "A", 1, i) for i in (0, 3, 5, 6, 11, 12)]
    df = spark.createDataFrame(rows, "sig_id string, symbol string, direction int, bar_idx long").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("bar_idx") * 300))
    kept = C.drain(C.rejection_dedup(stream_of(spark, df, tmp_path / "d", 3), delay=FAR))
    assert sorted(r.bar_idx for r in kept.collect()) == [0, 6, 12]


def test_oldest_tracker_is_closed_when_full(spark, tmp_path):
    bars = spark.createDataFrame([("A", i, 101.0, 99.0, 100.0) for i in range(6)], "symbol string, bar_idx long, high double, low double, close double").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("bar_idx") * 300))
    sig = spark.createDataFrame([(f"s{i}", "A", i, 1, 100.0, 50.0, 200.0) for i in range(4)],
                                "sig_id string, symbol string, bar_idx long, direction int, entry double, stop double, target double").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("bar_idx") * 300))
    out = C.drain(C.counterfactual_tracker(stream_of(spark, C.feed(bars, sig), tmp_path / "e", 2), {"swing": 100}, 2, FAR))
    assert sorted((r.sig_id, r.outcome) for r in out.collect()) == [("s0", "timeout"), ("s1", "timeout")]


def test_a_trade_stopped_at_price_zero(spark, tmp_path):
    """Its later bars have no share of the exit price."""
    at = lambda c: F.timestamp_seconds(1_700_000_000 + F.col(c) * 300)
    bars = spark.createDataFrame([("A", 0, 12.0, 0.0, 10.0), ("A", 1, 11.0, 0.0, 5.0), ("A", 2, 6.0, 4.0, 5.0)], "symbol string, i long, high double, low double, close double").withColumn("ts", at("i"))
    sig = spark.createDataFrame([("s", "A", 0, 1, 10.0, 0.0, 30.0)], "sig_id string, symbol string, i long, direction int, entry double, stop double, target double").withColumn("ts", at("i"))
    got = C.drain(C.trade_lifecycle(stream_of(spark, C.feed(bars, sig), tmp_path / "z", 2), delay=FAR)).collect()
    assert sorted((r.phase, r.bar_index, r.move_pct) for r in got) == [("bar", 1, -0.5), ("post", 1, 0.0)]


def test_a_replayed_table_is_taken_slice_by_slice(spark, walk_df, monkeypatch):
    """Shuffled rows: a trigger takes one slice, and slices follow each other in time."""
    monkeypatch.setattr(Q, "SLICE", 100)
    rows, _ = Q._stored(spark, walk_df.select("symbol", "ts", "close").orderBy(F.xxhash64("ts", "symbol")))
    seen = []
    C.drain_batches(rows, lambda batch, n: seen.append(batch.agg(F.min("ts"), F.max("ts"), F.count("symbol")).first()))
    seen = [x for x in seen if x[2]]
    assert sum(x[2] for x in seen) == walk_df.count() and max(x[2] for x in seen) <= 300
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_intake_keeps_two_prices_of_one_time(spark, tmp_path):
    """Repeats go, whatever their place in the table."""
    rows = [(i, f"2024-01-{1 + i % 9:02d} 00:00:00", "A", float(i % 2)) for i in range(36)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.withColumn("props", F.lit("")).write.parquet(str(tmp_path / "events.parquet"))
    got = [(r.symbol, str(r.ts)[:10], r.price) for r in Q.stream_candle_intake(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({(symbol, ts[:10], value) for _, ts, symbol, value in rows})


def test_breaker_takes_a_slice_at_once(spark, tmp_path):
    """Sums go on from file to file as in a loop; a result that is not known moves nothing."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"account": "a", "trade_id": [f"t{i:03d}" for i in range(400)], "exit_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 20 * 24, 400)), unit="h"),
                        "pnl_pct": rng.normal(0, 0.01, 400)})
    pdf["exit_time"] = pdf["exit_time"].astype("datetime64[us]")
    pdf.loc[7, "pnl_pct"] = None
    last = pdf.tail(1).assign(trade_id="later", exit_time=pd.Timestamp("2024-03-01"))
    schema = "account string, trade_id string, exit_time timestamp, pnl_pct double"
    for k, part in enumerate([pdf[:150], pdf[150:], last]):
        spark.createDataFrame(part, schema).selectExpr("account", "trade_id", "exit_time", "if(isnan(pnl_pct), null, pnl_pct) pnl_pct").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = C.drain(C.breaker_stream(C.open_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1), delay="40 days")).toPandas().set_index("trade_id")
    day = week = d = w = total = peak = 0
    for r in pdf.sort_values(["exit_time", "trade_id"]).itertuples():
        p, today = (0.0 if np.isnan(r.pnl_pct) else r.pnl_pct), r.exit_time.date().toordinal()
        d, w = (d if today == day else 0.0) + p, (w if (today - 1) // 7 == week else 0.0) + p
        day, week, total = today, (today - 1) // 7, total + p
        peak = max(peak, total)
        if r.trade_id in got.index:
            assert tuple(got.loc[r.trade_id, ["daily", "weekly", "alltime_dd"]]) == (d, w, total - peak)
    assert len(got) >= 150 and (got["day_pause"] == (got["daily"] <= -0.03)).all()


def test_held_rows_are_small_in_the_state():
    """Rows that wait in a state are compressed there, and come back as they were."""
    frame = pd.DataFrame({"account": "crypto", "trade_id": [f"{i // 4}-{i % 4}-{i * 7 % 20000}-{i % 1000}" for i in range(10_000)], "ts": [1_700_000_000_000_000 + i // 50 * 86_400_000_000 for i in range(10_000)],
                          "pnl_pct": [None if i % 9 == 0 else (i % 11 - 5) / 1e5 for i in range(10_000)]})
    held = C._arrow_bytes(frame)
    assert len(held) * 3 < pa.Table.from_pandas(frame, preserve_index=False).nbytes
    pd.testing.assert_frame_equal(pa.ipc.open_stream(held).read_pandas(), frame)
