"""Streaming candles: intake, bars, indicators, tracking, breaker, staleness.

State per key is small and bounded (a few numbers, open trackers, one open
trade).  Operators that depend on the order hold rows back in their state until
the watermark has passed them (``delay`` says by how much rows may be late),
then take them in event time, so that their result does not depend on how rows
were dealt to files and triggers.  Rows later than that are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeline.operators.bars import TIMEFRAMES, arrival_order
from tapeline.session import shared_dir


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Run a stream over all available input and read what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tapeline/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode(output_mode).format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], output_mode: str = "append") -> None:
    """Run a stream over all available input through ``foreachBatch``."""
    base = f"{shared_dir(stream.sparkSession)}/tapeline/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode(output_mode).foreachBatch(write).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def intake(candles: DataFrame, delay: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Drop repeated candles: rows equal in ``keys``, a symbol and time if there are none."""
    return candles.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys or ["symbol", "ts"])


def tumbling_bars(ticks: DataFrame, tf: str, delay: str = "10 minutes") -> DataFrame:
    """Bars of closed bins; a bin is emitted once the watermark passes its end."""
    seconds = TIMEFRAMES[tf]
    ordered = ticks.withWatermark("ts", delay).withColumn("_at", arrival_order(F.col("ts"), F.col("seq")))
    agg = ordered.groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", "_at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_at").alias("close"), F.sum("volume").alias("volume"),
    )
    return agg.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def heartbeat_counts(candles: DataFrame, group: str = "symbol", every: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return (
        candles.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), group).agg(F.count(F.lit(1)).alias("candles"))
        .select(group, F.col("w.start").alias("ts"), "candles")
    )


DELAY = "10 minutes"


def _arrow_bytes(frame: pd.DataFrame) -> bytes:
    """Rows in Arrow's stream format, compressed: one value of a state, however many rows, which Spark copies several times a trigger."""
    table = pa.Table.from_pandas(frame, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _ordered(rows: DataFrame, keys: list[str], ties: list[str], start: Callable[[], tuple], take: Callable, out: str, state: str, delay: str,
             silence: Callable | None = None, together: Callable | None = None) -> DataFrame:
    """Rows of each key in order of ``ts`` and ``ties``, one after another, through ``take(key, inner, row, emit)``.

    ``inner`` is the key's own state, a list of the fields of ``state``.  Rows
    the watermark has not passed wait in the state, as one Arrow block, with a
    timer at the first of them.  ``silence(inner)`` may name a further time (microseconds) for the
    timer; ``take`` is then called with no row once the watermark passes it.
    ``together(key, inner, frame)`` takes all rows that are due as one sorted frame instead of ``take``.
    """
    names = rows.columns
    # whole numbers next to nulls come as fractions, which the state would not keep
    casts = [(f.name, int if f.name == "ts" or f.dataType.typeName() in ("integer", "long") else lambda v: v) for f in rows.schema.fields]
    columns = [c.strip().split(" ")[0] for c in out.split(",")]
    inner_fields = [f.strip().split(" ", 1) for f in state.split(";")]

    def step(key, frames, group: GroupState):
        pending, inner = [], list(start())
        if group.exists:
            held, kept = group.get
            pending = [pa.ipc.open_stream(held).read_pandas()] if held else []
            inner = [x if not isinstance(x, list) else [tuple(y) if isinstance(y, tuple) else y for y in x] for x in kept]
        if not group.hasTimedOut:
            pending += [f.assign(ts=f["ts"].astype("datetime64[us]").astype("int64")) for f in frames]
        passed = group.getCurrentWatermarkMs() * 1000
        pending = [f for f in pending if len(f)]
        found: list[tuple] = []
        held, first, frame = b"", [], None
        if pending:
            waiting = pd.concat(pending, ignore_index=True)
            late = waiting["ts"] <= passed
            ready, waiting = waiting[late].sort_values(["ts", *ties], na_position="first", kind="stable"), waiting[~late]
            if together and len(ready):
                frame = together(key, inner, ready)
            for r in () if together else zip(*[[None if v is None or v != v else whole(v) for v in ready[c].tolist()] for c, whole in casts]):
                take(key, inner, dict(zip(names, r)), found.append)
            if len(waiting):
                held, first = _arrow_bytes(waiting), [int(waiting["ts"].min())]
        due = silence(inner) if silence else None
        if due is not None and due <= passed:
            take(key, inner, None, found.append)
            due = None
        group.update((held, tuple(inner)))
        waits = first + ([due] if due is not None else [])
        if waits:
            group.setTimeoutTimestamp(max(min(waits) // 1000, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=columns) if frame is None else frame

    kept = f"pending binary, inner struct<{', '.join(': '.join(f) for f in inner_fields)}>"
    marked = rows.withWatermark("ts", delay)
    return marked.groupBy(*keys).applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _share(move: float, price: float) -> float:
    """A move as a share of a price; no share of a price of zero."""
    return move / price if price else 0.0


def _summed(values: np.ndarray, group: np.ndarray, start: float) -> np.ndarray:
    """Running sums inside runs of equal ``group``, added one after another; the first run goes on from ``start``."""
    out = values.copy()
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(values)]
    out[0] += start
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        out[i:j] = np.cumsum(out[i:j])
    return out


def incremental_indicators(candles: DataFrame, period: int = 14, delay: str = DELAY) -> DataFrame:
    """EMA20/50, Wilder RSI and ATR per candle from carried state.

    Equal to the batch recursions from the first full period on.
    """
    def take(key, s, r, emit):
        n, e20, e50, gain, loss, atr, prev = s
        c = r["close"]
        tr = r["high"] - r["low"] if n == 0 else max(r["high"] - r["low"], abs(r["high"] - prev), abs(r["low"] - prev))
        up, down = (0.0, 0.0) if n == 0 else (max(c - prev, 0.0), max(prev - c, 0.0))
        e20 = c if n == 0 else e20 + 2 / 21 * (c - e20)
        e50 = c if n == 0 else e50 + 2 / 51 * (c - e50)
        atr = (atr * n + tr) / (n + 1) if n < period else (atr * (period - 1) + tr) / period
        if 1 <= n <= period:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        elif n > period:
            gain, loss = (gain * (period - 1) + up) / period, (loss * (period - 1) + down) / period
        rsi = 50.0 if n <= period else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        s[:] = n + 1, e20, e50, gain, loss, atr, c
        emit((key[0], _time(r["ts"]), n + 1, e20, e50, rsi, atr))

    return _ordered(
        candles.select("symbol", "ts", "high", "low", "close"), ["symbol"], ["close"], lambda: (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), take,
        "symbol string, ts timestamp, n long, ema20 double, ema50 double, rsi double, atr double",
        "n long; e20 double; e50 double; gain double; loss double; atr double; prev double", delay,
    )


def rolling_buffer(candles: DataFrame, size: int = 300, delay: str = DELAY) -> DataFrame:
    """Number and mean of the closes of the last ``size`` candles per symbol, for every candle."""
    def take(key, s, r, emit):
        s[0] = [*s[0], r["close"]][-size:]
        emit((key[0], _time(r["ts"]), len(s[0]), sum(s[0]) / len(s[0])))

    return _ordered(candles.select("symbol", "ts", "close"), ["symbol"], ["close"], lambda: ([],), take,
                    "symbol string, ts timestamp, held long, mean_close double", "closes array<double>", delay)


def rejection_dedup(rejections: DataFrame, bars_apart: int = 6, delay: str = DELAY) -> DataFrame:
    """One rejection per direction within six bars of the last kept one."""
    def take(key, s, r, emit):
        if s[0] < 0 or r["bar_idx"] - s[0] >= bars_apart:
            s[0] = r["bar_idx"]
            emit((r["sig_id"], key[0], int(key[1]), s[0]))

    return _ordered(rejections.select("sig_id", "symbol", "direction", "bar_idx", "ts"), ["symbol", "direction"], ["bar_idx", "sig_id"], lambda: (-1,), take,
                    "sig_id string, symbol string, direction int, bar_idx long", "last long", delay)


_FEED = ["ts", "kind", "sig_id", "symbol", "direction", "entry", "stop", "target", "high", "low", "close"]


def feed(candles: DataFrame, signals: DataFrame) -> DataFrame:
    """Candles and signals as one stream of rows, signals after their candle."""
    none = lambda t: F.lit(None).cast(t)
    c = candles.select("ts", F.lit(0).alias("kind"), none("string").alias("sig_id"), "symbol", none("int").alias("direction"),
                       *[none("double").alias(x) for x in ("entry", "stop", "target")], "high", "low", "close")
    s = signals.select("ts", F.lit(1).alias("kind"), "sig_id", "symbol", "direction", "entry", "stop", "target",
                       *[none("double").alias(x) for x in ("high", "low", "close")])
    return c.unionByName(s)


def counterfactual_tracker(rows: DataFrame, horizons: dict[str, int] | None = None, max_open: int | None = None, delay: str = DELAY) -> DataFrame:
    """Outcome of signals not taken, per horizon, as candles arrive.

    With ``max_open``, a symbol has at most that many trackers and the oldest
    is closed as timeout.
    """
    horizons = horizons or {"scalp": 72, "day": 288, "swing": 1440}
    names, limits = list(horizons), list(horizons.values())

    def take(key, s, r, emit):
        open_ = [list(t) for t in s[0]]

        def close(t, outcome, level):
            for k in range(int(t[8]), level):
                emit((t[0], key[0], names[k], outcome, t[6], t[7]))
            t[8] = level

        if r["kind"] == 1:
            if max_open is not None and len(open_) >= max_open:
                close(open_.pop(0), "timeout", len(names))
            open_.append([r["sig_id"], int(r["direction"]), float(r["entry"]), float(r["stop"]), float(r["target"]), 0, 0.0, 0.0, 0])
        else:
            alive = []
            for t in open_:
                t[5] += 1
                best, worst = (r["high"], r["low"]) if t[1] > 0 else (r["low"], r["high"])
                t[6] = max(t[6], _share((best - t[2]) * t[1], t[2]))
                t[7] = max(t[7], _share((t[2] - worst) * t[1], t[2]))
                stop, target = (worst - t[3]) * t[1] <= 0, (best - t[4]) * t[1] >= 0
                if stop or target:
                    close(t, "win" if target and not stop else "loss", len(names))
                    continue
                while t[8] < len(names) and t[5] >= limits[int(t[8])]:
                    close(t, "timeout", int(t[8]) + 1)
                if t[8] < len(names):
                    alive.append(t)
            open_ = alive
        s[0] = [tuple(t) for t in open_]

    tracker = "struct<id: string, direction: int, entry: double, stop: double, target: double, bars: int, mfe: double, mae: double, done: int>"
    return _ordered(rows.select(*_FEED), ["symbol"], ["kind", "sig_id"], lambda: ([],), take,
                    "sig_id string, symbol string, horizon string, outcome string, mfe double, mae double", f"open array<{tracker}>", delay)


def trade_lifecycle(rows: DataFrame, post_bars: int = 50, delay: str = DELAY) -> DataFrame:
    """Bars of the open trade of each symbol, then the bars after its exit.

    A signal opens a trade when none is open; stop goes before target; after
    the exit up to ``post_bars`` bars report the move that was missed.
    """
    idle = ("", 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0, -1, 0.0)

    def take(key, s, r, emit):
        if r["kind"] == 1:
            if s[9] != 0:
                s[:] = r["sig_id"], int(r["direction"]), float(r["entry"]), float(r["stop"]), float(r["target"]), 0, 0.0, 0.0, 0, 0, 0.0
            return
        if s[9] < 0:
            return
        up = s[1]
        s[5] += 1
        if s[9] == 0:  # open
            best, worst = (r["high"], r["low"]) if up > 0 else (r["low"], r["high"])
            now = _share((r["close"] - s[2]) * up, s[2])
            s[6], s[7] = max(s[6], _share((best - s[2]) * up, s[2])), max(s[7], _share((s[2] - worst) * up, s[2]))
            s[8] += int(now > 0)
            emit((s[0], key[0], "bar", s[5], now, _share(abs(r["close"] - s[3]), r["close"]), s[6], s[7], s[8] / s[5]))
            stop, target = (worst - s[3]) * up <= 0, (best - s[4]) * up >= 0
            if stop or target:
                s[9], s[10], s[5] = 1, s[3] if stop else s[4], 0
        else:
            emit((s[0], key[0], "post", s[5], _share((r["close"] - s[10]) * up, s[10]), 0.0, s[6], s[7], 0.0))
            if s[5] >= post_bars:
                s[:] = idle

    return _ordered(
        rows.select(*_FEED), ["symbol"], ["kind", "sig_id"], lambda: idle, take,
        "sig_id string, symbol string, phase string, bar_index int, move_pct double, sl_distance_pct double, mfe double, mae double, profit_share double",
        "id string; direction int; entry double; stop double; target double; bars int; mfe double; mae double; in_profit int; phase int; exit_price double", delay,
    )


def breaker_stream(closed: DataFrame, daily: float = 0.03, weekly: float = 0.05, alltime: float = 0.08, delay: str = DELAY) -> DataFrame:
    """Loss-limit flags of each account after every closed trade."""
    def together(key, s, f):
        day, move = f["ts"].to_numpy("int64") // 86_400_000_000, f["pnl_pct"].to_numpy("float64", na_value=0.0)
        week = (day + 3) // 7
        move = np.where(np.isnan(move), 0.0, move)
        d, w = _summed(move, day, s[2] if day[0] == s[0] else 0.0), _summed(move, week, s[3] if week[0] == s[1] else 0.0)
        total = _summed(move, np.zeros(len(move)), s[4])
        peak = np.maximum(np.maximum.accumulate(total), s[5])
        s[:] = int(day[-1]), int(week[-1]), float(d[-1]), float(w[-1]), float(total[-1]), float(peak[-1])
        fall = total - peak
        return pd.DataFrame({"account": key[0], "trade_id": f["trade_id"].to_numpy(), "exit_time": f["ts"].to_numpy("datetime64[us]"), "daily": d, "weekly": w, "alltime_dd": fall,
                             "day_pause": d <= -daily, "half_size": w <= -weekly, "stopped": fall <= -alltime})

    return _ordered(
        closed.select("account", "trade_id", F.col("exit_time").alias("ts"), "pnl_pct"), ["account"], ["trade_id"], lambda: (-1, -1, 0.0, 0.0, 0.0, 0.0), None,
        "account string, trade_id string, exit_time timestamp, daily double, weekly double, alltime_dd double, day_pause boolean, half_size boolean, stopped boolean",
        "day long; week long; daily double; weekly double; total double; peak double", delay, together=together,
    )


def stale_symbols(candles: DataFrame, silence_seconds: int = 420, delay: str = DELAY) -> DataFrame:
    """``symbol, last_ts``: a row whenever a symbol sent no candle for seven minutes, on the clock of the stream.

    A timer of the symbol's state fires when the watermark, which all symbols
    move, passes the limit; a symbol that went on meanwhile is found by its gap.
    """
    limit = silence_seconds * 1_000_000

    def take(key, s, r, emit):
        if r is None or (s[0] >= 0 and not s[1] and r["ts"] - s[0] > limit):
            emit((key[0], _time(s[0])))
        s[:] = (s[0], True) if r is None else (r["ts"], False)

    # one microsecond over the limit
    return _ordered(candles.select("symbol", "ts"), ["symbol"], [], lambda: (-1, False), take, "symbol string, last_ts timestamp", "last long; told boolean", delay,
                    lambda s: s[0] + limit + 1 if s[0] >= 0 and not s[1] else None)


def staleness(last_seen: DataFrame, as_of: str, group: str, limit_seconds: int = 420) -> DataFrame:
    """Share of silent symbols per class; critical above one half."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last_ts")
    g = last_seen.withColumn("_stale", age > limit_seconds).groupBy(group).agg(
        F.count_if(F.col("_stale")).alias("stale"), F.count(F.lit(1)).alias("symbols")
    )
    return g.withColumn("critical", F.col("stale") / F.col("symbols") > 0.5)
