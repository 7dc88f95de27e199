"""Smoothed indicators (EMA, RSI, ATR, ADX, MACD) as linear recursions.

Every smoother here is ``y[i] = a*y[i-1] + u[i]`` for a suitable input ``u``;
the start value is an input on the seed bar.  See ``blocks.recursion``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.operators.bars import KEYS, true_range
from tapeline.operators.blocks import RECURSION_BLOCK, framed, halo, recursion
from tapeline.session import materialize

_I = "bar_idx"


def ema_input(x: Column, span: int) -> tuple[Column, float]:
    alpha = 2.0 / (span + 1)
    return F.when(F.col(_I) == 0, x).otherwise(alpha * x), 1.0 - alpha


def ema(bars: DataFrame, spans: dict[str, int], value: str = "close", size: int = RECURSION_BLOCK) -> DataFrame:
    """Exponential averages seeded with the first value."""
    return recursion(bars, KEYS, {o: ema_input(F.col(value), s) for o, s in spans.items()}, size=size)


def ema_bias_corrected(bars: DataFrame, spans: dict[str, int], value: str = "close") -> DataFrame:
    """Exponential averages with weights that sum to one from the first bar."""
    solved = recursion(bars, KEYS, {o: (F.col(value), 1 - 2.0 / (s + 1)) for o, s in spans.items()})
    scale = {}
    for out, span in spans.items():
        a = 1 - 2.0 / (span + 1)
        scale[out] = F.col(out) * (1 - a) / (1 - F.pow(F.lit(a), F.col(_I) + 1))
    return solved.withColumns(scale)


def _seeded(x: Column, seed: Column, at: int, keep: float, weight: float) -> tuple[Column, float]:
    return F.when(F.col(_I) == at, seed).when(F.col(_I) > at, weight * x).otherwise(0.0), keep


def _moves(w) -> dict[str, Column]:
    d = F.col("close") - F.lag("close").over(w)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    return {
        "_gain": F.when(d > 0, d).otherwise(0.0),
        "_loss": F.when(d < 0, -d).otherwise(0.0),
        "_tr": true_range(w),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
    }


def _moves_with_means(bars: DataFrame, period: int) -> DataFrame:
    """Per-bar moves, and their means over the last ``period`` rows (the seeds)."""

    def build(w):
        frame = w.rowsBetween(1 - period, 0)
        return {f"{c}0": F.avg(c).over(frame) for c in ("_gain", "_loss", "_tr", "_pdm", "_mdm")}

    # the means are taken over moves, which need one more row: both in one halo
    window = Window.partitionBy(*KEYS, "_blk").orderBy(_I)
    spread = halo(bars, before=period + 1)
    moved = spread.withColumns(_moves(window)).withColumns(build(window))
    return moved.filter("_core").drop("_blk", "_core")


def smoothed(bars: DataFrame, spans: dict[str, int], period: int = 14, size: int = RECURSION_BLOCK) -> DataFrame:
    """EMAs of the close with ``rsi`` (50 until enough bars) and ``atr`` (head filled
    backwards), all solved in one recursion pass."""
    keep, weight = (period - 1) / period, 1 / period
    rows = materialize(_moves_with_means(bars, period))
    solved = recursion(
        rows,
        KEYS,
        {
            "_ag": _seeded(F.col("_gain"), F.col("_gain0"), period, keep, weight),
            "_al": _seeded(F.col("_loss"), F.col("_loss0"), period, keep, weight),
            "_atr": _seeded(F.col("_tr"), F.col("_tr0"), period - 1, keep, weight),
            **{o: ema_input(F.col("close"), s) for o, s in spans.items()},
        },
        size=size,
    )
    rs = F.col("_ag") / F.col("_al")
    rsi = F.when(F.col(_I) <= period, 50.0).when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + rs))
    head = Window.partitionBy("symbol", "_head")
    short = F.col("n_bars") <= period
    return (
        solved.withColumn("_head", F.floor(F.col(_I) / max(period, 256)))
        .withColumn("_seed", F.max(F.when(F.col(_I) == period - 1, F.col("_atr"))).over(head))
        .withColumn("_mean", F.avg("_tr").over(head))
        .withColumns(
            {
                "rsi": rsi,
                "atr": F.when(F.col("n_bars") < 2, 0.0)
                .when(short, F.col("_mean"))
                .when(F.col(_I) < period - 1, F.col("_seed"))
                .otherwise(F.col("_atr")),
            }
        )
        .select(*bars.columns, "rsi", "atr", *spans)
    )


def wilder(bars: DataFrame, period: int = 14, size: int = RECURSION_BLOCK) -> DataFrame:
    """Add ``rsi`` and ``atr``."""
    return smoothed(bars, {}, period, size)


def simple_rsi(bars: DataFrame, period: int = 14, out: str = "rsi_simple") -> DataFrame:
    """RSI from the plain means of the last ``period`` changes."""

    def build(w):
        frame = w.rowsBetween(1 - period, 0)
        gain, loss = F.avg("_gain").over(frame), F.avg("_loss").over(frame)
        return {
            out: F.when(F.col(_I) < period, 50.0)
            .when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0))
            .otherwise(100 - 100 / (1 + gain / loss))
        }

    moved = framed(bars, KEYS, _moves, before=1)
    return framed(moved, KEYS, build, before=period).select(*bars.columns, out)


def simple_atr(bars: DataFrame, period: int = 14, out: str = "atr_simple") -> DataFrame:
    """Mean true range of the last ``period`` bars that have a previous close."""

    def build(w):
        frame = w.rowsBetween(1 - period, 0)
        moves = F.when(F.col(_I) > 0, F.col("_tr"))
        return {out: F.avg(moves).over(frame)}

    moved = framed(bars, KEYS, lambda w: {"_tr": true_range(w)}, before=1)
    return framed(moved, KEYS, build, before=period).select(*bars.columns, out)


def adx(bars: DataFrame, period: int = 14, size: int = RECURSION_BLOCK) -> DataFrame:
    """ADX, +DI and -DI at every bar, as if the series ended there.

    Range and moves start as means of the first ``period`` values and continue
    as sums (``s - s/period + x``); the directional index of the later bars is
    then averaged the same way as RSI.  Zero until 2*period values exist.
    """
    keep = 1 - 1 / period
    rows = materialize(_moves_with_means(bars, period))
    first = recursion(
        rows,
        KEYS,
        {
            "_a": _seeded(F.col("_tr"), F.col("_tr0"), period, keep, 1.0),
            "_p": _seeded(F.col("_pdm"), F.col("_pdm0"), period, keep, 1.0),
            "_m": _seeded(F.col("_mdm"), F.col("_mdm0"), period, keep, 1.0),
        },
        size=size,
    )
    pdi = F.when(F.col("_a") > 0, 100 * F.col("_p") / F.col("_a")).otherwise(0.0)
    mdi = F.when(F.col("_a") > 0, 100 * F.col("_m") / F.col("_a")).otherwise(0.0)
    dx = F.when(
        F.col("_pdi") + F.col("_mdi") > 0,
        100 * F.abs(F.col("_pdi") - F.col("_mdi")) / (F.col("_pdi") + F.col("_mdi")),
    ).otherwise(0.0)
    indexed = first.withColumns({"_pdi": pdi, "_mdi": mdi}).withColumn("_dx", dx)
    seeded = framed(indexed, KEYS, lambda w: {"_dx0": F.avg("_dx").over(w.rowsBetween(1 - period, 0))}, before=period)
    second = recursion(
        materialize(seeded),
        KEYS,
        {"_adx": _seeded(F.col("_dx"), F.col("_dx0"), 2 * period, (period - 1) / period, 1 / period)},
        size=size,
    )
    ready = F.col(_I) >= 2 * period
    clip = lambda c: F.when(ready, F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)
    return second.select(
        *bars.columns,
        clip(F.col("_adx")).alias("adx"),
        clip(F.col("_pdi")).alias("plus_di"),
        clip(F.col("_mdi")).alias("minus_di"),
    )


def macd(bars: DataFrame, size: int = RECURSION_BLOCK) -> DataFrame:
    """MACD histogram (12/26/9) of the bar and of the one before; 0 below 35 bars."""
    fast_slow = ema(bars, {"_e12": 12, "_e26": 26}, size=size).withColumn("_line", F.col("_e12") - F.col("_e26"))
    signal = recursion(materialize(fast_slow), KEYS, {"_sig": ema_input(F.col("_line"), 9)}, size=size)
    hist = signal.withColumn("_hist", F.col("_line") - F.col("_sig"))
    lagged = framed(hist, KEYS, lambda w: {"_prev": F.lag("_hist").over(w)}, before=1)
    enough = F.col(_I) >= 34
    return lagged.select(
        *bars.columns,
        F.when(enough, F.col("_hist")).otherwise(0.0).alias("macd_hist"),
        F.when(enough, F.col("_prev")).otherwise(0.0).alias("macd_prev"),
    )


# ---- training form of ADX ---------------------------------------------------
#
# DI[i] = min((DI[i-1]*(p-1) + DM[i]) / p / ATR[i] * 100, 100), zero without ATR.
# Every step is x -> min(A*x + B, C) with A >= 0, and so is any chain of steps:
# a block is summarised by its (A, B, C), the blocks are walked once, and each
# block is then solved from its own start value.


def _di_steps(pdf: pd.DataFrame, period: int, dm: str):
    i, atr, move = pdf["bar_idx"].to_numpy(), pdf["atr"].to_numpy(), pdf[dm].to_numpy()
    live = (atr > 0) & (i > period)
    a = np.where(live, (period - 1) / period / np.where(atr > 0, atr, 1.0) * 100, 0.0)
    b = np.where(live, move / period / np.where(atr > 0, atr, 1.0) * 100, 0.0)
    seed = (i == period) & (atr > 0)
    b = np.where(seed, pdf[f"{dm}0"].to_numpy() / np.where(atr > 0, atr, 1.0) * 100, b)
    c = np.where(live, 100.0, np.where(seed, np.inf, 0.0))
    return a, b, c


def adx_training(bars: DataFrame, period: int = 14, size: int = 4096) -> DataFrame:
    """ADX as the training features use it: 25 until ``2*period`` bars exist."""
    rows = _moves_with_means(wilder(bars, period), period).withColumn("_b", F.floor(F.col(_I) / size).cast("long"))
    slim = materialize(rows.select("symbol", "_b", _I, "atr", "_pdm", "_mdm", "_pdm0", "_mdm0"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        out = {"symbol": pdf["symbol"].iloc[0], "_b": pdf["_b"].iloc[0]}
        for tag in ("_pdm", "_mdm"):
            total = (1.0, 0.0, np.inf)
            for a, b, c in zip(*_di_steps(pdf, period, tag)):
                total = (a * total[0], a * total[1] + b, min(a * total[2] + b if a else np.inf, c))
            out.update({f"{tag}{n}": v for n, v in zip("abc", total)})
        return pd.DataFrame([out])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        for tag in ("_pdm", "_mdm"):
            x, start = 0.0, []
            for a, b, c in zip(pdf[f"{tag}a"], pdf[f"{tag}b"], pdf[f"{tag}c"]):
                start.append(x)
                x = min(a * x + b, c)
            pdf[f"{tag}_in"] = start
        return pdf[["symbol", "_b", "_pdm_in", "_mdm_in"]]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        for tag, out in (("_pdm", "pdi"), ("_mdm", "mdi")):
            x, got = float(pdf[f"{tag}_in"].iloc[0]), []
            for a, b, c in zip(*_di_steps(pdf, period, tag)):
                x = min(a * x + b, c)
                got.append(x)
            pdf[out] = got
        return pdf[["symbol", "bar_idx", "pdi", "mdi"]]

    sums = ", ".join(f"{t}{n} double" for t in ("_pdm", "_mdm") for n in "abc")
    folded = slim.groupBy("symbol", "_b").applyInPandas(fold, f"symbol string, _b long, {sums}")
    starts = folded.groupBy("symbol").applyInPandas(walk, "symbol string, _b long, _pdm_in double, _mdm_in double")
    solved = slim.join(starts, ["symbol", "_b"]).groupBy("symbol", "_b").applyInPandas(
        solve, "symbol string, bar_idx long, pdi double, mdi double"
    )
    total = F.col("pdi") + F.col("mdi")
    dx = F.when((F.col(_I) >= period) & (total > 0), F.abs(F.col("pdi") - F.col("mdi")) / total * 100).otherwise(0.0)
    j = bars.join(solved, ["symbol", _I]).withColumn("_dx", dx)
    seeded = framed(j, KEYS, lambda w: {"_dx0": F.avg("_dx").over(w.rowsBetween(-period, 0))}, before=period)
    smooth = recursion(
        materialize(seeded), KEYS, {"_adx": _seeded(F.col("_dx"), F.col("_dx0"), 2 * period, (period - 1) / period, 1 / period)}
    )
    ready = (F.col("n_bars") >= 2 * period + 1) & (F.col(_I) >= 2 * period)
    return smooth.select(*bars.columns, F.when(ready, F.col("_adx")).otherwise(25.0).alias("adx_training"))
