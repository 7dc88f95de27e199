"""Scores, gates, sizing and time functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the alignment score, default and forex.
WEIGHTS = {
    "bias": 0.12, "bias_strong": 0.08, "h4": 0.08, "h4_poi": 0.08, "h1": 0.08, "h1_choch": 0.06,
    "zone": 0.15, "trigger": 0.15, "volume": 0.10,
}
FOREX_WEIGHTS = {
    "bias": 0.12, "bias_strong": 0.12, "h4": 0.12, "h4_poi": 0.08, "h1": 0.10, "h1_choch": 0.06,
    "zone": 0.08, "trigger": 0.08, "volume": 0.14,
}
# Score gate and risk per trade.
ALIGNMENT_THRESHOLD = 0.78
MIN_RISK, MAX_RISK = 0.0025, 0.010
# Fixed values: (first hour, end hour, score) by asset class, UTC.
SESSIONS = {
    "crypto": [(7, 10, 1.0), (13, 17, 1.0), (10, 13, 0.8), (17, 21, 0.7), (0, 7, 0.5), (21, 24, 0.5)],
    "forex": [(13, 17, 1.0), (7, 13, 0.9), (17, 21, 0.6), (0, 7, 0.4), (21, 24, 0.3)],
    "stocks": [(14, 16, 1.0), (16, 19, 0.8), (19, 21, 0.9)],
    "commodities": [(7, 10, 0.9), (13, 17, 1.0), (10, 13, 0.7), (17, 21, 0.6), (0, 7, 0.3), (21, 24, 0.3)],
}
# Least traded value per bar by asset class.
DOLLAR_FLOORS = {"crypto": 50_000, "forex": 100_000, "stocks": 100_000, "commodities": 50_000}


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def alignment(flags: dict[str, Column], asset_class: Column | None = None, style_weight: float = 1.0) -> Column:
    """Weighted sum of nine flags; strength and CHoCH count only with their parent.

    When none of the detailed flags is set the sum is raised by 1.3.
    """
    dependent = {
        **flags,
        "bias_strong": flags["bias"] & flags["bias_strong"],
        "h1_choch": flags["h1"] & flags["h1_choch"],
    }

    def total(weights):
        out = F.lit(0.0)
        for name, weight in weights.items():
            out = out + F.when(dependent[name], weight).otherwise(0.0)
        return out

    score = total(WEIGHTS)
    if asset_class is not None:
        score = F.when(asset_class == "forex", total(FOREX_WEIGHTS)).otherwise(score)
    detailed = flags["bias_strong"] | flags["h4"] | flags["h4_poi"] | flags["h1_choch"] | flags["volume"]
    boosted = F.when(~detailed & (score > 0), F.least(score * 1.3, F.lit(1.0))).otherwise(score)
    return F.least(boosted * style_weight, F.lit(1.0))


def step_multiplier(value: Column, bands: list[tuple[float, float]]) -> Column:
    """Multiplier of the first of the falling ``(threshold, multiplier)`` bands that the value reaches, else 1."""
    out = None
    for threshold, multiplier in bands:
        out = F.when(value >= threshold, multiplier) if out is None else out.when(value >= threshold, multiplier)
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def risk_fraction(score: Column) -> Column:
    """Linear from the minimum risk at the gate to the maximum at score 1."""
    scale = clip((score - ALIGNMENT_THRESHOLD) / (1.0 - ALIGNMENT_THRESHOLD), 0.0, 1.0)
    return F.when(score < ALIGNMENT_THRESHOLD, 0.0).otherwise(MIN_RISK + (MAX_RISK - MIN_RISK) * scale)


def risk_amount(score: Column, equity: Column, multiplier: Column | float = 1.0, cap: float = MAX_RISK) -> Column:
    factor = F.greatest(F.lit(multiplier) if isinstance(multiplier, float) else multiplier, F.lit(0.0))
    return F.when(equity <= 0, 0.0).otherwise(equity * F.least(risk_fraction(score) * factor, F.lit(cap)))


def position_size(account: float, risk_pct: float, leverage: Column, entry: Column, stop: Column) -> Column:
    """Quantity that loses ``risk_pct`` at the stop, with margin at most the account."""
    notional = account * risk_pct / (F.abs(entry - stop) / entry)
    capped = F.when(notional / leverage > account, account * leverage).otherwise(notional)
    return F.when((entry <= 0) | (stop <= 0) | (entry == stop), 0.0).otherwise(capped / entry)


def session_score(asset_class: Column, hour: Column) -> Column:
    """Quality of the trading hour; stocks outside their hours score zero."""
    out = None
    for name, spans in SESSIONS.items():
        score = None
        for start, end, value in spans:
            hit = (hour >= start) & (hour < end)
            score = F.when(hit, value) if score is None else score.when(hit, value)
        score = score.otherwise(0.0 if name == "stocks" else 0.3)
        out = F.when(asset_class == name, score) if out is None else out.when(asset_class == name, score)
    return out


def dollar_volume_ok(price: Column, volume: Column, asset_class: Column) -> Column:
    floor = F.lit(50_000.0)
    for name, value in DOLLAR_FLOORS.items():
        floor = F.when(asset_class == name, float(value)).otherwise(floor)
    return price * volume >= floor


def zone_size_score(zone_range: Column, atr: Column) -> Column:
    """Size of a zone in ATR: best at 1, falling to 0.1 outside 0.3 to 3."""
    x = zone_range / atr
    return (
        F.when((atr <= 0) | (zone_range <= 0), 0.0)
        .when(x < 0.3, 0.1)
        .when(x <= 1.0, 0.5 + 0.5 * (x - 0.3) / 0.7)
        .when(x <= 2.0, 1.0 - 0.3 * (x - 1.0))
        .when(x <= 3.0, 0.7 - 0.4 * (x - 2.0))
        .otherwise(0.1)
    )


def formation_quality(o: Column, h: Column, low: Column, c: Column) -> Column:
    """Share of the candle body in its range, in steps."""
    x = F.abs(c - o) / (h - low)
    return (
        F.when(h - low <= 0, 0.0)
        .when(x >= 0.7, 1.0)
        .when(x >= 0.5, 0.7 + 0.3 * (x - 0.5) / 0.2)
        .when(x >= 0.3, 0.4 + 0.3 * (x - 0.3) / 0.2)
        .otherwise(0.2)
    )


def zone_quality(age: Column, untouched: Column, size: Column, formation: Column, overlap: Column, decay: float = 0.15) -> Column:
    base = size * 0.35 + formation * 0.35 + F.when(overlap, 0.30).otherwise(0.0)
    quality = F.exp(-decay * F.greatest(age, F.lit(0))) * untouched * base
    return clip(F.when(overlap, F.least(quality * 1.2, F.lit(1.0))).otherwise(quality), 0.0, 1.0)


def momentum_score(up: Column, rsi: Column, hist: Column, prev: Column) -> Column:
    """Half for the oscillator in its band, half for a growing histogram."""
    band = F.when(up, (rsi >= 40) & (rsi <= 65)).otherwise((rsi >= 35) & (rsi <= 60))
    grows = F.when(up, (hist > 0) & (hist > prev)).otherwise((hist < 0) & (hist < prev))
    return F.when(band, 0.5).otherwise(0.0) + F.when(grows, 0.5).otherwise(0.0)


def trend_score(adx: Column, momentum: Column, agreement: Column, di_aligned: Column) -> Column:
    return clip(
        F.least(adx / 50.0, F.lit(1.0)) * 0.35 + momentum * 0.30 + agreement * 0.25
        + F.when(di_aligned, 0.10).otherwise(0.0), 0.0, 1.0,
    )


def volume_score(relative: Column, profile: Column, dollars_ok: Column) -> Column:
    return clip(relative * 0.45 + profile * 0.30 + F.when(dollars_ok, 0.25).otherwise(0.0), 0.0, 1.0)


def hour_cycle(ts: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.hour(ts) / 24
    return F.sin(angle), F.cos(angle)


def clean_symbol(symbol: Column) -> Column:
    """``BTC/USDT:USDT`` to ``BTCUSDT``."""
    return F.regexp_replace(F.split(symbol, ":")[0], "/", "")


def file_symbol(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "[/:]", "_")


def parameter_key(*columns: str) -> Column:
    """Content hash of a parameter row."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# Weights of the live parts beyond the nine core ones.
LIVE_EXTRA = {"adx": 0.02, "session": 0.02, "momentum": 0.02, "agreement": 0.02, "freshness": 0.02}


def live_score(flags: dict[str, Column], parts: dict[str, Column], wrong_side: Column) -> Column:
    """Graded score: core flags, zone and volume by quality, five extra parts.

    ``flags``: bias, bias_strong, h4, h4_poi, h1, h1_choch, trigger.  ``parts``
    (0..1): zone, volume, session, momentum, agreement, freshness; and ``adx``.
    A price on the wrong side of the range costs 0.10; no bias scores zero.
    """
    total = F.lit(0.0)
    for name in ("bias", "bias_strong", "h4", "h4_poi", "h1", "h1_choch", "trigger"):
        total = total + F.when(flags[name], WEIGHTS[name]).otherwise(0.0)
    total = total - F.when(wrong_side, 0.10).otherwise(0.0)
    total = total + parts["zone"] * WEIGHTS["zone"] + parts["volume"] * WEIGHTS["volume"]
    strength = F.least(F.greatest(parts["adx"] - 15.0, F.lit(0.0)) / 35.0, F.lit(1.0))
    for name, weight in LIVE_EXTRA.items():
        total = total + (strength if name == "adx" else parts[name]) * weight
    return F.when(flags["bias"], clip(total, 0.0, 1.0)).otherwise(0.0)


def hold_hours(entry: Column, exit_: Column) -> Column:
    """Hours between two times; null while a trade is open."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(exit_) - micros(entry)) / 3_600_000_000
