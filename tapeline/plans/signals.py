"""Signal generation over five timeframes, from one table of bars.

All timeframes live in one tall table whose series key is ``symbol|tf``; each
structure operator runs once over it.  Coarser bars are derived from the
decision bars, so the latest coarse bar at a decision bar is the one whose bin
contains it: attaching timeframes is an equi join, not a range join.
``strict`` attaches the previous, closed bar instead of the one still forming.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import scores
from tapeline.operators import structure as S
from tapeline.operators.bars import KEYS, TIMEFRAMES, all_timeframes, bucket_start, numbered
from tapeline.operators.blocks import framed
from tapeline.operators.recursive import ema
from tapeline.operators.touch import extreme_tree, search
from tapeline.session import materialize

HTF = ["15m", "1h", "4h", "1d"]


@dataclass(frozen=True)
class SignalParams:
    swing_length: int = 8
    gap_threshold: float = 0.0004
    liq_range: float = 0.005
    threshold: float = 0.78
    zone_bars: int = 6
    trigger_bars: int = 1
    poi_bars: int = 6
    min_stop_pct: float = 0.0035
    min_rr: float = 2.0
    account: float = 100_000.0
    risk_pct: float = 0.005
    leverage: int = 10
    strict: bool = False


def series_table(base: DataFrame, decision_tf: str = "5m", lengths: DataFrame | None = None, default: int = SignalParams.swing_length) -> DataFrame:
    """Numbered bars of the decision timeframe and all coarser ones.

    ``lengths`` (``symbol, swing_length``) gives symbols their own detector
    length, which then travels with the bars; others take ``default``.
    """
    wanted = [t for t in HTF if TIMEFRAMES[t] > TIMEFRAMES[decision_tf]]
    tall = all_timeframes(base, decision_tf, wanted).withColumn("sym", F.col("symbol"))
    if lengths is not None:
        own = lengths.select(F.col("symbol").alias("sym"), F.col("swing_length").cast("int").alias("swing_length"))
        tall = tall.join(own, "sym", "left").fillna({"swing_length": default})
    return materialize(numbered(tall.withColumn("symbol", F.concat_ws("|", "symbol", "tf"))))


def swing_length(df: DataFrame, p: SignalParams) -> Column:
    """The detector length of each row."""
    return F.col("swing_length") if "swing_length" in df.columns else F.lit(p.swing_length)


def marked_swings(bars: DataFrame, p: SignalParams) -> DataFrame:
    return S.swing_marks(bars, "swing_length" if "swing_length" in bars.columns else p.swing_length)


def structure_tables(bars: DataFrame, p: SignalParams, look_ahead: bool = False) -> dict[str, DataFrame]:
    """Swings, breaks, gaps and order blocks of every series.

    ``look_ahead`` takes the detectors that see later bars; they are for labels
    only.
    """
    own = "swing_length" in bars.columns
    if own and look_ahead:
        raise ValueError("detectors that look ahead take one length")
    find = S.swings_centred if look_ahead else S.swings
    swung = materialize(S.swings_by_symbol(bars) if own else find(bars, p.swing_length))
    enough = F.col("n_bars") >= 2 * swing_length(bars, p)
    broken = materialize(S.breaks(swung.filter(enough)))
    return {
        "bars": bars,
        "swings": swung,
        "breaks": broken,
        "gaps": materialize((S.gaps_centred if look_ahead else S.gaps)(bars).filter(enough & F.col("gap").isNotNull())),
        "blocks": materialize(S.order_blocks(bars, broken)),
    }


def zone_events(t: dict[str, DataFrame]) -> DataFrame:
    """Gaps and order blocks as one table of zones; ``known`` is the bar that shows them."""
    gaps = t["gaps"].select("symbol", "bar_idx", F.lit("fvg").alias("type"), F.col("gap").alias("sign"),
                            F.col("gap_top").alias("top"), F.col("gap_bottom").alias("bottom"), F.col("bar_idx").alias("known"))
    blocks = t["blocks"].select("symbol", "bar_idx", F.lit("ob").alias("type"), F.col("ob").alias("sign"),
                                F.col("ob_top").alias("top"), F.col("ob_bottom").alias("bottom"), F.col("confirmed_idx").alias("known"))
    return gaps.unionByName(blocks)


def running_state(t: dict[str, DataFrame], p: SignalParams) -> DataFrame:
    """Per bar of every series: structure, daily bias, zone flags, swing midpoint."""
    state = S.running_structure(t["bars"], t["breaks"])
    mid = S.premium_discount(t["swings"]).select("symbol", "bar_idx", "midpoint")
    events = zone_events(t)
    if p.strict:  # a zone counts from the bar that shows it, for what is left of its span
        events = events.withColumn("at", F.explode(F.sequence("bar_idx", F.col("bar_idx") + (p.poi_bars - 1))))
        events = events.filter("at >= known").withColumn("bar_idx", F.col("at"))
    zones = events.groupBy("symbol", "bar_idx").agg(
        F.max((F.col("sign") > 0).cast("int")).alias("_up"), F.max((F.col("sign") < 0).cast("int")).alias("_dn")
    )
    daily = ema(t["bars"].filter("tf = '1d' and n_bars >= 200"), {"_ema": 200}).select("symbol", "bar_idx", "_ema")
    rows = (
        state.join(mid, ["symbol", "bar_idx"], "left")
        .join(zones, ["symbol", "bar_idx"], "left")
        .join(daily, ["symbol", "bar_idx"], "left")
    )
    flags = {
        "poi_up": F.coalesce("_up", F.lit(0)) == 1,
        "poi_dn": F.coalesce("_dn", F.lit(0)) == 1,
    }
    rows = rows.withColumns(flags) if p.strict else S.recent_flag(rows, flags, p.poi_bars - 1)
    fallback = F.when(F.col("_ema").isNull(), 0).when(F.col("close") > F.col("_ema"), 1).otherwise(-1)
    bias = F.when(F.col("structure") != 0, F.col("structure")).otherwise(fallback)
    return rows.withColumn("bias", bias).drop("_up", "_dn", "_ema")


def entry_zones(t: dict[str, DataFrame], tf: str, p: SignalParams) -> DataFrame:
    """Best entry zone per bar and direction: newest gap, else newest order block.

    A zone is offered to the next ``zone_bars`` bars only; the price must be at
    least 30 % into it.
    """
    zones = zone_events(t).filter(F.col("symbol").endswith(f"|{tf}"))
    offered = zones.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(p.zone_bars - 1)))).withColumn(
        "at", F.col("bar_idx") + F.col("age")
    )
    if p.strict:
        offered = offered.filter("at >= known")
    price = t["bars"].select("symbol", F.col("bar_idx").alias("at"), F.col("close").alias("price"))
    height = F.abs(F.col("top") - F.col("bottom"))
    depth = F.when(F.col("sign") > 0, F.col("price") - F.col("bottom")).otherwise(F.col("top") - F.col("price")) / height
    big = (F.col("type") == "ob") | (height / F.col("price") >= p.gap_threshold)
    fits = offered.join(price, ["symbol", "at"]).filter((height > 0) & (F.col("price") > 0) & big & (depth >= 0.30))
    rank = F.when(F.col("type") == "fvg", 1_000).otherwise(0) - F.col("age")
    return fits.groupBy("symbol", F.col("at").alias("bar_idx"), "sign").agg(
        F.max_by("type", rank).alias("zone_type"),
        F.max_by("top", rank).alias("zone_top"),
        F.max_by("bottom", rank).alias("zone_bottom"),
    )


def volume_confirms(w, back: int = 20, ratio: float = 1.2) -> Column:
    """Volume above the mean of up to 20 earlier bars; needs five bars."""
    past = F.avg("volume").over(w.rowsBetween(-back, -1))
    return F.coalesce((F.col("bar_idx") >= 4) & (past > 0) & (F.col("volume") >= past * ratio), F.lit(False))


def attach(rows: DataFrame, state: DataFrame, tf: str, columns: dict[str, str], p: SignalParams, how: str = "left") -> DataFrame:
    """Columns of the coarse bar that contains (strict: precedes) each row."""
    side = state.filter(F.col("tf") == tf)
    key = F.col("ts")
    if p.strict:
        nxt = framed(side, KEYS, lambda w: {"_next": F.lead("ts").over(w)}, after=1)
        side, key = nxt.filter("_next is not null"), F.col("_next")
    side = side.select(
        "sym",
        key.alias("_bin"),
        *[F.col(c).alias(o) for c, o in columns.items()],
    )
    binned = rows.withColumn("_bin", bucket_start(F.col("ts"), TIMEFRAMES[tf]))
    return binned.join(side, ["sym", "_bin"], how).drop("_bin")


def target_tables(t: dict[str, DataFrame], p: SignalParams) -> dict[str, DataFrame]:
    """Gaps and opposite candles that can be targets, with the first bar that uses each up, on the timeframes searched.

    ``side`` 1: above the price, for longs.  A gap is used up when a later bar trades to its far side, a candle (the
    last opposite one of ten bars before a swing) when a later bar trades to its near side.
    """
    bars = materialize(t["bars"].filter(F.col("tf").isin("4h", "1h")))

    def build(w):
        ten, body = w.rowsBetween(-10, -1), F.col("close") - F.col("open")
        return {
            "h2": F.lag("high", 2).over(w), "l2": F.lag("low", 2).over(w),
            "red": F.max(F.when(body < 0, F.col("bar_idx"))).over(ten), "green": F.max(F.when(body > 0, F.col("bar_idx"))).over(ten),
        }

    marked = materialize(framed(marked_swings(bars, p), KEYS, build, before=10).select("symbol", "bar_idx", "high", "low", "top", "bottom", "h2", "l2", "red", "green"))
    zone = lambda side, at, level: F.struct(F.lit(side).alias("side"), F.col(at).alias("at"), F.col(level).alias("level"))
    gaps = marked.select("symbol", "bar_idx", F.explode(F.array_compact(F.array(
        F.when(F.col("high") < F.col("l2"), zone(1, "bar_idx", "l2")), F.when(F.col("low") > F.col("h2"), zone(-1, "bar_idx", "h2"))))).alias("z"))
    named = marked.select("symbol", "bar_idx", F.explode(F.array_compact(F.array(
        F.when(F.col("top") & F.col("red").isNotNull(), F.struct(F.lit(1).alias("side"), F.col("red").alias("at"))),
        F.when(F.col("bottom") & F.col("green").isNotNull(), F.struct(F.lit(-1).alias("side"), F.col("green").alias("at")))))).alias("z"))
    own = bars.select("symbol", F.col("bar_idx").alias("at"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    blocks = named.select("symbol", "bar_idx", "z.*").join(own, ["symbol", "at"]).withColumn("level", F.when(F.col("side") > 0, F.col("_l")).otherwise(F.col("_h")))
    tree = extreme_tree(bars)

    def used_up(zones: DataFrame) -> DataFrame:
        after = zones.withColumn("_next", F.col("at") + 1)
        return materialize(search(after, tree, "_next", F.col("level"), F.col("side") > 0, False, "end").select("symbol", "bar_idx", "side", "at", "end"))

    return {"bars": bars, "tree": tree, "gaps": used_up(gaps.select("symbol", "bar_idx", "z.*")), "blocks": used_up(blocks.select("symbol", "bar_idx", "side", "at", "level"))}


def _pair_tree(bars: DataFrame, zones: DataFrame, value: Column):
    """A tree whose high side holds a number of the zones above, and whose low side minus that of the zones below."""
    side = lambda k: F.max(F.when(F.col("side") == k, value))
    found = zones.groupBy("symbol", "bar_idx").agg(side(1).alias("_up"), side(-1).alias("_dn"))
    rows = bars.select("symbol", "bar_idx").join(found, ["symbol", "bar_idx"], "left")
    return extreme_tree(rows.select("symbol", "bar_idx", F.coalesce("_up", F.lit(-1e300)).alias("high"), F.coalesce(-F.col("_dn"), F.lit(1e300)).alias("low")))


def alive_zones(rows: DataFrame, zones: dict[str, DataFrame], now: str, up: Column, beyond: Column, gap: str, block: str) -> DataFrame:
    """Add the prices of the nearest unused gap and order block beyond a price, as of bar ``now`` of series ``symbol``.

    Of zones above that are still unused, a later one lies higher: every bar after a zone stays over it.  m, the last
    bar that traded to the price ``beyond``, has used up all zones before it that lie farther; so the nearest zone is
    the first one from m on whose end lies after ``now``.  That is a search on a tree of zone ends, whatever the number
    of zones.  Blocks are found at the swing that names them; the candles of later swings are never earlier, so the
    search starts at the first swing whose candle lies after m.  Below the price all signs turn.
    """
    bars = zones["bars"]
    far = F.lit(1e300)
    ends = _pair_tree(bars, zones["gaps"], F.coalesce(F.col("end").cast("double"), far))
    block_ends = _pair_tree(bars, zones["blocks"], F.coalesce(F.col("end").cast("double"), far))
    origins = _pair_tree(bars, zones["blocks"], F.col("at").cast("double"))
    hl = bars.select("symbol", F.col("bar_idx").alias("_at"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    signed = lambda c: F.when(up, F.col(c)).otherwise(-F.col(c)).cast("double")
    found = lambda c: F.when(F.col(c) <= F.col(now), F.col(c))
    out = rows.withColumn("_x", beyond)
    out = search(out, zones["tree"], now, F.col("_x"), up, False, "_m", backward=True)
    out = out.join(hl.withColumnRenamed("_at", "_m"), ["symbol", "_m"], "left")
    past = F.when(up, F.col("_h") > F.col("_x")).otherwise(F.col("_l") < F.col("_x"))
    out = out.withColumns({"_from": F.coalesce(F.when(past, F.col("_m")).otherwise(F.col("_m") + 1), F.lit(0)).cast("long"), "_m": F.coalesce("_m", F.lit(-1)).cast("long")}).drop("_h", "_l")
    out = search(out, ends, "_from", signed(now), ~up, True, "_z")
    out = out.withColumn("_z", found("_z")).join(hl.withColumnRenamed("_at", "_z"), ["symbol", "_z"], "left")
    out = out.withColumn(gap, F.when(up, F.col("_h")).otherwise(F.col("_l"))).drop("_h", "_l", "_z")
    out = out.withColumn("_from", F.greatest(F.col("_m"), F.lit(0)).cast("long"))
    out = search(out, origins, "_from", signed("_m"), ~up, True, "_s").withColumn("_s", F.coalesce("_s", F.col(now) + 1).cast("long"))
    out = search(out, block_ends, "_s", signed(now), ~up, True, "_z").withColumn("_z", found("_z"))
    named = zones["blocks"].groupBy("symbol", F.col("bar_idx").alias("_z"), F.col("side").alias("_side")).agg(F.max("at").alias("_at"))
    out = out.withColumn("_side", F.when(up, 1).otherwise(-1)).join(named, ["symbol", "_z", "_side"], "left").join(hl, ["symbol", "_at"], "left")
    return out.withColumn(block, F.when(up, F.col("_l")).otherwise(F.col("_h"))).drop("_h", "_l", "_z", "_s", "_m", "_x", "_from", "_at", "_side")


def structure_target(cands: DataFrame, t: dict[str, DataFrame], p: SignalParams, searched: bool | None = None) -> DataFrame:
    """Take-profit from structure: unswept swings on 4h then 1h, gaps, order blocks, else 3R.

    The nearest unswept swing above a price X is found without listing swings:
    m is the last bar up to now above X; the answer is the last swing top up to
    m that is not lower than m (every later top or bar is below it).  Where the
    entry is a price of the coarse bar that is attached, a gap or order block
    can only be alive and beyond the target distance while price never came
    back over it, which leaves the gap completed by that bar.  Otherwise
    (``searched``, by default in strict mode, where closed bars are attached)
    gaps and blocks are searched, see ``alive_zones``.
    """
    searched = p.strict if searched is None else searched
    up = F.col("direction") > 0
    need = F.col("stop_dist") * p.min_rr
    tree = extreme_tree(t["bars"])
    both = marked_swings(t["swings"], p)
    only_swings = both.select(
        "symbol", "bar_idx",
        F.when(F.col("top"), F.col("high")).otherwise(-1e300).alias("high"),
        F.when(F.col("bottom"), F.col("low")).otherwise(1e300).alias("low"),
    )
    swing_tree = extreme_tree(only_swings)
    hl = t["bars"].select("symbol", F.col("bar_idx").alias("_at"), F.col("high").alias("_h"), F.col("low").alias("_l"))
    if searched:
        zones = target_tables(t, p)
    else:
        raw_gap = framed(
            t["bars"], KEYS,
            lambda w: {"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)}, before=2,
        ).select("symbol", F.col("bar_idx").alias("_at"), "_h2", "_l2", F.col("high").alias("_gh"), F.col("low").alias("_gl"))
    out = cands
    for tf in ("4h", "1h"):
        rows = out.withColumns({"symbol": F.concat_ws("|", "sym", F.lit(tf)), "_now": F.col(f"idx_{tf}")})
        beyond = F.when(up, F.col("entry") + need).otherwise(F.col("entry") - need)
        rows = search(rows, tree, "_now", beyond, ~up, True, "_m", backward=True)
        rows = rows.join(hl.withColumnRenamed("_at", "_m"), ["symbol", "_m"], "left")
        level = F.when(up, F.col("_h")).otherwise(F.col("_l"))
        rows = search(rows.withColumn("_lv", level), swing_tree, "_m", F.col("_lv"), ~up, False, "_j", backward=True).drop("_h", "_l", "_lv")
        rows = rows.join(hl.withColumnRenamed("_at", "_j"), ["symbol", "_j"], "left")
        rows = rows.withColumn(f"liq_{tf}", F.when(up, F.col("_h")).otherwise(F.col("_l"))).drop("_h", "_l", "_m", "_j")
        if searched:
            rows = materialize(rows)
            out = materialize(alive_zones(rows, zones, "_now", up, beyond, f"fvg_{tf}", f"ob_{tf}").drop("symbol", "_now"))
            continue
        rows = rows.join(raw_gap.withColumnRenamed("_at", "_now"), ["symbol", "_now"], "left")
        down_gap = up & (F.col("_gh") < F.col("_l2")) & (F.col("_gh") > F.col("entry") + need)
        up_gap = ~up & (F.col("_gl") > F.col("_h2")) & (F.col("_gl") < F.col("entry") - need)
        out = rows.withColumn(
            f"fvg_{tf}", F.when(down_gap, F.col("_gh")).when(up_gap, F.col("_gl"))
        ).drop("symbol", "_now", "_h2", "_l2", "_gh", "_gl")
    order = ["liq_4h", "liq_1h", "fvg_4h", "fvg_1h"] + (["ob_4h", "ob_1h"] if searched else [])
    positive = [F.when(F.col(c) > 0, F.col(c)) for c in order]
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in zip(positive, order)], F.lit("fallback"))
    plain = F.col("entry") + F.col("direction") * F.col("stop_dist") * 3.0
    return out.withColumns({"target": F.coalesce(*positive, plain), "tp_source": source}).drop(*order)


def scored_bars(t: dict[str, DataFrame], state: DataFrame, p: SignalParams, decision_tf: str = "5m") -> DataFrame:
    """Decision bars with all flags, the score and the reason a bar is dropped."""
    hit = lambda c, w: F.coalesce(F.max(c.cast("int")).over(w.rowsBetween(-p.trigger_bars, 0)), F.lit(0)) == 1
    rows = framed(
        state.filter(F.col("tf") == decision_tf), KEYS,
        lambda w: {
            "volume_ok": volume_confirms(w),
            "trigger_up": hit(F.col("break_sign") > 0, w), "trigger_dn": hit(F.col("break_sign") < 0, w),
            "low21": F.min("low").over(w.rowsBetween(-20, 0)), "high21": F.max("high").over(w.rowsBetween(-20, 0)),
        },
        before=max(20, p.trigger_bars),
    )
    # series too short for structure give no daily bias (day) or no confirmation
    rows = rows.select("sym", "ts", "bar_idx", "n_bars", F.col("close").alias("entry"), "volume_ok", "trigger_up",
                       "trigger_dn", "low21", "high21", *[c for c in ("swing_length",) if c in rows.columns])
    ready = state.filter(F.col("n_bars") >= 2 * swing_length(state, p))
    rows = attach(rows, ready, "1d", {"bias": "bias", "strong": "bias_strong"}, p, "inner")
    rows = attach(rows, ready, "1h", {"structure": "s1h", "after_choch": "choch1h"}, p, "inner")
    rows = attach(rows, state, "1h", {"bar_idx": "idx_1h"}, p)
    rows = attach(rows, state, "4h", {"structure": "s4h", "poi_up": "poi_up", "poi_dn": "poi_dn", "midpoint": "mid",
                                      "bar_idx": "idx_4h"}, p)
    rows = attach(rows, state, "15m", {"symbol": "s15", "bar_idx": "i15"}, p)
    rows = rows.withColumn("direction", F.when(F.col("bias") > 0, 1).otherwise(-1))
    zones = entry_zones(t, "15m", p).select(
        F.col("symbol").alias("s15"), F.col("bar_idx").alias("i15"), F.col("sign").alias("direction"),
        "zone_type", "zone_top", "zone_bottom",
    )
    rows = rows.join(zones, ["s15", "i15", "direction"], "left").drop("s15", "i15")
    up = F.col("direction") > 0
    dp = F.when(F.col("entry") > F.col("mid"), 1).when(F.col("entry") < F.col("mid"), -1).otherwise(0)
    rows = rows.withColumns(
        {
            "dp_zone": dp,
            "h4_ok": F.coalesce(F.col("s4h") == F.col("direction"), F.lit(False)),
            "h4_poi": F.coalesce(F.when(up, F.col("poi_up")).otherwise(F.col("poi_dn")), F.lit(False)),
            "h1_ok": F.col("s1h") == F.col("direction"),
            "precision": F.when(up, F.col("trigger_up")).otherwise(F.col("trigger_dn")),
            "has_zone": F.col("zone_type").isNotNull(),
        }
    )
    score = scores.alignment(
        {"bias": F.col("bias") != 0, "bias_strong": F.col("bias_strong"), "h4": F.col("h4_ok"), "h4_poi": F.col("h4_poi"),
         "h1": F.col("h1_ok"), "h1_choch": F.col("choch1h"), "zone": F.col("has_zone"), "trigger": F.col("precision"),
         "volume": F.col("volume_ok")}
    )
    rows = rows.withColumn("score", score).filter(F.col("bar_idx") >= 2 * swing_length(rows, p))
    reason: Column = (
        F.when(F.col("bias") == 0, "neutral")
        .when(F.col("dp_zone") == F.col("direction"), "premium_discount")
        .when(F.round("score", 9) >= p.threshold, "passed")
        .when(~F.col("h1_ok"), "no_confirm")
        .when(~F.col("has_zone"), "no_zone")
        .when(~F.col("precision"), "no_trigger")
        .otherwise("low_score")
    )
    return rows.withColumn("reason", reason)


def near_misses(scored: DataFrame, p: SignalParams, least: float = 0.40, below: float = 0.15) -> DataFrame:
    """Bars whose score lies under the threshold, but not under the near-miss floor, with their gap to it."""
    score = F.round("score", 9)
    floor = F.greatest(F.lit(least), F.round(F.lit(p.threshold - below), 9))
    return scored.filter(F.col("reason").isin("no_confirm", "no_zone", "no_trigger", "low_score") & (score >= floor) & (score < p.threshold)).withColumn("gap", F.round(p.threshold - score, 9))


def signals_from(scored: DataFrame, t: dict[str, DataFrame], p: SignalParams, searched: bool | None = None) -> DataFrame:
    """Entry, stop, target, reward and size of the bars that passed the gate."""
    up = F.col("direction") > 0
    stop = F.when(
        F.col("has_zone"),
        F.when(up, F.col("zone_bottom") * (1 - p.liq_range)).otherwise(F.col("zone_top") * (1 + p.liq_range)),
    ).otherwise(F.when(up, F.col("low21") * (1 - p.liq_range)).otherwise(F.col("high21") * (1 + p.liq_range)))
    rows = scored.filter("reason = 'passed' and entry > 0").withColumn("stop", stop)
    rows = rows.withColumn("stop_dist", F.abs(F.col("entry") - F.col("stop")))
    rows = rows.filter((F.col("stop_dist") > 0) & (F.col("stop_dist") / F.col("entry") >= p.min_stop_pct))
    rows = structure_target(materialize(rows), t, p, searched)
    rr = F.abs(F.col("target") - F.col("entry")) / F.col("stop_dist")
    qty = scores.position_size(p.account, p.risk_pct, F.lit(p.leverage), F.col("entry"), F.col("stop"))
    return rows.withColumns({"risk_reward": rr, "position_size": qty}).filter(
        (F.col("risk_reward") >= p.min_rr) & (F.col("position_size") > 0)
    )


def generate(base: DataFrame, p: SignalParams | None = None, decision_tf: str = "5m", lengths: DataFrame | None = None) -> DataFrame:
    """All signals of all symbols from stored decision bars; ``lengths`` as in ``series_table``."""
    p = p or SignalParams()
    t = structure_tables(series_table(base, decision_tf, lengths, p.swing_length), p)
    state = materialize(running_state(t, p))
    return signals_from(scored_bars(t, state, p, decision_tf), t, p)
