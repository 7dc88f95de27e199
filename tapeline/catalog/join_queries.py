"""Joins on time and price, dataset differences, greedy spacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.catalog.fragments import TICKS, bars_cte, gaps_cte, with_
from tapeline.catalog.registry import R, query, r
from tapeline.operators import asof as A
from tapeline.operators import structure as S
from tapeline.operators.bars import bars_from_ticks
from tapeline.operators.greedy import greedy_keep
from tapeline.session import materialize
from tapeline.sources import tables as T

SIDES = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
rr AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')"""
LEFT, RIGHT = "purchase", "click"


def _sides(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return (
        ev.filter(F.col("event_type") == LEFT).select("event_id", "user_id", "ts"),
        ev.filter(F.col("event_type") == RIGHT).select("user_id", "ts", "value"),
    )


@query(
    "join_asof_backward",
    f"WITH {SIDES} SELECT l.event_id, l.user_id, l.ts, rr.value AS last_value FROM l ASOF LEFT JOIN rr ON l.user_id = rr.user_id AND l.ts >= rr.ts",
)
def join_asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    return A.asof_join(left, right, ["user_id"], "ts", "ts", {"value": "last_value"})


@query(
    "join_asof_forward",
    f"WITH {SIDES} SELECT l.event_id, l.user_id, l.ts, rr.value AS next_value FROM l ASOF LEFT JOIN rr ON l.user_id = rr.user_id AND l.ts <= rr.ts",
)
def join_asof_forward(spark, sf):
    left, right = _sides(spark, sf)
    return A.asof_join(left, right, ["user_id"], "ts", "ts", {"value": "next_value"}, "forward")


NEAREST = f"""WITH {SIDES}, b AS (SELECT l.*, rr.ts AS bts, rr.value AS bv FROM l ASOF LEFT JOIN rr ON l.user_id = rr.user_id AND l.ts >= rr.ts),
 f AS (SELECT b.*, rr.ts AS fts, rr.value AS fv FROM b ASOF LEFT JOIN rr ON b.user_id = rr.user_id AND b.ts <= rr.ts),
 p AS (SELECT *, CASE WHEN bts IS NULL THEN 1 WHEN fts IS NULL THEN 0 WHEN epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts) THEN 0 ELSE 1 END AS fwd FROM f)"""


@query(
    "join_nearest_tolerance",
    NEAREST + """, n AS (SELECT event_id, user_id, ts, CASE WHEN fwd = 1 THEN fts ELSE bts END AS m, CASE WHEN fwd = 1 THEN fv ELSE bv END AS v FROM p)
    SELECT event_id, user_id, ts, CASE WHEN abs(epoch_us(m) - epoch_us(ts)) <= 7200000000 THEN m END AS matched_ts,
    CASE WHEN abs(epoch_us(m) - epoch_us(ts)) <= 7200000000 THEN v END AS near_value FROM n""",
)
def join_nearest_tolerance(spark, sf):
    left, right = _sides(spark, sf)
    return A.nearest_join(left, right, ["user_id"], "ts", "ts", {"value": "near_value"}, 7200)


@query(
    "join_nearest_unbounded",
    NEAREST + " SELECT event_id, user_id, ts, CASE WHEN fwd = 1 THEN fts ELSE bts END AS matched_ts, CASE WHEN fwd = 1 THEN fv ELSE bv END AS near_value FROM p",
)
def join_nearest_unbounded(spark, sf):
    left, right = _sides(spark, sf)
    return A.nearest_join(left, right, ["user_id"], "ts", "ts", {"value": "near_value"})


_WINDOWS = [("2024-01-08", "2024-01-10"), ("2024-01-18", "2024-01-20 12:00:00")]


@query(
    "join_purged_signals",
    "WITH w(a, z) AS (VALUES " + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{z}')" for a, z in _WINDOWS) + """)
    SELECT event_id, ts, event_type FROM events e WHERE NOT EXISTS (
      SELECT 1 FROM w WHERE e.ts <= z AND e.ts + INTERVAL 100800 SECOND >= a)""",
)
def join_purged_signals(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "ts", "event_type")
    w = spark.createDataFrame(_WINDOWS, "a string, z string").select(
        F.col("a").cast("timestamp").alias("test_start"), F.col("z").cast("timestamp").alias("test_end")
    )
    return A.purge(ev, w, (48 + 288) * 300)


@query(
    "join_zone_overlap",
    with_(TICKS, bars_cte("1h", "b1"), gaps_cte("b1", "g1"), bars_cte("4h", "b4"), gaps_cte("b4", "g4"))
    + """SELECT symbol, ts, gap_top, gap_bottom, EXISTS (SELECT 1 FROM g4 h WHERE h.gap IS NOT NULL AND h.symbol = g1.symbol
      AND h.gap_bottom <= g1.gap_top AND h.gap_top >= g1.gap_bottom) AS overlaps FROM g1 WHERE gap IS NOT NULL""",
)
def join_zone_overlap(spark, sf):
    fine = S.gaps(T.bars(spark, sf, "1h")).filter("gap is not null").select("symbol", "ts", "gap_top", "gap_bottom")
    coarse = S.gaps(T.bars(spark, sf, "4h")).filter("gap is not null").select("symbol", "gap_top", "gap_bottom")
    return A.overlaps_any(fine, materialize(coarse), ["symbol"], "gap_bottom", "gap_top", 5.0)


@query(
    "join_correlation_conflicts",
    with_(TICKS, bars_cte("4h", "b"))
    + f""", ret AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS ret FROM b)
    SELECT x.symbol, y.symbol AS held_symbol, {R('corr(x.ret, y.ret)')} AS correlation, count(*) AS points,
    abs(corr(x.ret, y.ret)) > 0.05 AND count(*) >= 20 AS conflict FROM ret x JOIN ret y ON x.ts = y.ts AND x.symbol <> y.symbol
    WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL AND y.symbol IN ('click', 'error') GROUP BY ALL""",
)
def join_correlation_conflicts(spark, sf):
    from tapeline.operators.blocks import framed

    b = T.bars(spark, sf, "4h")
    ret = framed(b, ["symbol"], lambda w: {"ret": F.col("close") - F.lag("close").over(w)}, before=1)
    ret = ret.filter("ret is not null").select("symbol", "ts", "ret")
    symbols = b.select("symbol").distinct()
    return A.correlation_conflicts(symbols, symbols.filter("symbol in ('click', 'error')"), ret, 0.05).select(
        "symbol", "held_symbol", r("correlation").alias("correlation"), "points", "conflict"
    )


@query(
    "join_dataset_diff",
    with_(TICKS, bars_cte("1h", "a"), "big AS (SELECT * FROM ticks WHERE price >= 1)",
          bars_cte("1h", "b").replace("FROM ticks", "FROM big"))
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (a.symbol IS NOT NULL AND b.symbol IS NOT NULL) AS both,
      count(*) FILTER (b.symbol IS NULL) AS only_old, count(*) FILTER (a.symbol IS NULL) AS only_new,
      count(*) FILTER (abs(a.{c} - b.{c}) > 0.001) AS different FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts"""
        for c in ("open", "high", "low", "close")),
)
def join_dataset_diff(spark, sf):
    t = T.ticks(spark, sf)
    return A.dataset_diff(bars_from_ticks(t, "1h"), bars_from_ticks(t.filter("price >= 1"), "1h"), ["symbol", "ts"],
                          ["open", "high", "low", "close"])


@query(
    "join_trade_lookup",
    """WITH c(asset_class, id, commission, slippage) AS (VALUES ('crypto', 0, 0.0004::DOUBLE, 0.0002::DOUBLE), ('forex', 1, 0.00005::DOUBLE, 0.0001::DOUBLE),
      ('stocks', 2, 0.0001::DOUBLE, 0.0002::DOUBLE), ('commodities', 3, 0.0002::DOUBLE, 0.0002::DOUBLE)),
    t AS (SELECT (['crypto', 'forex', 'stocks', 'commodities'])[(l_suppkey % 4 + 1)::INT] AS asset_class, l_extendedprice FROM lineitem)
    SELECT id AS class_id, count(*) AS trades, (round(sum(l_extendedprice * (commission + slippage) * 2), 2) + 0.0) AS cost
    FROM t LEFT JOIN c USING (asset_class) GROUP BY id""",
)
def join_trade_lookup(spark, sf):
    costs = spark.createDataFrame(
        [("crypto", 0, 0.0004, 0.0002), ("forex", 1, 0.00005, 0.0001), ("stocks", 2, 0.0001, 0.0002), ("commodities", 3, 0.0002, 0.0002)],
        "asset_class string, id int, commission double, slippage double",
    )
    t = T.table(spark, sf, "lineitem").select(T.class_of(F.col("l_suppkey")).alias("asset_class"), "l_extendedprice")
    j = t.join(F.broadcast(costs), "asset_class", "left")
    cost = F.col("l_extendedprice") * (F.col("commission") + F.col("slippage")) * 2
    return j.groupBy(F.col("id").alias("class_id")).agg(F.count(F.lit(1)).alias("trades"), r(F.sum(cost), 2).alias("cost"))


@query(
    "greedy_gap_dedup",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id % 2 AS side, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY ts, event_id) AS rn FROM events),
    g AS (SELECT event_id, event_type, side, us, rn, us AS kept, true AS keep FROM e WHERE rn = 1
      UNION ALL SELECT e.event_id, e.event_type, e.side, e.us, e.rn, CASE WHEN e.us - g.kept >= 1800000000 THEN e.us ELSE g.kept END,
        e.us - g.kept >= 1800000000 FROM g JOIN e ON e.event_type = g.event_type AND e.side = g.side AND e.rn = g.rn + 1)
    SELECT event_id, event_type, side FROM g WHERE keep""",
)
def greedy_gap_dedup(spark, sf):
    ev = T.table(spark, sf, "events").select(
        "event_id", "event_type", (F.col("user_id") % 2).alias("side"), F.unix_micros("ts").alias("start")
    ).withColumn("until", F.col("start") + 1_800_000_000)
    kept = greedy_keep(ev, ["event_type", "side"], "start", "until", "event_id", 5 * 86_400_000_000)
    return kept.select("event_id", "event_type", "side")
