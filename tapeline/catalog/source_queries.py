"""Sources and sinks, each written and read back through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeline.catalog.fragments import SAMPLES, TICKS, TRADES, bars_cte, with_
from tapeline.catalog.registry import R, query, r
from tapeline.functions import scores
from tapeline.operators.bars import bars_from_ticks
from tapeline.operators.ranking import top_per_group
from tapeline.session import shared_dir
from tapeline.sources import files as S
from tapeline.sources import tables as T


def _folder(spark):
    return f"{shared_dir(spark)}/tapeline/{uuid.uuid4().hex}"


@query(
    "source_json_features",
    """SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events WHERE (props->>'$.k') IS NOT NULL""",
)
def source_json_features(spark, sf):
    ev = T.table(spark, sf, "events").select("event_id", "props")
    return S.features_from_json(ev, "props", ["k"]).select("event_id", "k")


@query(
    "source_normalised_candles",
    """SELECT DISTINCT event_type AS symbol, '1m' AS tf, make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-20 01:00:00'""",
)
def source_normalised_candles(spark, sf):
    ev = T.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("value").cast("string"))
    raw = ev.select(F.col("event_type").alias("symbol"), F.lit("1m").alias("tf"), (F.floor(F.unix_seconds("ts") / 3600) * 3_600_000).alias("time_ms"),
                    *[text.alias(c) for c in ("open", "high", "low", "close")], F.lit("1").alias("volume"))
    return S.normalise_candles(raw, "2024-01-20 00:00:00").select("symbol", "tf", "ts")


@query("source_bars_written", with_(TICKS, bars_cte("4h")) + "SELECT symbol, ts, close FROM bars")
def source_bars_written(spark, sf):
    path = _folder(spark)
    b = bars_from_ticks(T.ticks(spark, sf), "4h").unionByName(bars_from_ticks(T.ticks(spark, sf), "1d"))
    S.write_bars(b, path)
    return S.read_bars(spark, [path], "4h").select("symbol", "ts", "close")


@query(
    "source_first_root_wins",
    with_(TICKS, bars_cte("1d")) + "SELECT symbol, ts, CASE WHEN symbol IN ('click', 'view') THEN close ELSE close + 1000 END AS close FROM bars",
)
def source_first_root_wins(spark, sf):
    first, second = _folder(spark), _folder(spark)
    b = bars_from_ticks(T.ticks(spark, sf), "1d")
    S.write_bars(b.filter("symbol in ('click', 'view')"), first)
    S.write_bars(b.withColumn("close", F.col("close") + 1000), second)
    return S.read_bars(spark, [first, second]).select("symbol", "ts", "close")


@query(
    "source_time_slice",
    with_(TICKS, bars_cte("1h"), "f AS (SELECT symbol, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS n FROM bars GROUP BY symbol)")
    + "SELECT symbol, ts, bar_idx FROM bars JOIN f USING (symbol) WHERE ts <= TIMESTAMP '2024-01-12' AND bar_idx >= n - 100",
)
def source_time_slice(spark, sf):
    return S.time_slice(T.bars(spark, sf), "2024-01-10", "2024-01-12", ["symbol"], F.lit(S.WARM_UP["1h"])).select("symbol", "ts", "bar_idx")


@query(
    "source_window_replaced",
    with_(SAMPLES) + f"""SELECT asset_class, "window", count(*) AS rows, {R('sum(CASE WHEN "window" = 3 THEN label_rr * 2 ELSE label_rr END)', 4)} AS total FROM samples GROUP BY ALL""",
)
def source_window_replaced(spark, sf):
    path = _folder(spark)
    s = T.samples(spark, sf).select("sample_id", "asset_class", "window", "label_rr", "mfe")
    S.write_samples(s, path)
    S.replace_window(spark, s.filter("window = 3").withColumn("label_rr", F.col("label_rr") * 2).drop("mfe"), path)
    back = spark.read.parquet(path)
    return back.groupBy("asset_class", "window").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("label_rr"), 4).alias("total"))


@query("source_parts_merged", with_(SAMPLES) + "SELECT asset_class, count(*) AS rows FROM samples GROUP BY 1")
def source_parts_merged(spark, sf):
    s = T.samples(spark, sf).select("sample_id", "asset_class", "label_rr")
    paths = []
    for low in (0, 1):
        p = _folder(spark)
        s.filter(F.abs(F.hash("sample_id")) % 2 == low).write.parquet(p)
        paths.append(p)
    return S.merge_parts(spark, paths).groupBy("asset_class").agg(F.count(F.lit(1)).alias("rows"))


@query("source_columns_backfilled", with_(SAMPLES) + f"SELECT sample_id, {R('least(greatest(mae * 1.1::DOUBLE, 1), 3)')} AS optimal_sl_rr FROM samples")
def source_columns_backfilled(spark, sf):
    from tapeline.operators.labels import hindsight_targets

    old, new = _folder(spark), _folder(spark)
    T.samples(spark, sf).write.parquet(old)
    spark.read.parquet(old).withColumns(hindsight_targets()).write.parquet(new)
    return spark.read.parquet(new).select("sample_id", r("optimal_sl_rr").alias("optimal_sl_rr"))


@query(
    "source_feedback_lines",
    """SELECT l_orderkey || '-' || l_linenumber AS trade_id, (['A', 'B', 'C'])[(l_partkey % 3 + 1)::INT] AS grade, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL""",
)
def source_feedback_lines(spark, sf):
    path = _folder(spark)
    li = T.table(spark, sf, "lineitem")
    g = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_partkey") % 3 + 1).cast("int"))
    tid = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id")
    good, legacy = F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 2 == 0
    S.append_json(li.filter(good & ~legacy).select(tid, F.struct(g.alias("grade")).alias("teacher")), path)
    S.append_json(li.filter(good & legacy).select(tid, F.struct(g.alias("grade")).alias("analysis")), path)
    li.filter(~good).select(F.lit("{broken")).write.mode("append").text(path)
    return S.read_feedback(spark, path).groupBy("trade_id", "grade").agg(F.count(F.lit(1)).alias("n"))


@query("source_csv_round_trip", "SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders")
def source_csv_round_trip(spark, sf):
    path = _folder(spark)
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    S.write_csv(o, path)
    return S.read_csv(spark, path, "k long, price double, status string")


def _log(spark, sf):
    path = _folder(spark)
    ev = T.table(spark, sf, "events")
    word = (F.when(F.col("event_type") == "click", "XGB ACCEPT").when(F.col("event_type") == "view", "XGB REJECT").when(F.col("event_type") == "purchase", "CANDLE")
            .when(F.col("event_type") == "signup", "HEARTBEAT").otherwise("ERROR"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.concat(F.lit("S"), F.col("user_id") % 7), F.lit("] "), word, F.lit(" LONG score="), F.col("value").cast("string"))
    ev.select(line).write.text(path)
    return S.log_events(spark.read.text(path))


@query(
    "source_log_events",
    f"""SELECT 'S' || (user_id % 7) AS symbol, CASE event_type WHEN 'click' THEN 'accept' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'candle' WHEN 'signup' THEN 'heartbeat' ELSE 'error' END AS kind,
    count(*) AS n, {R('sum(value)', 4)} AS score FROM events GROUP BY ALL""",
)
def source_log_events(spark, sf):
    return _log(spark, sf).groupBy("symbol", "kind").agg(F.count(F.lit(1)).alias("n"), r(F.sum("score"), 4).alias("score"))


@query(
    "source_log_filter_counts",
    """SELECT count(*) FILTER (event_type = 'click') AS accepted, count(*) FILTER (event_type = 'view') AS rejected, 0::BIGINT AS tp_adjusted, 0::BIGINT AS be_triggered,
    round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type IN ('click', 'view'))::DOUBLE * 100, 1) AS rate FROM events""",
)
def source_log_filter_counts(spark, sf):
    return S.filter_counts(_log(spark, sf))


@query(
    "source_feed_freshness",
    """WITH e AS (SELECT 'S' || (user_id % 7) AS symbol, event_type, date_trunc('second', ts) AS ts FROM events)
    SELECT symbol, max(ts) FILTER (event_type = 'purchase') AS last_candle, max(ts) FILTER (event_type = 'signup') AS last_heartbeat, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'signup')) AS errors,
    (epoch(TIMESTAMP '2024-01-31') - epoch(max(ts) FILTER (event_type = 'purchase')))::BIGINT AS age_seconds, (epoch(TIMESTAMP '2024-01-31') - epoch(max(ts) FILTER (event_type = 'purchase'))) > 3600 AS stale FROM e GROUP BY symbol""",
)
def source_feed_freshness(spark, sf):
    return S.freshness(_log(spark, sf), "2024-01-31", "symbol", 3600)


@query(
    "source_cluster_parameters",
    """SELECT 'S' || l_suppkey AS symbol, (l_suppkey % 3)::VARCHAR AS cluster, CASE WHEN l_suppkey % 3 = 2 THEN 8 ELSE 5 + l_suppkey % 3 END::DOUBLE AS swing_length, 0.0004::DOUBLE AS fvg_threshold, count(*) AS rows FROM lineitem GROUP BY ALL""",
)
def source_cluster_parameters(spark, sf):
    path = _folder(spark)
    li = T.table(spark, sf, "lineitem").select("l_suppkey")
    symbols = li.distinct().select(F.concat(F.lit("S"), "l_suppkey").alias("s"), (F.col("l_suppkey") % 3).cast("string").alias("c"))
    doc = symbols.agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("symbol_to_cluster")).withColumn(
        "clusters", F.create_map(F.lit("0"), F.struct(F.lit(5.0).alias("swing_length")), F.lit("1"), F.struct(F.lit(6.0).alias("swing_length")))
    )
    doc.coalesce(1).write.json(path)
    params = S.cluster_parameters(spark, path, {"swing_length": 8.0, "fvg_threshold": 0.0004})
    rows = li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(params, "symbol")


@query("source_symbol_discovery")
def source_symbol_discovery(spark, sf):
    path = _folder(spark)
    T.ticks(spark, sf).repartition("symbol").write.partitionBy("symbol").parquet(path)
    return S.discover_symbols(spark, path, 3)


@query(
    "source_representative_symbols",
    """WITH g AS (SELECT 'S' || l_suppkey AS symbol, (l_suppkey % 4)::INT AS cluster, count(*) AS rows, min(l_shipdate) AS first FROM lineitem GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rows DESC, symbol) AS r FROM g WHERE rows >= 100 AND first <= TIMESTAMP '1996-01-01') SELECT symbol, cluster, rows FROM k WHERE r <= 5""",
)
def source_representative_symbols(spark, sf):
    g = T.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.min("l_shipdate").alias("first"))
    g = g.filter("rows >= 100 and first <= '1996-01-01'").select(
        F.concat(F.lit("S"), "l_suppkey").alias("symbol"), (F.col("l_suppkey") % 4).cast("int").alias("cluster"), "rows"
    )
    return top_per_group(g, ["cluster"], [F.desc("rows"), F.col("symbol")], 5)


@query(
    "source_merged_candles",
    with_(TICKS, bars_cte("4h")) + "SELECT ts, symbol, close, row_number() OVER (ORDER BY ts, symbol) - 1 AS seq FROM bars",
)
def source_merged_candles(spark, sf):
    from tapeline.operators.blocks import number_rows

    b = bars_from_ticks(T.ticks(spark, sf), "4h").withColumn("_all", F.lit(0))
    return number_rows(b, ["_all"], "ts", 86400, ("symbol",), "seq", None).select("ts", "symbol", "close", "seq")


@query(
    "source_symbol_names",
    """SELECT p_partkey, replace(split_part(upper(p_brand) || '/USDT:USDT', ':', 1), '/', '') AS clean, replace(replace(upper(p_brand) || '/USDT:USDT', '/', '_'), ':', '_') AS file_name FROM part""",
)
def source_symbol_names(spark, sf):
    s = F.concat(F.upper("p_brand"), F.lit("/USDT:USDT"))
    return T.table(spark, sf, "part").select("p_partkey", scores.clean_symbol(s).alias("clean"), scores.file_symbol(s).alias("file_name"))


@query(
    "source_display_time",
    f"""SELECT event_id, ts + CASE WHEN ts < TIMESTAMP '2024-03-31' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS local_ts, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS five_min,
    {R('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {R('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos, date_trunc('week', ts)::DATE AS week FROM events""",
)
def source_display_time(spark, sf):
    ev = T.table(spark, sf, "events")
    sin, cos = scores.hour_cycle(F.col("ts"))
    five = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 300) * 300)
    return ev.select("event_id", F.from_utc_timestamp("ts", "Europe/Zurich").alias("local_ts"), five.alias("five_min"), r(sin).alias("hour_sin"),
                     r(cos).alias("hour_cos"), F.date_trunc("week", "ts").cast("date").alias("week"))


_BAR_OF = """bars3 AS (SELECT trade_id, asset_class, direction, outcome, exit_time, pnl_pct, i AS bar_index, round(pnl_pct * (i - 1), 6) AS unrealized FROM trades, range(1, 4) t(i))"""


@query(
    "source_journal_tables",
    with_(TRADES) + f"""SELECT asset_class, direction, count(*) AS trades, count(*) FILTER (outcome = 'win') AS wins, {R('avg(rr_actual)', 4)} AS mean_rr, sum(bars_held)::BIGINT AS bars, sum(be_triggered::INT)::BIGINT AS ratchets,
    max(entry_time) AS last_entry FROM trades WHERE exit_time IS NOT NULL AND asset_class <> 'stocks' GROUP BY ALL""",
)
def source_journal_tables(spark, sf):
    """The journal written and read with its declared types."""
    path = _folder(spark)
    S.write_journal(spark, T.trades(spark, sf), path)
    closed = S.read_journal(spark, path).filter("exit_time is not null and asset_class <> 'stocks'")
    return closed.groupBy("asset_class", "direction").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("outcome") == "win").alias("wins"), r(F.avg("rr_actual"), 4).alias("mean_rr"), F.sum("bars_held").alias("bars"),
        F.sum("be_triggered").alias("ratchets"), F.max("entry_time").alias("last_entry"))


@query(
    "source_exported_episodes",
    with_(TRADES, _BAR_OF) + """SELECT asset_class, direction, bar_index, count(*) AS rows, sum((pnl_pct - unrealized > 0)::INT)::BIGINT AS hold_better FROM bars3 WHERE exit_time IS NOT NULL GROUP BY ALL""",
)
def source_exported_episodes(spark, sf):
    """Labelled bars of closed trades, exported and read; every bar is written to the journal twice."""
    path, out = _folder(spark), _folder(spark) + "-episodes"
    S.write_journal(spark, T.trades(spark, sf), path)
    bars = S.read_journal(spark, path).select("trade_id", "pnl_pct", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("bar_index"))
    bars = bars.withColumn("unrealized_pnl_pct", F.round(F.col("pnl_pct") * (F.col("bar_index") - 1), 6))
    S.write_journal(spark, bars.unionByName(bars), path, "trade_bars")
    S.export_episodes(spark, path, out)
    return spark.read.parquet(out).groupBy("asset_class", "direction", "bar_index").agg(F.count(F.lit(1)).alias("rows"), F.sum("label_hold_better").alias("hold_better"))
