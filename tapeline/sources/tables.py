"""The star-schema tables seen as ticks, a trade journal and instruments.

Every reader selects only the columns its operator needs; filters and column
lists reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.bars import bars_from_ticks, numbered
from tapeline.session import materialize

# Asset classes in id order.
ASSET_CLASSES = ["crypto", "forex", "stocks", "commodities"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less timestamps read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: the event type is the symbol, the value the price."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    """Numbered bars of the ticks, stored once so that later passes scan columns."""
    return materialize(numbered(materialize(bars_from_ticks(ticks(spark, sf_dir), tf))))


def class_of(symbol_key: Column) -> Column:
    """Asset class of an instrument number."""
    names = F.array(*[F.lit(c) for c in ASSET_CLASSES])
    return F.element_at(names, (symbol_key % 4 + 1).cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order as journal trades (one row per line item).

    Entry and exit are the earlier and the later of order and ship date; trades
    of open orders have no exit.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    edge = F.round(F.col("l_discount") - 0.05, 2)
    is_open = F.col("o_orderstatus") == "O"
    outcome = F.when(edge > 0, "win").when(edge < 0, "loss").otherwise("breakeven")
    closed = lambda c: F.when(~is_open, c)
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        class_of(F.col("l_suppkey")).alias("asset_class"),
        F.when(F.col("l_linenumber") % 2 == 0, "long").otherwise("short").alias("direction"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("style_id"),
        F.least("o_orderdate", "l_shipdate").alias("entry_time"),
        closed(F.greatest("o_orderdate", "l_shipdate")).alias("exit_time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        closed(outcome).alias("outcome"),
        closed(F.round(F.col("l_extendedprice") * edge, 4)).alias("pnl"),
        closed(edge).alias("pnl_pct"),
        (1 + F.col("l_quantity") / 10).alias("rr_target"),
        closed(edge * 40).alias("rr_actual"),
        (F.round(F.col("l_tax") / 10 + 0.002, 4)).alias("risk_pct"),
        F.round(0.5 + F.col("l_quantity") / 100, 4).alias("score"),
        F.col("l_linenumber").alias("leverage"),
        F.col("l_quantity").cast("int").alias("bars_held"),
        (F.col("l_linenumber") % 3 == 0).alias("be_triggered"),
    )


def break_signals(bars_: DataFrame, broken: DataFrame, reward: float = 2.0, buffer: float = 0.005) -> DataFrame:
    """A signal per structure break: stop beyond the bar, target at ``reward`` R."""
    b = bars_.join(broken.select("symbol", "bar_idx", "sign"), ["symbol", "bar_idx"]).filter("close > 0")
    up = F.col("sign") > 0
    stop = F.when(up, F.col("low") * (1 - buffer)).otherwise(F.col("high") * (1 + buffer))
    return b.withColumn("stop", stop).select(
        F.concat_ws("-", "symbol", "bar_idx").alias("sig_id"), "symbol", "ts", "bar_idx", "n_bars",
        F.col("sign").alias("direction"), F.col("close").alias("entry"), "stop",
        (F.col("close") + F.col("sign") * reward * F.abs(F.col("close") - F.col("stop"))).alias("target"),
    ).filter("abs(entry - stop) > 0")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled training samples (results in R)."""
    li = table(spark, sf_dir, "lineitem")
    edge = F.round(F.col("l_discount") - 0.05, 2)
    mech = F.col("l_partkey") % 5
    mfe = F.col("l_quantity") / 10
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.col("l_shipdate").alias("ts"),
        (F.year("l_shipdate") - 1995).alias("window"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
        class_of(F.col("l_suppkey")).alias("asset_class"),
        (F.col("l_linenumber") % 3).alias("label_action"),
        F.when(edge > 0, 1).when(edge < 0, 2).otherwise(3).alias("label_outcome"),
        (edge * 40).alias("label_rr"),
        mfe.alias("mfe"),
        (F.col("l_tax") * 20).alias("mae"),
        (1 + F.col("l_quantity") / 20).alias("tp_rr"),
        F.col("l_tax").alias("cost_rr"),
        mech.cast("int").alias("mech"),
        F.when(mech == 1, mfe + 1).alias("post_tp"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("x_price"),
        F.col("l_tax").alias("x_tax"),
        (F.col("l_quantity") / 50).alias("x_quantity"),
    )
