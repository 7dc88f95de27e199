"""Readers and writers for bars, samples, JSON lines, CSV, logs and parameter files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import shuffle_partitions, shuffles_dropped

BAR_SCHEMA = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"
# Bars kept before the start of a slice.
WARM_UP = {"5m": 0, "15m": 50, "1h": 100, "4h": 100, "1d": 250}
FEEDBACK_SCHEMA = (
    "trade_id string, ts timestamp, actual struct<entry: double, exit: double, pnl_pct: double>, "
    "teacher struct<grade: string, confluences: array<string>>, analysis struct<grade: string>"
)
TRADE_SCHEMA = (
    "trade_id string, symbol string, asset_class string, direction string, style string, tier string, entry_time timestamp, "
    "exit_time timestamp, entry_price double, sl_original double, sl_used double, tp double, exit_price double, bars_held int, "
    "leverage int, outcome string, exit_reason string, pnl_pct double, rr_target double, rr_actual double, risk_pct double, "
    "score double, xgb_confidence double, be_triggered int, max_favorable_pct double, max_adverse_pct double, "
    "post_missed_pct double, entry_features map<string,double>"
)
TRADE_BAR_SCHEMA = (
    "trade_id string, bar_index int, ts timestamp, close double, high double, low double, volume double, unrealized_pnl_pct double, "
    "sl_distance_pct double, rsi_5m double, adx_1h double, structure_break int, new_fvg_against int, new_ob_against int, max_favorable_seen double"
)


JOURNAL = {"trades": TRADE_SCHEMA, "trade_bars": TRADE_BAR_SCHEMA, "post_trade_bars": TRADE_BAR_SCHEMA}


#: Rows of a task that drops repeated bars or joins them to their trades: they fit its memory, so that nothing is spilled.
TASK_ROWS = 1 << 20


def _tasks(rows: DataFrame) -> int:
    """Tasks of about ``TASK_ROWS`` rows, as many as the shuffle setting says at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def write_journal(spark: SparkSession, rows: DataFrame, path: str, table: str = "trades") -> None:
    """Append rows to a table of the journal, in its columns and types; columns the rows lack are null, others are left out.

    Bars of a trade are unique by (trade, bar): of repeated rows one is kept.
    """
    schema = T.StructType.fromDDL(JOURNAL[table])
    if table != "trades":  # only the columns that are there are shuffled
        have = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in rows.columns])
        # Dealt by trade alone, so that bars of a trade stay side by side, which packs well, also when they are read again.
        rows = have.repartition(_tasks(have), "trade_id").dropDuplicates(["trade_id", "bar_index"])
    typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    with shuffles_dropped(spark):
        typed.write.mode("append").parquet(f"{path}/{table}")


def read_journal(spark: SparkSession, path: str, table: str = "trades") -> DataFrame:
    """A table of the journal with its declared types; filters and columns reach the scan."""
    return spark.read.schema(JOURNAL[table]).parquet(f"{path}/{table}")


def export_episodes(spark: SparkSession, path: str, out: str) -> None:
    """Bars of closed trades with what is known of the trade and the hold label, as Parquet by asset class."""
    closed = read_journal(spark, path).filter(F.col("exit_time").isNotNull())
    known = closed.select("trade_id", "symbol", "asset_class", "direction", "outcome", F.col("pnl_pct").alias("final_pnl_pct"))
    stored = read_journal(spark, path, "trade_bars")
    bars = stored.join(known, "trade_id")
    label = (F.col("final_pnl_pct") - F.col("unrealized_pnl_pct") > 0).cast("int")
    # The join has dealt the rows by trade; a task writes one file of each class.
    with shuffle_partitions(spark, _tasks(stored)), shuffles_dropped(spark):
        bars.withColumn("label_hold_better", label).write.mode("errorifexists").partitionBy("asset_class").parquet(out)


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; what is not a number becomes null, NaN too."""
    def clean(c):
        x = F.expr(f"try_cast(`{c}` as double)")
        return F.when(~F.isnan(x), x)

    return df.withColumns({c: clean(c) for c in columns})


def normalise_candles(raw: DataFrame, end: str | None = None) -> DataFrame:
    """Raw candle batches: epoch milliseconds to time, one row per time, trimmed."""
    df = as_doubles(raw, ["open", "high", "low", "close", "volume"]).withColumn("ts", F.timestamp_millis(F.col("time_ms").cast("long")))
    df = df.dropDuplicates(["symbol", "tf", "ts"]).drop("time_ms")
    return df if end is None else df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bars as gzip Parquet by timeframe, clustered by symbol for pruning."""
    bars.repartitionByRange("tf", "symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode(mode).option(
        "compression", "gzip"
    ).partitionBy("tf").parquet(path)


def read_bars(spark: SparkSession, roots: list[str], tf: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Bars of the first root that has a symbol; filters reach the scan."""
    out = None
    for rank, root in enumerate(roots):
        part = spark.read.schema(BAR_SCHEMA).parquet(root).withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    if tf:
        out = out.filter(F.col("tf") == tf)
    if symbols:
        out = out.filter(F.col("symbol").isin(symbols))
    if len(roots) == 1:
        return out.drop("_rank")
    best = out.groupBy("symbol", "tf").agg(F.min("_rank").alias("_rank"))
    return out.join(best, ["symbol", "tf", "_rank"], "left_semi").drop("_rank")


def time_slice(numbered: DataFrame, start: str, end: str, keys: list[str], warm_up: Column) -> DataFrame:
    """Rows from ``start`` to ``end`` and ``warm_up`` numbered rows before the start."""
    first = numbered.groupBy(*keys).agg(F.count_if(F.col("ts") < F.lit(start).cast("timestamp")).alias("_first"))
    return numbered.join(first, keys).filter(
        (F.col("ts") <= F.lit(end).cast("timestamp")) & (F.col("bar_idx") >= F.col("_first") - warm_up)
    ).drop("_first")


def discover_symbols(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Symbols by bytes on disk, largest first (folders partitioned by symbol); the listing alone is read, no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.select(F.url_decode(F.regexp_extract("path", "/symbol=([^/]+)/", 1)).alias("symbol"), "length").filter("symbol <> ''")
    return named.groupBy("symbol").agg(F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "symbol").limit(n)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    samples.write.mode(mode).partitionBy("asset_class", "window").parquet(path)


def replace_window(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Overwrite only the partitions present in ``new``; missing columns become null."""
    have = spark.read.parquet(path)
    aligned = have.limit(0).unionByName(new, allowMissingColumns=True).select(*have.columns)
    aligned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_class", "window").parquet(path)


def merge_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several part folders as one; a missing or empty part is an error."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    seen = df.groupBy(F.col("_metadata.file_path").alias("file")).count().select("file")
    missing = [p for p in paths if seen.filter(F.col("file").contains(p.rstrip("/") + "/")).isEmpty()]
    if missing:
        raise ValueError(f"empty parts: {missing}")
    return df


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Teacher feedback lines; broken lines are dropped, either grade field counts."""
    df = spark.read.schema(FEEDBACK_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    g = F.coalesce(F.nullif(F.col("teacher.grade"), F.lit("")), F.nullif(F.col("analysis.grade"), F.lit("")))
    return df.withColumn("grade", g).filter("trade_id is not null and grade is not null and grade <> 'N/A'")


def features_from_json(df: DataFrame, column: str, features: list[str]) -> DataFrame:
    """JSON text column to one column per feature; rows without all of them go."""
    parsed = df.withColumn("_m", F.from_json(column, T.MapType(T.StringType(), T.DoubleType())))
    out = parsed.select("*", *[F.col("_m").getItem(f).alias(f) for f in features]).drop("_m")
    return out.dropna(subset=features)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def log_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Typed events of log lines: time, kind, symbol, direction, numbers."""
    v = F.col(text)
    kind = (
        F.when(v.contains("NEAR-MISS"), "near_miss").when(v.contains("XGB ACCEPT"), "accept").when(v.contains("XGB REJECT"), "reject")
        .when(v.contains("TRADE OPEN"), "open").when(v.contains("TRADE CLOSE"), "close").when(v.contains("RL TP adjusted"), "tp_adjusted")
        .when(v.contains("BE TRIGGERED"), "be_triggered").when(v.contains("HEARTBEAT"), "heartbeat").when(v.contains("CANDLE"), "candle")
        .when(v.contains("ERROR"), "error")
    )
    pull = lambda p: F.nullif(F.regexp_extract(v, p, 1), F.lit(""))
    return lines.select(
        F.to_timestamp(pull(r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)")).alias("ts"), kind.alias("kind"), pull(r"\[([A-Za-z0-9_/:]+)\]").alias("symbol"),
        pull(r"\b(LONG|SHORT)\b").alias("direction"), pull(r"score=([0-9.]+)").cast("double").alias("score"),
        pull(r"conf=([0-9.]+)").cast("double").alias("confidence"), pull(r"pnl=(-?[0-9.]+)").cast("double").alias("pnl"),
    ).filter("kind is not null")


def filter_counts(events: DataFrame) -> DataFrame:
    """Accepted, rejected, adjusted and break-even counts with the accept rate."""
    n = lambda k: F.count_if(F.col("kind") == k)
    total = n("accept") + n("reject")
    return events.agg(
        n("accept").alias("accepted"), n("reject").alias("rejected"), n("tp_adjusted").alias("tp_adjusted"), n("be_triggered").alias("be_triggered"),
        F.when(total > 0, F.round(n("accept") / total * 100, 1)).otherwise(0.0).alias("rate"),
    )


def freshness(events: DataFrame, as_of: str, group: str = "symbol", limit_seconds: int = 600) -> DataFrame:
    """Age of the last candle and heartbeat per group; stale beyond the limit."""
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("ts")))
    agg = events.groupBy(group).agg(last("candle").alias("last_candle"), last("heartbeat").alias("last_heartbeat"), F.count_if(F.col("kind") == "error").alias("errors"))
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last_candle")
    return agg.withColumn("age_seconds", age).withColumn("stale", F.coalesce(F.col("age_seconds") > limit_seconds, F.lit(True)))


def cluster_parameters(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """Per-symbol parameters: the cluster's values over the defaults."""
    fields = ", ".join(f"{k}: double" for k in defaults)
    schema = f"clusters map<string, struct<{fields}>>, symbol_to_cluster map<string, string>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    clusters = doc.select(F.explode("clusters").alias("cluster", "p"))
    symbols = doc.select(F.explode("symbol_to_cluster").alias("symbol", "cluster"))
    joined = symbols.join(F.broadcast(clusters), "cluster", "left")
    return joined.select("symbol", "cluster", *[F.coalesce(f"p.{k}", F.lit(v)).alias(k) for k, v in defaults.items()])


def schema_differences(spark: SparkSession, have: list[str], wanted: list[str]) -> DataFrame:
    """Names only in one of two feature lists."""
    table = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    a, b = table(have), table(wanted)
    return a.exceptAll(b).withColumn("side", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def common_features(spark: SparkSession, a: list[str], b: list[str]) -> DataFrame:
    table = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    return table(a).intersect(table(b))
