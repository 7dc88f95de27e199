"""Secret scan of log messages with corpus-wide ownership frequency (DataFrame functions only).

A message is a row of the bot's log: ``log_id``, ``message``, ``log_file`` (the repository it lies in) and ``account`` (its owner).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

# Kinds in their order, pattern, group that is the secret, least length of that group.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
LIVE = len(KINDS)
SPAN = "struct<start: bigint, kind: int, end: bigint, value: bigint>"


def _found(text: Column, rank: int) -> Column:
    """Spans of one kind: match lengths and the lengths of the pieces between give the places."""
    _, pattern, group, least = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(between, F.lit(1), F.size(whole)).alias("p"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("kind"), end.alias("end"), F.xxhash64(x["v"]).alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(rows, empty, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(empty["spans"])


def base_spans(message: Column) -> Column:
    """All pattern matches of a message in order of place and kind, with the hash of each value."""
    return F.array_sort(F.concat(*[_found(message, k) for k in range(len(KINDS))]))


def candidates(logs: DataFrame, log_id: str = "log_id", message: str = "message", log_file: str = "log_file", account: str = "account") -> DataFrame:
    """Stored rows ``row_id, log_id, log_file, account, base``: one per log row, with its base spans in order of place and kind."""
    t = logs.select(F.col(log_id).alias("log_id"), F.coalesce(F.col(message), F.lit("")).alias("t"), F.col(log_file).cast("string").alias("log_file"), F.col(account).cast("string").alias("account"))
    return materialize(t.select(F.monotonically_increasing_id().alias("row_id"), "log_id", "log_file", "account", base_spans(F.col("t")).alias("base")))


def live_spans(base: DataFrame, max_owners: int = 1, max_files: int = 1) -> DataFrame:
    """``row_id, live``: the spans of each row whose value belongs to one owner.

    A value seen with more than ``max_owners`` accounts or in more than
    ``max_files`` log files is a widely copied example.  Missing accounts and
    files count as one owner of their own.
    """
    each = base.select("row_id", F.coalesce("log_file", F.lit("")).alias("log_file"), F.coalesce("account", F.lit("")).alias("account"), F.explode("base").alias("s"))
    homes = each.select(F.col("s.value").alias("value"), "log_file", "account").distinct()
    seen = homes.groupBy("value").agg(F.count_distinct("account").alias("owners"), F.count_distinct("log_file").alias("files"))
    live = seen.filter((F.col("owners") <= max_owners) & (F.col("files") <= max_files)).select("value")
    mine = each.select("row_id", F.col("s.value").alias("value"), F.col("s.start").alias("start"), F.col("s.end").alias("end")).join(live, "value", "left_semi")
    span = F.struct("start", F.lit(LIVE).alias("kind"), "end", "value")
    return mine.groupBy("row_id").agg(F.array_sort(F.collect_set(span)).cast(f"array<{SPAN}>").alias("live"))


def written(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("live"))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def scan(logs: DataFrame, log_id: str = "log_id", message: str = "message", log_file: str = "log_file", account: str = "account", max_owners: int = 1, max_files: int = 1) -> DataFrame:
    """Spans of secrets per log row: ``log_id, row_id, base, live, spans``.

    ``base`` holds the pattern matches (code points, end exclusive), ``live``
    those whose value only one owner has, ``spans`` both in order.  A null or
    empty message has none; every input row gives one row, repeated ones too.
    """
    base = candidates(logs, log_id, message, log_file, account)
    empty = F.array().cast(f"array<{SPAN}>")
    both = base.join(live_spans(base, max_owners, max_files), "row_id", "left").withColumn("live", F.coalesce("live", empty))
    return both.withColumn("spans", F.array_sort(F.concat("base", "live"))).select("log_id", "row_id", "base", "live", "spans")


def masked(message: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The message with the given spans, in order of start, replaced; overlapping spans are replaced once."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(message, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, kept).otherwise(acc["out"]).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(message, acc["at"].cast("int") + 1, F.length(message)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, tail)).otherwise(message)
