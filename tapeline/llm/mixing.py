"""Mixing training-sample sources to target weights by Poisson replication (DataFrame functions only).

A sample is a row of the training set with its ``sample_id`` and its ``source`` (backtest, live, rejected, ...).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of seed and keys: 52 bits, the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("~")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def source_rates(samples: DataFrame, weights: dict[str, float] | None = None, source: str = "source", size: str | None = None, total: float | None = None) -> DataFrame:
    """``source, rate``: the mean repetitions that give each source its share.

    Shares are ``weights`` over their sum, or equal for all sources; a source
    that ``weights`` does not name gets none.  Sizes are rows or the sum of
    column ``size``; ``total`` is the wanted size of the mixture (default: that
    of the input).  Null is a source of its own, named ``~``.  A source whose
    sizes are all null or 0 adds nothing to any share: its rows stay once each.
    """
    key = F.coalesce(F.col(source).cast("string"), F.lit("~")).alias("source")
    amount = F.sum(F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0))) if size else F.count(F.lit(1)).cast("double")
    sizes = materialize(samples.groupBy(key).agg(amount.alias("size")))
    share = F.lit(1.0)
    if weights:
        share = F.coalesce(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("source")], F.lit(0.0))
    shares = sizes.withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))
    whole = shares.agg(F.sum("share").alias("shares"), F.sum("size").alias("sizes"))
    want = F.lit(float(total)) if total is not None else F.col("sizes")
    rate = F.when(F.col("share") > 0, want * (F.col("share") / F.col("shares")) / F.col("size")).when(F.col("size") == 0, F.when(share > 0, 1.0).otherwise(0.0)).otherwise(0.0)
    return shares.crossJoin(F.broadcast(whole)).select("source", rate.alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... up to where the rest is below double precision."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    log_term = F.struct(F.lit(0.0).alias("log"), F.array(F.exp(-rate)).alias("cdf"), F.exp(-rate).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = acc["sum"] + F.exp(log - rate)
        return F.struct(log.alias("log"), F.array_append(acc["cdf"], total).alias("cdf"), total.alias("sum"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), log_term, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(2.0)))


def replicate(samples: DataFrame, weights: dict[str, float] | None = None, sample_id: str = "sample_id", source: str = "source", size: str | None = None, total: float | None = None, seed: int = 11, copy: str = "copy", told_by: str | None = None) -> DataFrame:
    """Every sample as often as a Poisson draw with its source's rate says, in a global random order.

    The draw inverts the distribution at a hash of seed and id, so it does not
    depend on the layout of the input.  Result: the input's columns and
    ``copy`` (from 0).  Rows with the same id get the same number of copies.
    Rows without an id are told apart by the column ``told_by``, and are one
    sample if there is none; the order tells rows of one id apart by it too.
    An empty table stays empty; repeated rows count again.  A column named
    ``copy`` in the input must be avoided by passing another name.  A source
    without any size keeps its rows once, see ``source_rates``.
    """
    if copy in samples.columns:
        raise ValueError(f"column {copy} exists")
    rates = source_rates(samples, weights, source, size, total)
    # A stored table of one row per source: the planner knows its size, and sends it to the rows only if it is small.
    steps = materialize(rates.select(F.col("source").alias("_source"), poisson_steps(F.col("rate")).alias("_cdf")).filter(F.col("_cdf")[0] < 1))
    salts = 64
    name = F.coalesce(F.col(sample_id).cast("string"), *([F.md5(F.col(told_by).cast("string"))] if told_by else []), F.lit("~"))
    salted = steps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = samples.select(
        F.struct("*").alias("_row"),
        F.coalesce(F.col(source).cast("string"), F.lit("~")).alias("_source"),
        uniform(seed, name).alias("_u"),
        F.pmod(F.xxhash64(name), F.lit(salts)).cast("int").alias("_salt"),
        name.alias("_id"),
        (F.xxhash64(told_by) if told_by else F.lit(0)).alias("_apart"),
    )
    times = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    drawn = rows.join(salted, ["_source", "_salt"]).select("_row", "_id", "_apart", times.alias("_n")).filter("_n > 0")
    copies = drawn.select("_row", "_id", "_apart", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(copy))
    mixed = copies.withColumn("_order", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), "_id", "_apart", copy)))
    return mixed.repartition(F.col("_order")).sortWithinPartitions("_order").select("_row.*", copy)


def expected_copies(rate: float, u: float) -> int:
    """The draw of one sample, for tests: how many cumulative probabilities lie at or below ``u``."""
    if rate <= 0:
        return 0
    log, total, k = 0.0, math.exp(-rate), 0
    while total <= u and k < rate + 12 * math.sqrt(rate) + 30:
        k += 1
        log += math.log(rate) - math.log(k)
        total += math.exp(log - rate)
    return k
