"""Distribution drift between training and live features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.session import materialize

# Drift limits.
MINOR_KS, MAJOR_KS, MINOR_PSI, MAJOR_PSI = 0.10, 0.25, 0.10, 0.25


def tall(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) rows without missing values."""
    t = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value")
    return t.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(train: DataFrame, live: DataFrame, features: list[str]) -> DataFrame:
    """Counts per feature and distinct value on both sides (pre-aggregated)."""
    a = tall(train, features).withColumn("_t", F.lit(1)).withColumn("_l", F.lit(0))
    b = tall(live, features).withColumn("_t", F.lit(0)).withColumn("_l", F.lit(1))
    return a.unionByName(b).groupBy("feature", "value").agg(F.sum("_t").alias("t"), F.sum("_l").alias("l"))


def cumulated(counts: DataFrame, bins: int = 256) -> DataFrame:
    """Per feature and distinct value the cumulative counts ``ct`` and ``cl``; ``counts`` are read twice.

    The value axis is cut at approximate quantiles of the distinct values (a
    sketch of bounded size per feature), so bins hold even numbers of rows
    whatever the outliers.  Bin totals are scanned first, then each bin from
    its own start; the counts are exact.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    # Stored: a sketch may differ when it is made again, and both uses below must cut alike.
    edge = materialize(counts.groupBy("feature").agg(
        F.percentile_approx("value", shares, F.lit(10_000)).alias("_cuts"), F.sum("t").alias("nt"), F.sum("l").alias("nl")
    ))
    rows = counts.join(F.broadcast(edge), "feature").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("value"))))
    rows = rows.drop("_cuts")
    totals = rows.groupBy("feature", "_b").agg(F.sum("t").alias("_bt"), F.sum("l").alias("_bl"))
    before = Window.partitionBy("feature").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "feature", "_b", F.coalesce(F.sum("_bt").over(before), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_bl").over(before), F.lit(0)).alias("_l0")
    )
    w = Window.partitionBy("feature", "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(base, ["feature", "_b"]).select(
        "feature", "value", "t", "l", "nt", "nl", (F.col("_t0") + F.sum("t").over(w)).alias("ct"), (F.col("_l0") + F.sum("l").over(w)).alias("cl")
    )


def ks_statistic(cum: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature."""
    gap = F.abs(F.col("ct") / F.col("nt") - F.col("cl") / F.col("nl"))
    return cum.filter("nt > 0 and nl > 0").groupBy("feature").agg(F.max(gap).alias("ks"))


def train_quantiles(cum: DataFrame, shares: list[float]) -> DataFrame:
    """Exact interpolated quantiles of the training side, as array ``q``.

    The values at the two ranks around each quantile are picked by their
    cumulative counts: one aggregation with map-side combine.
    """
    holds = lambda k: (F.col("ct") - F.col("t") <= k) & (k < F.col("ct"))
    at = lambda p: F.floor((F.col("nt") - 1) * p)
    picks = []
    for i, p in enumerate(shares):
        picks += [F.max(F.when(holds(at(p)), F.col("value"))).alias(f"_a{i}"), F.max(F.when(holds(at(p) + 1), F.col("value"))).alias(f"_z{i}")]
    got = cum.filter("t > 0").groupBy("feature").agg(F.max("nt").alias("nt"), *picks)
    between = lambda i, p: F.col(f"_a{i}") + (F.coalesce(f"_z{i}", f"_a{i}") - F.col(f"_a{i}")) * ((F.col("nt") - 1) * p - at(p))
    return got.select("feature", F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def psi(cum: DataFrame, buckets: int = 10) -> DataFrame:
    """Population stability index on the deciles of the training side.

    Live values outside the training range fall into no bucket.
    """
    cuts = train_quantiles(cum, [i / buckets for i in range(buckets + 1)])
    cuts = cuts.select("feature", F.array_sort(F.array_distinct("q")).alias("_q")).filter(F.size("_q") >= 2)
    bucket = F.least(F.size(F.filter("_q", lambda e: e <= F.col("value"))), F.size("_q") - 1)
    inside = (F.col("value") >= F.col("_q")[0]) & (F.col("value") <= F.element_at("_q", -1))
    hit = cum.join(F.broadcast(cuts), "feature").filter(inside).groupBy("feature", bucket.alias("bucket")).agg(
        F.sum("t").alias("t"), F.sum("l").alias("l")
    )
    all_buckets = cuts.select("feature", F.explode(F.sequence(F.lit(1), F.size("_q") - 1)).alias("bucket"))
    full = all_buckets.join(hit, ["feature", "bucket"], "left").fillna(0, ["t", "l"])
    w = Window.partitionBy("feature")  # one row per bucket: at most ``buckets``
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1))
    fixed = full.withColumns({"e": share("t"), "a": share("l")})
    floor = lambda c: F.when(F.col(c) == 0, 1e-6).otherwise(F.col(c))
    term = (floor("a") - floor("e")) * F.ln(floor("a") / floor("e"))
    return fixed.groupBy("feature").agg(F.sum(term).alias("psi"))


def _moments(counts: DataFrame) -> DataFrame:
    """Mean and population deviation of both sides from the value counts."""
    mean = lambda c: F.sum(F.col("value") * F.col(c)) / F.sum(c)
    means = counts.groupBy("feature").agg(mean("l").alias("live_mean"), mean("t").alias("train_mean"))
    off = counts.join(F.broadcast(means), "feature")
    dev = lambda c, m: F.sqrt(F.sum(F.pow(F.col("value") - F.col(m), 2) * F.col(c)) / F.sum(c))
    return off.groupBy("feature").agg(
        F.first("live_mean").alias("live_mean"), F.first("train_mean").alias("train_mean"),
        dev("l", "live_mean").alias("live_std"), dev("t", "train_mean").alias("train_std"),
    )


def drift_report(train: DataFrame, live: DataFrame, features: list[str], critical: list[str], important: list[str]) -> DataFrame:
    """KS, PSI, means, deviations and severity per feature."""
    # Stored, as the rows behind the counts should be read and added up once.
    cum = materialize(cumulated(materialize(value_counts(train, live, features))))
    out = (
        ks_statistic(cum)
        .join(psi(cum), "feature", "left")
        .join(_moments(cum), "feature")
        .withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    )
    major = (F.col("ks") > MAJOR_KS) | (F.col("psi") > MAJOR_PSI)
    minor = (F.col("ks") > MINOR_KS) | (F.col("psi") > MINOR_PSI)
    rank = F.when(F.col("feature").isin(critical), "critical").when(F.col("feature").isin(important), "important").otherwise("other")
    return out.withColumns({"severity": F.when(major, "MAJOR").when(minor, "MINOR").otherwise("OK"), "importance": rank})


def alert_level(report: DataFrame) -> DataFrame:
    bad = F.col("severity") == "MAJOR"
    crit, imp = F.count_if(bad & (F.col("importance") == "critical")), F.count_if(bad & (F.col("importance") == "important"))
    return report.agg(
        F.count_if(bad).alias("major"), F.count_if(F.col("severity") == "MINOR").alias("minor"),
        F.when(crit > 0, "CRITICAL").when(imp > 0, "WARNING").otherwise("INFO").alias("level"),
    )
