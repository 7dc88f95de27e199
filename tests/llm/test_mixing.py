import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeline.llm import mixing

SCHEMA = "sample_id long, source string, label_rr double, _n int"


def draws(rows, rates, seed=11):
    out = Counter()
    for row in rows:
        key = "~" if row[0] is None else str(row[0])
        u = int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) / 2**52
        for c in range(mixing.expected_copies(rates["~" if row[1] is None else row[1]], u)):
            out[(*row, c)] += 1
    return out


def test_equals_the_inverted_distribution(spark):
    rows = [(i, "backtest" if i % 3 else "live", float(i), 7) for i in range(900)] + [(None, None, None, None), (5, "backtest", 1.0, 1), (5, "backtest", 1.0, 1)]
    samples = spark.createDataFrame(rows, SCHEMA)
    got = Counter(tuple(r) for r in mixing.replicate(samples).collect())
    n = Counter("~" if r[1] is None else r[1] for r in rows)
    assert got == draws(rows, {s: len(rows) / 3 / c for s, c in n.items()})
    weighted = mixing.replicate(samples, {"live": 3.0, "backtest": 1.0}, total=6000).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in weighted}
    assert set(share) == {"live", "backtest"} and abs(share["live"] / 4500 - 1) < 0.05 and abs(share["backtest"] / 1500 - 1) < 0.1


def test_order_is_mixed_and_repeatable(spark):
    samples = spark.createDataFrame([(i, "live", 0.0, 0) for i in range(2000)], SCHEMA)
    one = [(r.sample_id, r["copy"]) for r in mixing.replicate(samples).collect()]
    two = [(r.sample_id, r["copy"]) for r in mixing.replicate(samples.repartition(7)).collect()]
    assert sorted(one) == sorted(two) and one != sorted(one)


def test_edges(spark):
    assert mixing.replicate(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        mixing.replicate(spark.createDataFrame([], "sample_id long, source string, copy int"))
    zero = spark.createDataFrame([(1, "live", 0.0, 1), (2, "rejected", 0.0, 1)], SCHEMA)
    assert {r.source for r in mixing.replicate(zero, size="label_rr", total=50).collect()} <= {"live", "rejected"}
    none = spark.createDataFrame([(1, "live", 9.0, 1), (2, "rejected", 0.0, 1), (3, "other", None, 1)], SCHEMA)
    rates = {r.source: r.rate for r in mixing.source_rates(none, size="label_rr").collect()}
    assert rates == {"live": 1.0, "rejected": 1.0, "other": 1.0}
    assert {r.source: r.rate for r in mixing.source_rates(none, {"live": 2.0}, size="label_rr").collect()} == {"live": 1.0, "rejected": 0.0, "other": 0.0}


def test_rows_without_an_id_are_told_apart(spark):
    rows = [(None, "live", f"text {i}") for i in range(4000)]
    samples = spark.createDataFrame(rows, "sample_id long, source string, features string")
    got = Counter(r.features for r in mixing.replicate(samples, told_by="features", total=2000).collect())
    assert abs(sum(got.values()) / 2000 - 1) < 0.1 and len(got) > 1200


def test_fused_sources_of_the_project(spark):
    from tapeline.operators import sampling

    part = lambda lo, n: spark.createDataFrame([(lo + i, i * 300, 1.0) for i in range(n)], "sample_id long, s long, label double").select("sample_id", F.timestamp_seconds("s").alias("ts"), "label")
    fused = sampling.fuse(part(0, 300), part(1000, 20), part(2000, 40), "ts", "sample_id")
    got = {r.source: r["count"] for r in mixing.replicate(fused, {"backtest": 1.0}).groupBy("source").count().collect()}
    assert set(got) == {"backtest"}
