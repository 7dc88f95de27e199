import re

from pyspark.sql import functions as F

from tapeline.llm import secrets

KEY, OTHER = "AKIA" + "Q" * 16, "0123456789abcdef" * 2
ROWS = [
    (1, f"key {KEY} and again {KEY}", "f1", "a"), (2, f"héé😀 {KEY}", "f1", "a"), (3, f"PassWord: '{OTHER}'x", "f2", "b"), (4, f"token={OTHER};", "f3", "c"),
    (5, "password = token = abcdefghijklmnop", "f1", "a"), (6, None, None, None), (7, "", "f1", "a"), (8, "AKIASHORT deadbeef api_key:short", "f1", "a"),
    (9, "secret='zzzzzzzzzzzz' " * 300, "f4", "d"), (None, f"apikey = {'y' * 12}", None, None), (1, f"key {KEY} and again {KEY}", "f1", "a"),
]


def brute(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        out += [(m.start(), rank, m.end(), kind, m.group(group)) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_spans_and_owners(spark):
    logs = spark.createDataFrame(ROWS, "log_id long, message string, log_file string, account string").withColumn("value", F.lit(1))
    got = secrets.scan(logs).select("log_id", secrets.written(F.col("base")).alias("b"), secrets.written(F.col("spans")).alias("s")).collect()
    homes = {}
    for _, t, f, a in ROWS:
        for *_, v in brute(t):
            homes.setdefault(v, set()).add((f, a))
    want = []
    for i, t, _, _ in ROWS:
        base = brute(t)
        live = {(s, 3, e, "live", v) for s, _, e, _, v in base if len(homes[v]) == 1}
        line = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k, _ in sorted(x))
        want.append((i, line(base), line({*base, *live})))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any("live" in w[2] for w in want) and any("assign" in w[2] and "live" not in w[2] for w in want)


def test_masked(spark):
    text = spark.createDataFrame([("ab KEY1 cd KEY2 é",)], "message string")
    spans = F.array(*[F.struct(F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end")) for s, e in ((3, 7), (5, 7), (11, 15))])
    assert text.select(secrets.masked(F.col("message"), spans)).first()[0] == "ab [SECRET] cd [SECRET] é"


def test_empty(spark):
    assert secrets.scan(spark.createDataFrame([], "log_id long, message string, log_file string, account string")).collect() == []
