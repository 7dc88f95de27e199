import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline.llm import minhash
from tapeline.session import small_batches


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k):
    nodes = [(i, shingles(t, k)) for i, t in rows]
    up = list(range(len(nodes)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(nodes):
        for b, (j, y) in enumerate(nodes[:a]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(nodes):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(x), None if i is None else least[root(a)], i is not None and i == least[root(a)]) for a, (i, x) in enumerate(nodes)), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, lines, k):
    logs = spark.createDataFrame([(i, t, 1.0) for i, t in lines], "log_id long, message string, bands double")
    got = sorted((tuple(r)[:4] for r in minhash.near_copies(logs, k=k).collect()), key=str)
    assert got == brute(lines, k)


def test_blocks_of_one_bucket(spark, lines):
    logs = spark.createDataFrame(lines, "log_id long, message string")
    got = sorted((tuple(r)[:4] for r in minhash.near_copies(logs, k=2, block=2).collect()), key=str)
    assert got == brute(lines, 2)


def test_empty(spark):
    assert minhash.near_copies(spark.createDataFrame([], "log_id long, message string")).collect() == []


def test_memory_of_a_worker():
    """Shingles of a large batch are taken a piece at a time, whatever their rows."""
    texts = [" ".join(f"w{i * j % 9973}" for j in range(400)) for i in range(1, 1801)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1800)), pa.array(texts), pa.array(range(1800))], names=["log_id", "message", "message_hash"])
    assert batch.nbytes > 3 << 20
    tracemalloc.start()
    rows = sum(b.num_rows for b in minhash._signed(iter([batch]), 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1800 and peak < 50 << 20


def test_small_batches(spark):
    """Long texts reach workers in batches of a few MB, and the session's limit comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("abcd "), 2000).alias("message")).mapInArrow(sizes, "n bigint")
    with small_batches(spark, "1m"):
        assert max(r.n for r in texts.collect()) < 2 << 20
    assert spark.conf.get(name) == before


def test_members_unlike_the_most_shared_one_are_compared(spark):
    """Two near copies share buckets only with families whose members are unlike them and share more buckets than they do."""
    words = [f"w{i}" for i in range(2000)]
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).clip(max=len(data))
    flat, sizes = minhash.shingle_sets(data, edges, 1)
    assert (sizes == 1).all()
    values = minhash._minima(flat, sizes)
    left, right = list(range(100)), list(range(10, 110))
    rows = [left, right]
    for band in range(minhash.BANDS):
        here = values[:, band * minhash.ROWS : (band + 1) * minhash.ROWS]
        least = here[left].min(axis=0)
        if (least == here[right].min(axis=0)).all():
            held = sorted({left[i] for i in here[left].argmin(axis=0)})
            more = [i for i in range(200, 2000) if (here[i] > least).all()][60 * band % 1700 :][:60]
            rows += [held + more[:i] + more[i + 1 :] for i in range(30)]
    assert len(rows) > 200
    logs = [(i, " ".join(words[j] for j in r)) for i, r in enumerate(rows)]
    got = sorted((tuple(r)[:4] for r in minhash.near_copies(spark.createDataFrame(logs, "log_id long, message string"), k=1, block=64).collect()), key=str)
    assert got[0][0] == 0 and (1, 100, 0, False) in got
    assert got == brute(logs, 1)
