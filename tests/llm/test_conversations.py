import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import conversations

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows):
    """Report, audit and repaired lines of one conversation, by a search over all edits from each row and state."""
    rows = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows], key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), y[2].encode()))
    faults, seen = [], set()
    for _, r, x in rows:
        body = x.strip(SPACES)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    after = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state):
        options = []
        if i == len(rows) and state in (0, 3):
            options.append((0, "", ()))
        cut = 3 if i < len(rows) and faults[i] == "truncated" else 0
        if i < len(rows):
            c, a, out = best(i + 1, state)
            options.append((c + 4, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                _, r, x = rows[i]
                if state in after.get(r[:1], {}):
                    c, a, out = best(i + 1, after[r[:1]][state])
                    options.append((c + cut, "K" + a, (f"{r}:{x}", *out)))
                for h in "ua":
                    if state in after[h]:
                        c, a, out = best(i + 1, after[h][state])
                        options.append((c + cut + 3, "R" + a, (f"{full[h]}:{x}", *out)))
        else:
            for h in "ua":
                if state in after[h] and state != 3:
                    c, a, out = best(i, after[h][state])
                    options.append((c + 3, "I" + a, (f"{full[h]}:", *out)))
        if i < len(rows):
            for h in "ua":
                if state in after[h]:
                    for c, a, out in inserted(i, after[h][state]):
                        options.append((c + 3, "I" + a, (f"{full[h]}:", *out)))
        return min(options)

    @lru_cache(None)
    def inserted(i, state):
        """All edits of row ``i`` right after an insert, and one more insert."""
        options = []
        cut = 3 if faults[i] == "truncated" else 0
        c, a, out = best(i + 1, state)
        options.append((c + 4, "D" + a, out))
        _, r, x = rows[i]
        if faults[i] not in ("blank", "duplicate"):
            if state in after.get(r[:1], {}):
                c, a, out = best(i + 1, after[r[:1]][state])
                options.append((c + cut, "K" + a, (f"{r}:{x}", *out)))
            for h in "ua":
                if state in after[h]:
                    c, a, out = best(i + 1, after[h][state])
                    options.append((c + cut + 3, "R" + a, (f"{full[h]}:{x}", *out)))
        return options

    cost, audit, lines = best(0, 0)
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(rng, n, ids):
    rows = []
    for i in ids:
        for t in range(n if i == 1 else rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hé.", "ok", "wait!", "why? \n", "", " \t", None, f"row {t}.", f"row {t}", "x "])
            rows.append((i, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("fan", [3, 4096])
def test_equals_the_search(spark, fan):
    rows = table(random.Random(fan), 150, [*range(40), None])
    rows += [(50, 1, "user", "a" * 100_000 + "."), (50, 2, "assistant", "b."), (51, 0, "system", "Be brief."), (52, None, None, None), (53, 4, "user", "x."), (53, 4, "user", "x.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn("at", F.lit(1)).repartition(5)
        done, report = conversations.repair(df, fan=fan)
        found = report.join(conversations.digests(done, report).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).collect()
        lines = conversations.repaired_turns(done).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = defaultdict(list)
    for i, *r in rows:
        by[i].append(tuple(r))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256) for r in found}
    assert len(found) == len(by) and max(r.stretches for r in found) > 9
    for i, r in by.items():
        assert got[i] == brute(r), i
    assert lines == sum(len(re.sub("D", "", g[6])) for g in got.values())


def test_halves_equal_one_row_at_a_time():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 16, 100)
    tree = conversations.Halves(conversations.COST[kind], conversations.RANK[kind], np.zeros(100, np.int64))
    cost, rank = conversations.COST[kind[:1]], conversations.RANK[kind[:1]]
    for k in kind[1:]:
        cost, rank = conversations.joined(cost, rank, conversations.COST[k : k + 1], conversations.RANK[k : k + 1])
    assert (tree.cost == cost).all()
    q = conversations.last_state(tree.cost, tree.rank)
    before, after = tree.crossings(np.zeros(1, np.int64), q)
    assert (before[1:] == after[:-1]).all() and conversations.COST[kind, before, after].sum() == cost[0, 0, q[0]]


def test_empty(spark):
    done, report = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.collect() == [] and conversations.digests(done, report).collect() == []
