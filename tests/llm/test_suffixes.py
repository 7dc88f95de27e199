import random
from collections import Counter

import pytest

from tapeline.llm import suffixes


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(t) if at < 0 else at
            spans.append((a, at))
        out.append((i, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def logs(length):
    rng = random.Random(11)
    words = ["signal", "größe", "open", "été", "stop", "a", "reject", "long"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    rows = [(i, text(rng.choice([3, 30, 80]))) for i in range(60)]
    for i in range(60, 110):
        t, p = text(rng.randrange(60)), rng.choice(shared)
        a = rng.randrange(0, len(p) - 80)
        rows.append((i, t + p[a : a + rng.choice([length // 2, length - 1, length, length + 1, 2 * length])] + text(rng.randrange(20))))
    for i in range(110, 130):
        base = list(rows[rng.randrange(60)][1])
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = "#"
        rows.append((i, "".join(base)))
    rows += [(130, None), (131, ""), (132, "x"), (133, "ab" * 2000), (134, "line of a log\n" * 40), (5, rows[5][1]), (None, rows[6][1]), (135, text(3000)), (136, "z" * length), (137, "q" * (length + 1))]
    return rows


@pytest.mark.parametrize("length", [200, 80])
def test_equals_brute_force(spark, length):
    rows = logs(length)
    df = spark.createDataFrame([(*r, 0) for r in rows], "log_id long, message string, core int").repartition(3)
    got = suffixes.repeated_passages(df, length=length).collect()
    assert sorted(((r.log_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=str) == brute(rows, length)


def test_levels_double(spark):
    index = suffixes.SuffixIndex()
    found = []
    for b in range(5):
        batch = spark.createDataFrame([(x,) for x in (b, b + 100, 7 if b in (0, 3) else b + 200)], "core long")
        found.append(sorted(r.core for r in index.add(batch).collect()))
    assert found == [[], [], [], [7], []] and sorted(index.levels) == [0, 2]
    assert [sum(r.n for r in index.levels[k].collect()) for k in (0, 2)] == [3, 12]


def test_empty(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], "log_id long, message string")).collect() == []
    with pytest.raises(ValueError):
        suffixes.repeated_passages(spark.createDataFrame([], "log_id long, message string"), length=70)
