import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import phrases
from tapeline.sources import files


def brute(rows, least=10, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for value, name in rows:
        name = name if name is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (value or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[name] += len(w)
            for k in (1, 2, 3):
                f[name].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for name, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in count.items() if b >= least and len(p) == 2):
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((name, rank, p.decode(), -a, left, right, n[name], -score))
    return out


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(2)
    words = ["NEAR-MISS", "alignment", "Close", "größe", "ÉTÉ", "pnl=1", "the", "|", "trade", "open"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " : ", "\r"]) for _ in range(n))
    rows = [(text(rng.choice([0, 1, 4, 90])), rng.choice(["crypto", "crypto", None])) for _ in range(150)]
    rows += [("wick fill zone", "stocks")] * 40 + [("wick fill", "stocks")] * 45 + [("a b c", "metals")] * 10 + [("b c", "metals")] * 9
    return rows + [(None, "crypto"), ("", "forex"), (" \t\n", None), (text(20000), "forex"), ("once only", "rare")]


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_equals_plain_counting(spark, lines, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "PART", 1 << 9 if chunk == 500 else 1 << 22)
    df = spark.createDataFrame(lines, "value string, asset_class string").withColumn("n", F.lit("x")).withColumn("rank", F.lit(0)).repartition(3)
    got = phrases.collocations(df, top=25).select("asset_class", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(brute(lines, top=25))
    assert {r.asset_class for r in got} == {"crypto", "forex", "und", "stocks", "metals"}


def test_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for bits in (1, 2, 7, 21, 31):
        permute = phrases.Permutation(bits)
        first, rest = (rng.integers(0, 1 << k, 4000).astype(np.uint64) for k in (bits, 2 * bits))
        q, r = permute.split(first, rest)
        assert q.max() < 1 << bits and r.max() < 1 << (2 * bits)
        back = permute.unite(q, r)
        assert (back[0] == first).all() and (back[1] == rest).all()
        for cut in {0, 1, bits, min(3 * bits, bits + 3)}:
            q1, r1, count = phrases.counted(q, r, rng.integers(1, 600, 4000))
            parts = phrases._parts(q1, r1, count, bits, cut) if bits < 22 or cut > 10 else []
            found = [phrases.unpacked_filter(*p[1:], phrases._range(p[0], bits, cut)[0], bits) for p in parts]
            for have, want in zip(zip(*found, strict=True), (q1, r1, count), strict=False):
                assert (np.concatenate(have) == want).all()


def test_a_small_space_is_counted_in_full():
    permute = phrases.Permutation(3)
    every = np.arange(512, dtype=np.uint64)
    q, r = permute.split(every >> np.uint64(6), every & np.uint64(63))
    assert len(set(zip(q.tolist(), r.tolist(), strict=True))) == 512


def test_log_lines_of_the_project(spark, tmp_path):
    (tmp_path / "bot.log").write_text("2026-01-01 00:00:00 INFO XGB REJECT [BTCUSDT] LONG score=0.4\n" * 12)
    lines = spark.read.text(str(tmp_path / "bot.log"))
    assert files.log_events(lines).count() == 12
    got = phrases.collocations(lines.withColumn("asset_class", F.lit("crypto"))).collect()
    assert [(r.a, r.score) for r in got if r.phrase == "xgb reject [btcusdt]"] == [(12, 1_000_000)]


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "value string, asset_class string")).collect() == []
