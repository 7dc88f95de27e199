import math
import random
from collections import Counter, defaultdict

import pytest

from tapeline.llm import quality


def model(texts):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    tables = {3: Counter(), 2: Counter(), 1: Counter()}
    for t in texts:
        b = b"\0\0" + t.encode()
        tables[3].update(b[i : i + 3] for i in range(len(b) - 2))
    for n in (2, 1):
        tables[n].update(g[1:] for g in tables[n + 1])
    cuts, contexts = {}, {}
    for n, t in tables.items():
        k = Counter(t.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        cuts[n] = {i: (max(0.0, min(i - 0.05, i - (i + 1) * y * k[i + 1] / k[i])) if y is not None and k[i] else i / 2) for i in (1, 2, 3)}
        contexts[n] = defaultdict(list)
        for g, c in t.items():
            contexts[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 256
        n = len(g)
        seen = contexts[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        c, cut = tables[n][g], cuts[n]
        saved = sum(cut[min(x, 3)] for x in seen)
        return (c - (cut[min(c, 3)] if c else 0) + saved * p(g[1:])) / sum(seen)

    return lambda t: -sum(math.log2(p((b"\0\0" + t.encode())[i : i + 3])) for i in range(len(t.encode())))


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(4)
    words = ["open", "close", "long", "short", "stop", "größe", "été", "signal"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60]))), "en" if i % 3 else "de") for i in range(120)]
    rows += [(200 + i, "".join(rng.choice("#$%&!0Zq") for _ in range(200)), "en") for i in range(10)]
    rows += [(300, None, "en"), (301, "", None), (302, "x", None), (None, "open close", "de"), (5, "a second text of one id", "en"), (303, "stop " * 30000, "fr")]
    return rows


@pytest.mark.parametrize("block", [1 << 24, 1500])
def test_equals_the_definition(spark, logs, block):
    df = spark.createDataFrame([(*r, 1.0) for r in logs], "log_id long, message string, lang string, bits double")
    trusted = spark.createDataFrame([(i,) for i in range(120) if i % 2] + [(7,), (None,), (9999,)], "log_id long")
    bits = model([t for i, t, _ in logs if i is not None and i < 120 and i % 2])
    got = quality.judged(df, trusted, block=block).collect()
    assert Counter((r.log_id, r.n_bytes, r.lang) for r in got) == Counter((i, len((t or "").encode()), g) for i, t, g in logs)
    by = {(r.log_id, r.n_bytes): r for r in got}
    for i, t, _ in logs:
        r = by[i, len((t or "").encode())]
        if not t:
            assert r.bits_per_byte is None and r.kept
        else:
            assert r.bits_per_byte == pytest.approx(bits(t) / len(t.encode()), rel=1e-4)
    assert not any(by[200 + i, 200].kept for i in range(10))
    rank = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]
    root = lambda r: math.sqrt(min(r.n_bytes, 400))
    cuts = {}
    good = [r for r in got if r.log_id in {i for i in range(120) if i % 2} and r.n_bytes]
    for key, rows in [(None, good), *((g, [r for r in good if r.lang == g]) for g in ("en", "de"))]:
        middle = rank([r.bits_per_byte for r in rows], 0.5)
        cuts[key] = middle, rank([(r.bits_per_byte - middle) * root(r) for r in rows], 0.994)
    for r in got:
        middle, cut = cuts.get(r.lang, cuts[None])
        if r.n_bytes:
            assert r.threshold == pytest.approx(middle + cut / root(r)) and r.kept == (r.bits_per_byte <= r.threshold)
    assert all(r.kept for r in good)


def test_a_hot_id_is_spread_over_blocks(spark):
    """A third of the rows have one id; the model and every score are those of one block."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["open", "close", "long", "short"]) for _ in range(30))
    rows = [(7 if i % 3 == 0 else i, text(), "en") for i in range(150)]
    df, trusted = spark.createDataFrame(rows, "log_id long, message string, lang string"), spark.createDataFrame([(7,), (8,), (10,)], "log_id long")
    one, many = (Counter((r.log_id, r.message_hash, round(r.bits, 2)) for r in quality.perplexities(df, trusted, block=b).collect()) for b in (1 << 24, 700))
    assert one == many


def test_nothing_trusted_and_nothing_at_all(spark, logs):
    df = spark.createDataFrame(logs, "log_id long, message string, lang string")
    none = spark.createDataFrame([], "log_id long")
    assert all(r.kept for r in quality.judged(df, none).collect())
    assert quality.judged(df.limit(0), none).collect() == []
