import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeline.llm import packing, tokens


def check(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["bars_held"]))
    for items in held.values():
        at = 0
        for offset, bars in sorted(items):
            assert offset == at
            at += bars
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_length_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = 64
    lengths = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 12), 64, 33]) for _ in range(3000))
    made = packing.plan(lengths, capacity, rounds=200)
    used = Counter()
    for pattern, times in made:
        assert sum(k * v for k, v in pattern.items()) <= capacity and times > 0
        for k, v in pattern.items():
            used[k] += v * times
    assert used == lengths
    bound = max(-(-sum(k * v for k, v in lengths.items()) // capacity), sum(v for k, v in lengths.items() if 2 * k > capacity))
    assert sum(t for _, t in made) <= 1.01 * bound + 1


@pytest.mark.parametrize("lengths, capacity, better", [
    ([random.Random(3).randint(1, 30) for _ in range(500)], 30, 0), ([random.Random(i).choice([26, 34, 40]) for i in range(3000)], 100, 100),
    ([random.Random(i).randint(20, 60) for i in range(4000)], 100, 10), ([5], 5, 0), ([], 5, 0), ([3, 3, 3], 5, 0),
])
def test_plan_lies_between_the_dual_bound_and_best_fit(lengths, capacity, better):
    made, bound = packing.bounded_plan(Counter(lengths), capacity)
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, lengths, 1)
    plain = sum(t for _, t in packing._best_fit([], counts, capacity))
    n = sum(t for _, t in made)
    assert bound <= n <= plain - better and bound >= -(-sum(lengths) // capacity)


def test_pricing_is_the_best_pattern():
    rng = np.random.default_rng(2)
    worth = np.concatenate([[0], rng.random(9)])
    counts = packing.best_value(worth, 9)

    def best(room):
        return max([0.0, *(worth[x] + best(room - x) for x in range(1, room + 1))])

    assert (counts * np.arange(10)).sum() <= 9 and abs((counts * worth).sum() - best(9)) < 1e-12


def test_episodes(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 50)
    rng = random.Random(3)
    rows = [(i, 0, rng.randint(1, 30), "x") for i in range(500)] + [(7, 0, 30, "x"), (7, 0, 30, "x"), (None, None, 4, None), (900, 1, None, "x"), (901, 1, 0, "x")]
    episodes = spark.createDataFrame(rows, "trade_id long, part int, bars_held int, row_id string")
    got = packing.pack_episodes(episodes, capacity=30, rounds=100).collect()
    assert Counter((r.trade_id, r.part, r.bars_held) for r in got) == Counter(r[:3] for r in rows)
    assert all(r.sequence_id is None and r.offset is None for r in got if not r.bars_held)
    n = check([r for r in got if r.bars_held], 30)
    counts = np.zeros(31, np.int64)
    np.add.at(counts, [r[2] for r in rows if r[2]], 1)
    assert n <= sum(t for _, t in packing._best_fit([], counts, 30))
    assert packing.pack_episodes(spark.createDataFrame([], episodes.schema), capacity=30).collect() == []
    with pytest.raises(ValueError):
        packing.pack_episodes(episodes, capacity=20)


def test_token_pieces(spark, lines):
    texts = [(i, t) for i, t in lines] + [(500, "L'été's DON'T i'll 12ab_ß × ÿ"), (501, "<|endoftext|> a"), (502, "naïve Ａ ſ K Σς é"), (503, "a" * 300 + " b"), (504, "a b\x1cc\x85d")]
    got = tokens.token_pieces(spark.createDataFrame(texts, "log_id long, message string"), "word_bpe_49k.json", longest=100).collect()
    plain = tokens.Encoder("word_bpe_49k.json").tokenizer
    want = []
    for i, t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, p, 100 * p, len(x := ids[100 * p : 100 * p + 100]), zlib.crc32(np.array(x, "<u4").tobytes())) for p in range(-(-len(ids) // 100))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    encode = tokens.Encoder("word_bpe_49k.json")
    texts = ["one two three four five", "two six, seven's", "one " + "z" * 60]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [encode.tokenizer.encode(t).ids for t in texts]
