import random
from collections import Counter

import numpy as np

from tapeline.llm import langid

PARTS = {"en": ["the", "ing", "tion", "and", "er", "wh"], "de": ["sch", "ung", "lich", "über", "der", "ei"], "fr": ["eau", "que", "été", "les", "oi", "ç"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang := rng.choice(list(PARTS)), rng.choice([4, 30, 200])), lang) for i in range(400)]
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "fr"), (903, text(rng, "de", 20000), None), (None, text(rng, "fr", 50), None), (3, rows[3][1], "en")]
    texts = spark.createDataFrame(rows + extra, "text_id long, text string, lang string")
    model = langid.train(texts.filter("text_id % 4 <> 0 or text_id is null"), most=150)
    assert model[0] == ["de", "en", "fr"]
    got = langid.predict(texts, model).collect()
    by = {r.text_id: r for r in got}
    held = [by[i].lang_pred == g for i, _, g in rows if i % 4 == 0]
    assert sum(held) > 0.95 * len(held) and len(got) == len(rows) + len(extra) and Counter(r.text_id for r in got)[3] == 2
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "fr"]
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learnt_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "abc", None)], "text_id long, text string, lang string")
    model = langid.train(texts)
    assert langid.predict(texts, model).first().lang_pred == "und"
    assert langid.predict(texts.limit(0), model).collect() == []


def test_windows_cover_every_byte():
    sizes = [0, 1, 256, 257, 1000]
    data = np.arange(sum(sizes)) % 251
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    x, row, held = langid.windows(data.astype(np.uint8), offsets)
    for i, n in enumerate(sizes):
        mine = x[row == i]
        assert np.array_equal(mine[mine < 256], data[offsets[i] : offsets[i + 1]]) and held[row == i].sum() == n


def test_gradient():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 257, (40, langid.WINDOW)).astype(np.int16)
    y = (x[:, :50].mean(1) > 128).astype(int)
    net = langid.fit(x, y, 2, epochs=60, batch=40)
    assert (langid.outputs(net, x).argmax(1) == y).mean() > 0.9
