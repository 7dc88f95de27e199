import random
from collections import Counter

import numpy as np

from tapeline.llm import toxicity
from tapeline.llm.text import slices


def corpus(n, seed, bad=("vile", "rotten hound", "scum")):
    rng = random.Random(seed)
    words = [a + b for a in "bdfgklmnpr" for b in ("a", "e", "io", "um", "er")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(900, 1)
    texts = spark.createDataFrame([(i, t, 5) for i, t, _ in rows] + [(2000, None, 5), (2001, "", 5), (None, "scum vile", 5), (2002, "Scum, VILE! " * 20000, 5), (3, rows[3][1], 5)], "text_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (2, None)], "text_id long, toxic int")
    weights = toxicity.train(texts, labels)
    got = toxicity.score(texts, weights).collect()
    assert Counter(r.text_id for r in got)[3] == 2 and len(got) == 905
    by = {r.text_id: r for r in got}
    held = [(by[i].predicted, y) for i, _, y in rows if i % 3 == 0]
    assert sum(p == y for p, y in held) > 0.95 * len(held)
    assert by[2002].predicted == 1 and by[None].score > by[2001].score == by[2000].score and by[2001].predicted == 0
    assert len(weights[0]) < 2000


def test_no_labels_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "a b")], "text_id long, text string")
    weights = toxicity.train(texts, spark.createDataFrame([], "text_id long, toxic int"))
    assert toxicity.score(texts, weights).first().score == 0.5
    assert toxicity.score(texts.limit(0), weights).collect() == []


def test_features_of_a_row_do_not_depend_on_its_neighbours(spark):
    import pyarrow as pa

    texts = ["one two three four", "", "five", "Six seven, one two three"]
    together = next(slices([pa.RecordBatch.from_pydict({"text": texts})], "text"))
    x, row = toxicity.features(*together[1:])
    for i, t in enumerate(texts):
        alone = next(slices([pa.RecordBatch.from_pydict({"text": [t]})], "text"))
        assert sorted(x[row == i]) == sorted(toxicity.features(*alone[1:])[0])
    assert len(np.unique(x)) > 10
