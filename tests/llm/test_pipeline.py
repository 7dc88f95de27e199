"""The corpus pipeline on a small table, stage by stage against plain restatements."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_brute
from test_mixing import draws
from test_quality import model
from test_secrets import brute as secret_brute

import corpus_pipeline as P
from tapeline.llm import tokens

KEY = "AKIA" + "Q" * 16
TRUSTED = [*range(60), 136, 137, 201, 202, 203]


@pytest.fixture(scope="module")
def tables(spark, lines, tmp_path_factory):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 20 else None, len(t or "")) for i, t in lines]
    rows += [(200, "#$%&" * 60 + "0Zq!" * 30, "en", "s0", 360), (201, f"the key {KEY} of one", "en", "s1", 30), (202, f"token = {'y' * 20} here", "en", "s1", 33), (203, f"again token = {'y' * 20}", "en", "s2", 34)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in TRUSTED] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows, str(at)


def test_stages(spark, tables, tmp_path):
    rows, at = tables
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, at).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert n == 4 or docs.columns == P.COLUMNS
        kept.append([tuple(r) for r in docs.collect()])
    quality, near, secret, mixed, packed = kept

    bits = model([r[1] for r in rows if r[0] in TRUSTED and r[1]])
    assert Counter(rows) - Counter(quality) == Counter([rows[-4]]) and bits(rows[-4][1]) > 5 * len(rows[-4][1])

    names = {i for i, _, c, k in near_brute([(r[0], r[1]) for r in quality], 5) if k}
    assert {r[0] for r in near} == names | {None} and Counter(near) == Counter({r: 1 for r in quality if r[0] in names or r[0] is None})

    homes = defaultdict(set)
    for r in near:
        for *_, v in secret_brute(r[1]):
            homes[v].add(r[3])
    want = []
    for r in near:
        text, shift = r[1], 0
        for s, _, e, _, v in secret_brute(r[1]):
            if len(homes[v]) == 1:
                text = text[: s + shift] + "[SECRET]" + text[e + shift :]
                shift += 8 - (e - s)
        want.append((r[0], text, r[2], r[3], len(text) if text != r[1] else r[4]))
    assert Counter(secret) == Counter(want) and sum("[SECRET]" in (r[1] or "") for r in secret) == 1

    size = Counter()
    for r in secret:
        size[r[3] or "~"] += r[4]
    total, n = sum(size.values()), sum(v > 0 for v in size.values())
    rates = {s: (total / n / v if v else 1.0) for s, v in size.items()}
    drawn = draws([(r[0] if r[0] is not None else hashlib.md5(r[1].encode()).hexdigest(), r[3], r) for r in secret], rates)
    assert Counter(mixed) == Counter(k[2] for k in drawn.elements())

    ids = tokens.Encoder("word_bpe_49k.json").tokenizer
    pieces = Counter()
    for r in mixed:
        x = ids.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(x) // 2048)):
            y = x[2048 * p : 2048 * p + 2048]
            pieces[r[0], p, 2048 * p, len(y), zlib.crc32(np.array(y, "<u4").tobytes())] += 1
    assert Counter(r[:5] for r in packed) == pieces
    held = defaultdict(list)
    for r in packed:
        held[r[5]].append((r[6], r[3]))
    for items in held.values():
        place = 0
        for offset, length in sorted(items):
            assert offset == place
            place += length
        assert place <= 2048
    assert sorted(tuple(r) for r in P.run(spark, at).select("doc_id", "piece", "length").na.fill(-1).collect()) == sorted((-1 if r[0] is None else r[0], r[1], r[3]) for r in packed)


def test_empty(spark, tables, tmp_path):
    _, at = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, at)
        assert docs.collect() == []


def test_extra_columns_of_any_name(spark, tables):
    """Further columns, named as those that the stages use inside, change nothing."""
    _, at = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").filter("doc_id < 40 or doc_id >= 200 or doc_id is null")
    more = docs.withColumns({c: F.lit(1) for c in ("i", "l", "h", "b", "b0", "live", "base", "masked", "copy", "log_id", "message_hash", "row_id", "kept", "sequence_id")})
    for name, stage in P.STAGES[:3]:
        assert sorted(map(str, stage(spark, more, at).collect())) == sorted(map(str, stage(spark, docs, at).collect())), name
    for _, stage in P.STAGES[3:]:
        assert stage(spark, more, at).count() == stage(spark, docs, at).count()


def test_rejected_rows_take_no_others_along(spark, tables):
    """Rows of one id, or of none, that are as long as a rejected one stay."""
    rows, at = tables
    junk, clean = rows[-4][1], " ".join(rows[0][1] for _ in range(99))[:360]
    more = [(i, t, "en", "s0", len(t)) for i in (None, 400) for t in (junk, clean)]
    assert len(junk) == len(clean)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = P.quality_stage(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), at).collect()
    found = Counter(tuple(r) for r in got)
    assert all(found[r] == (r[1] == clean) for r in more)
