"""Quality of log messages by an interpolated modified Kneser-Ney model of byte trigrams.

A message is a row of the bot's log with ``log_id``, ``message`` and ``lang``; trusted messages are named by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.text import slices
from tapeline.session import materialize

#: Bytes of text whose trigrams are counted, asked for and scored together.
BLOCK = 1 << 24
GRAMS = 1 << 24
#: Bytes of text that are taken apart at a time.
PIECE = 1 << 22
#: Blocks over which the rows of one id are spread.
SHARES = 16
PACK = "block int, ids array<bigint>, langs array<string>, hashes array<bigint>, sizes array<int>, packed binary"


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The trigram that ends at each byte; before the start of a row stand zeros."""
    wide = data.astype(np.int32)
    one, two = np.zeros_like(wide), np.zeros_like(wide)
    one[1:], two[2:] = wide[:-1], wide[:-2]
    start = offsets[:-1][offsets[1:] > offsets[:-1]]
    one[start] = two[start] = 0
    second = start + 1
    second = second[second < len(wide)]
    two[second] = 0
    return (two << 16) | (one << 8) | wide


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one block together and compressed, so that the shuffle is small."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        batch = batch.take(pa.array(order))
        block = block[order]
        for part, data, offsets in slices([batch], "message", PIECE):
            own = part.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            ids, langs, hashes, sizes = part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), np.diff(offsets).astype(np.int32)
            out = [(int(own[a]), ids[a:b], langs[a:b], hashes[a:b], sizes[a:b].tolist(), press.compress(data[offsets[a] : offsets[b]].tobytes())) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "ids", "langs", "hashes", "sizes", "packed"])


def _rows(packs: pa.Table) -> Iterator[tuple[list, list, list, np.ndarray, np.ndarray]]:
    """Ids, languages, hashes, bytes and offsets of each pack."""
    for row in (r for b in packs.to_batches(max_chunksize=16) for r in b.to_pylist()):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["packed"]), np.uint8) if sum(row["sizes"]) else np.zeros(0, np.uint8)
        yield row["ids"], row["langs"], row["hashes"], data, np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])


def _counted(packs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Distinct trigrams of a block with their number in its trusted texts."""
    good = set(trusted.column("log_id").to_pylist())
    seen, count = np.zeros(GRAMS, bool), np.zeros(GRAMS, np.int32)
    for ids, _, _, data, offsets in _rows(packs):
        g = grams(data, offsets)
        seen[g] = True
        mine = np.repeat(np.array([i in good for i in ids]), np.diff(offsets))
        at, n = np.unique(g[mine], return_counts=True)
        count[at] += n.astype(np.int32)
    at = np.flatnonzero(seen)
    block = packs.column("block")[0].as_py() if packs.num_rows else 0
    return pa.table({"block": pa.array(np.full(len(at), block, np.int32)), "gram": pa.array(at.astype(np.int32)), "n": pa.array(count[at].astype(np.int64))})


def _scored(packs: pa.Table, answers: pa.Table) -> pa.Table:
    cost = np.zeros(GRAMS, np.float32)
    cost[answers.column("gram").to_numpy()] = answers.column("bits").to_numpy()
    out: list[tuple] = []
    for ids, langs, hashes, data, offsets in _rows(packs):
        sums = np.concatenate([[0.0], np.cumsum(cost[grams(data, offsets)], dtype=np.float64)])
        bits = sums[offsets[1:]] - sums[offsets[:-1]]
        out += zip(ids, langs, hashes, np.diff(offsets).tolist(), bits.tolist(), strict=True)
    columns = list(zip(*out, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("log_id", "lang", "message_hash", "n_bytes", "bits"), columns, kinds, strict=True)})


def _interpolated(count: Column, total: Column, ones: Column, twos: Column, more: Column, d: Column, lower: Column) -> Column:
    """Modified Kneser-Ney: a discount by count, and what it saves times the lower order."""
    cut = F.when(count >= 3, d["d3"]).when(count == 2, d["d2"]).when(count == 1, d["d1"]).otherwise(0.0)
    saved = d["d1"] * ones + d["d2"] * twos + d["d3"] * more
    return F.when(F.coalesce(total, F.lit(0)) > 0, (count - cut + saved * lower) / total).otherwise(lower)


def _context(rows: DataFrame, key: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    return rows.groupBy(key).agg(F.sum("n").alias("total"), n(F.col("n") == 1).alias("ones"), n(F.col("n") == 2).alias("twos"), n(F.col("n") >= 3).alias("more"))


def _discounts(rows: DataFrame, name: str) -> DataFrame:
    """One row: discounts of counts 1, 2 and over from the counts of counts, kept between 0 and the count."""
    k = rows.agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"k{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("k1"), F.col("k1") + 2 * F.col("k2"))

    def cut(i: int) -> Column:
        value = i - (i + 1) * y * F.col(f"k{i + 1}") / F.col(f"k{i}")
        return F.when((F.col(f"k{i}") > 0) & y.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(i - 0.05), value))).otherwise(i / 2)

    return k.select(F.struct(*[cut(i).alias(f"d{i}") for i in (1, 2, 3)]).alias(name))


def trigram_bits(counts: DataFrame) -> DataFrame:
    """``gram, bits`` (minus the logarithm of its last byte's probability) of every row ``gram, n``; ``n`` may be 0."""
    seen = counts.filter("n > 0")
    pairs = seen.groupBy((F.col("gram") % 65536).alias("pair")).agg(F.count(F.lit(1)).alias("n"))
    single = pairs.groupBy((F.col("pair") % 256).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.withColumn("mid", F.floor(F.col("pair") / 256).cast("int"))
    d = _discounts(seen, "e3").crossJoin(F.broadcast(_discounts(pairs, "e2"))).crossJoin(F.broadcast(_discounts(single, "e1"))).crossJoin(F.broadcast(_context(single.withColumn("all", F.lit(1)), "all").agg(F.struct(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("total", "ones", "twos", "more")]).alias("t1"))))
    named = lambda df, key, to: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(to))
    # Tables of at most 2**16 and 2**8 rows, whatever the corpus.
    rows = counts.select("gram", "n", F.floor(F.col("gram") / 256).cast("int").alias("front"), (F.col("gram") % 65536).alias("pair"), F.floor(F.col("gram") % 65536 / 256).cast("int").alias("mid"), (F.col("gram") % 256).alias("last"))
    rows = rows.join(F.broadcast(named(_context(seen.withColumn("front", F.floor(F.col("gram") / 256).cast("int")), "front"), "front", "t3")), "front", "left")
    rows = rows.join(F.broadcast(pairs.select("pair", F.col("n").alias("n2"))), "pair", "left").join(F.broadcast(named(_context(pairs, "mid"), "mid", "t2")), "mid", "left")
    rows = rows.join(F.broadcast(single.withColumnRenamed("n", "n1")), "last", "left").crossJoin(F.broadcast(d))
    p = F.lit(1 / 256)
    for n, t, e in (("n1", "t1", "e1"), ("n2", "t2", "e2"), ("n", "t3", "e3")):
        p = _interpolated(F.coalesce(n, F.lit(0)), F.col(f"{t}.total"), F.col(f"{t}.ones"), F.col(f"{t}.twos"), F.col(f"{t}.more"), F.col(e), p)
    return rows.select("gram", (-F.log2(p)).cast("float").alias("bits"))


def perplexities(logs: DataFrame, trusted: DataFrame, log_id: str = "log_id", message: str = "message", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """``log_id, lang, message_hash, n_bytes, bits`` of every message under the model of the trusted ones.

    Texts are shuffled once, compressed, to blocks of about ``block`` bytes.  A
    block asks for its distinct trigrams only; counts, contexts and answers are
    joined by trigram, and the answers go back to the block.
    """
    text = F.col(message).cast("string")
    blocks = max(1, -(-int(logs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block))
    number = F.col(log_id).cast("bigint")
    # Rows of one id lie in up to SHARES blocks, by their text; a trusted id is named in all of them.
    shares = min(blocks, SHARES)
    first = F.pmod(F.xxhash64(number), F.lit(blocks))
    spread = F.when(number.isNull(), F.pmod(F.xxhash64(text), F.lit(blocks))).otherwise(F.pmod(first + F.pmod(F.xxhash64(text), F.lit(shares)), F.lit(blocks))).cast("int")
    packs = logs.select(spread.alias("block"), number.alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("hash"), text.alias("message")).mapInArrow(_packed, PACK)
    good = trusted.select(F.col(log_id).cast("bigint").alias("log_id")).filter("log_id is not null").distinct()
    good = good.select("log_id", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("k"))
    good = good.select(F.pmod(F.pmod(F.xxhash64("log_id"), F.lit(blocks)) + F.col("k"), F.lit(blocks)).cast("int").alias("block"), "log_id")
    # Stored once: the model reads the counts many times, the texts are counted once.
    counted = materialize(packs.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_counted, "block int, gram int, n bigint"))
    bits = trigram_bits(materialize(counted.groupBy("gram").agg(F.sum("n").alias("n"))))
    answers = counted.select("block", "gram").join(bits, "gram")
    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, "log_id bigint, lang string, message_hash bigint, n_bytes bigint, bits double")


def judged(logs: DataFrame, trusted: DataFrame, log_id: str = "log_id", message: str = "message", lang: str = "lang", quantile: float = 0.994, settled: int = 400, block: int = BLOCK) -> DataFrame:
    """``log_id, lang, message_hash, n_bytes, bits_per_byte, perplexity, threshold, kept`` of every message.

    The bits a byte of a short message scatter more, as one over the root of
    its length up to ``settled`` bytes.  A language's cut is the ``quantile`` of
    its trusted messages' distances from their median, each times that root;
    ``threshold`` is the median plus the cut over the root of the message's own
    length, and a message above it is rejected.  A language without trusted
    messages takes the median and cut of all, null is a language of its own.
    Null and empty messages have no perplexity and are kept: nothing speaks
    against them.  Repeated rows are judged alike and counted each.  Without
    trusted messages all are kept.
    """
    root = F.sqrt(F.least(F.col("n_bytes"), F.lit(settled)).cast("double"))
    scores = materialize(perplexities(logs, trusted, log_id, message, lang, block)).withColumn("rate", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))).withColumn("key", F.coalesce("lang", F.lit("")))
    good = scores.join(trusted.select(F.col(log_id).cast("bigint").alias("log_id")).distinct(), "log_id", "left_semi").filter("rate is not null")
    middle = F.percentile_approx("rate", F.lit(0.5), F.lit(10000))
    cut = F.percentile_approx((F.col("rate") - F.col("middle")) * root, F.lit(quantile), F.lit(10000))
    middles = materialize(good.groupBy("key").agg(middle.alias("middle")))
    own = materialize(good.join(middles, "key").groupBy("key").agg(F.max("middle").alias("own_middle"), cut.alias("own_cut")))
    center = good.agg(middle.alias("all_middle"))
    every = good.crossJoin(F.broadcast(center)).withColumnRenamed("all_middle", "middle").agg(F.max("middle").alias("all_middle"), cut.alias("all_cut"))
    out = scores.join(own, "key", "left").crossJoin(F.broadcast(every))
    out = out.withColumn("threshold", F.coalesce("own_middle", "all_middle") + F.coalesce("own_cut", "all_cut") / F.when(F.col("n_bytes") > 0, root))
    kept = ~F.coalesce(F.col("rate") > F.col("threshold"), F.lit(False))
    return out.select("log_id", "lang", "message_hash", "n_bytes", F.col("rate").alias("bits_per_byte"), F.pow(F.lit(2.0), "rate").alias("perplexity"), "threshold", kept.alias("kept"))
