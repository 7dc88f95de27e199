"""Phrases of the bot's log lines that stand together more often than chance, counted with counting quotient filters.

A line is a row of text (``value``, as ``spark.read.text`` gives it) of one ``asset_class``.  Words that occur at least
as often as a phrase must have dense numbers; two or three of them, packed, are permuted by an invertible function, of
which the first part, the quotient, is kept as one bit a run and the rest, the remainder, in full.  So a filter is as
compact as a hash table and yet loses nothing: the words come back by the inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.packing import numbered
from tapeline.llm.text import LOWER, mix, slices, words
from tapeline.session import materialize

# Bytes that end a piece of text; spaces and tabs part the words of a piece.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BREAKS = np.zeros(256, bool)
BREAKS[list(PIECE_ENDS)] = True
APART = BREAKS.copy()
APART[[0x20, 0x09]] = True

#: Words of one chunk, which one filter counts; phrases of one part, which one task merges.
CHUNK, PART = 1 << 20, 1 << 22
ENCODED = "chunk bigint, asset_class string, codes binary, words array<string>, counts array<bigint>"
FILTER = "part bigint, n int, occupied binary, ends binary, remainders binary, counts binary, large array<bigint>"
_ONE, _TWO, _SALT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, np.uint64(0x165667B19E3779F9)


class Permutation:
    """An invertible map of a word number of ``bits`` and a packed pair of twice as many to quotient and remainder."""

    def __init__(self, bits: int):
        self.bits = bits
        self.short, self.long = np.uint64((1 << bits) - 1), np.uint64((1 << 2 * bits) - 1)
        self.inverse = [np.uint64(pow(x, -1, 1 << 2 * bits)) for x in (_ONE, _TWO)]

    def split(self, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = (rest * np.uint64(_ONE)) & self.long
        rest = ((rest ^ (rest >> np.uint64(self.bits))) * np.uint64(_TWO)) & self.long
        quotient = (first + mix(rest)) & self.short
        return quotient, rest ^ (mix(quotient + _SALT) & self.long)

    def unite(self, quotient: np.ndarray, remainder: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = remainder ^ (mix(quotient + _SALT) & self.long)
        first = (quotient - mix(rest)) & self.short
        rest = (rest * self.inverse[1]) & self.long
        return first, ((rest ^ (rest >> np.uint64(self.bits))) * self.inverse[0]) & self.long


def counted(quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys as one with the sum of their counts, in order."""
    order = np.lexsort((remainder, quotient))
    quotient, remainder = quotient[order], remainder[order]
    if not len(order):
        return quotient, remainder, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1])]))
    sums = np.diff(np.append(head, len(order))) if count is None else np.add.reduceat(count[order], head)
    return quotient[head], remainder[head], sums


def packed_filter(quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray, first: int, size: int, bits: int) -> tuple:
    """A filter over ``size`` quotients from ``first``: a bit for each quotient in use, a bit for each slot that ends a run, remainders, counters of one byte (255: see the list)."""
    runs, ends = np.zeros(size, bool), np.ones(len(quotient), bool)
    runs[(quotient - np.uint64(first)).astype(np.int64)] = True
    ends[:-1] = quotient[1:] != quotient[:-1]
    width = -(-2 * bits // 8)
    bytes_ = remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return len(quotient), np.packbits(runs).tobytes(), np.packbits(ends).tobytes(), bytes_.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].tolist()


def unpacked_filter(n: int, occupied: bytes, ends: bytes, remainders: bytes, counts: bytes, large: list[int], first: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8))).astype(np.uint64) + np.uint64(first)
    last = np.unpackbits(np.frombuffer(ends, np.uint8))[:n].astype(np.int64)
    wide = np.zeros((n, 8), np.uint8)
    width = -(-2 * bits // 8)
    wide[:, :width] = np.frombuffer(remainders, np.uint8).reshape(n, width)
    count = np.frombuffer(counts, np.uint8).astype(np.int64)
    count[count == 255] = large
    return runs[np.cumsum(last) - last], wide.view("<u8").reshape(-1).astype(np.uint64), count


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of words of one class: their dictionary with counts, and the words as twice their place in it, plus one at the start of a piece."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 33
    press = zstandard.ZstdCompressor(level=1)
    held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        for name, parts in held.items():
            coded = pa.concat_arrays([p for p, _ in parts]).dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.uint32) * 2 + np.concatenate([s for _, s in parts])
            count = np.bincount(codes >> 1, minlength=len(coded.dictionary))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([name]), pa.array([press.compress(codes.astype("<u4").tobytes())], pa.binary()), one(coded.dictionary), one(pa.array(count.astype(np.int64))),
            ], names=["chunk", "asset_class", "codes", "words", "counts"])
            chunk += 1
        held.clear()

    for rows, data, offsets in slices(batches, "value"):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, APART)
        if not len(starts):
            continue
        broken = np.concatenate([[0], np.cumsum(BREAKS[data])])
        fresh = np.ones(len(starts), np.uint32)
        fresh[1:] = (row[1:] != row[:-1]) | (broken[starts[1:]] > broken[ends[:-1]])
        letters = ~APART[data]
        place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        every = pa.StringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[letters])))
        names = rows.column(rows.schema.get_field_index("asset_class")).dictionary_encode()
        own = names.indices.to_numpy()[row]
        for k in np.unique(own):
            mine = np.flatnonzero(own == k)
            held.setdefault(names.dictionary[int(k)].as_py(), []).append((every.take(pa.array(mine)), fresh[mine]))
        size += len(starts)
        if size >= CHUNK:
            yield from emit()
            size = 0
    yield from emit()


def _filters(chunks: pa.Table, answers: pa.Table, bits: int, cut: int) -> pa.Table:
    """Filters of a chunk, one for each part of the quotients."""
    permute = Permutation(bits)
    out: list[tuple] = []
    for row in chunks.to_pylist():
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), "<u4")
        number = np.zeros(row["size"], np.uint64)
        number[answers.column("place").to_numpy()] = answers.column("id").to_numpy().astype(np.uint64)
        word, fresh = number[codes >> 1], (codes & 1).astype(bool)
        two = (word[:-1] > 0) & (word[1:] > 0) & ~fresh[1:]
        three = two[:-1] & two[1:]
        i, j = np.flatnonzero(two), np.flatnonzero(three)
        width = np.uint64(bits)
        first, rest = np.concatenate([word[i], word[j]]), np.concatenate([word[i + 1] << width, (word[j + 1] << width) | word[j + 2]])
        out += _parts(*counted(*permute.split(first, rest)), bits, cut)
    return _table(out)


def _part(quotient: np.ndarray, remainder: np.ndarray, bits: int, cut: int) -> np.ndarray:
    """The leading ``cut`` bits of quotient and remainder."""
    if cut <= bits:
        return quotient >> np.uint64(bits - cut)
    more = cut - bits
    return (quotient << np.uint64(more)) | (remainder >> np.uint64(2 * bits - more))


def _range(part: int, bits: int, cut: int) -> tuple[int, int]:
    """First quotient of a part and how many it has."""
    return (part << (bits - cut), 1 << (bits - cut)) if cut <= bits else (part >> (cut - bits), 1)


def _parts(quotient: np.ndarray, remainder: np.ndarray, count: np.ndarray, bits: int, cut: int) -> list[tuple]:
    part = _part(quotient, remainder, bits, cut)
    edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    return [(int(part[a]), *packed_filter(quotient[a:b], remainder[a:b], count[a:b], *_range(int(part[a]), bits, cut), bits)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["part", "n", "occupied", "ends", "remainders", "counts", "large"]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _merged(filters: pa.Table, bits: int, cut: int, least: int) -> pa.Table:
    """The filters of one part, from all chunks, as one; its frequent phrases as word numbers."""
    found = [unpacked_filter(*[r[c] for c in ("n", "occupied", "ends", "remainders", "counts", "large")], _range(r["part"], bits, cut)[0], bits) for r in filters.to_pylist()]
    quotient, remainder, count = counted(*[np.concatenate(x) for x in zip(*found, strict=True)])
    often = count >= least
    first, rest = Permutation(bits).unite(quotient[often], remainder[often])
    pair = [rest >> np.uint64(bits), rest & np.uint64((1 << bits) - 1)]
    return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(("w1", "w2", "w3", "a"), (first, *pair, count[often]), strict=True)})


def phrase_counts(lines: DataFrame, value: str = "value", asset_class: str = "asset_class", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases by word numbers ``w1, w2, w3, a`` (``w3`` 0: two words), word numbers ``id, asset_class, word, n``, and totals ``asset_class, n``."""
    rows = lines.select(F.coalesce(F.col(asset_class).cast("string"), F.lit("und")).alias("asset_class"), F.col(value).cast("string").alias("value"))
    chunks = materialize(rows.mapInArrow(_encoded, ENCODED))
    listed = chunks.select("chunk", "asset_class", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry"))
    seen = materialize(listed.groupBy("asset_class", F.col("entry.words").alias("word")).agg(F.sum("entry.counts").alias("n")))
    totals = materialize(seen.groupBy("asset_class").agg(F.sum("n").alias("n")))
    often = seen.filter(F.col("n") >= least).withColumn("all", F.lit(0))
    ids = materialize(numbered(often, "all", "word").select((F.col("rank") + 1).alias("id"), "asset_class", "word", "n"))
    bits = max(1, int(ids.count()).bit_length())
    if bits > 31:
        raise ValueError("more than 2**31 frequent words")
    cut = min(3 * bits, max(0, int((totals.agg(F.sum("n")).first()[0] or 0) * 2 // PART).bit_length()))
    answers = listed.select(F.col("chunk").alias("c"), "place", "asset_class", F.col("entry.words").alias("word")).join(ids, ["asset_class", "word"]).select("c", "place", "id")
    coded = chunks.select("chunk", "codes", F.size("words").alias("size"))
    filters = coded.groupBy("chunk").cogroup(answers.groupBy("c")).applyInArrow(lambda a, b: _filters(a, b, bits, cut), FILTER)
    found = filters.groupBy("part").applyInArrow(lambda t: _merged(t, bits, cut, least), "w1 bigint, w2 bigint, w3 bigint, a bigint")
    return materialize(found), ids, totals


def _score(left: str, right: str) -> Column:
    """floor(1 000 000 a a / (left right)), exact: whole decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(38,0))"
    return F.expr(f"{wide(1_000_000)} * {wide('a')} * {wide('a')} div ({wide(left)} * {wide(right)})")


def collocations(lines: DataFrame, value: str = "value", asset_class: str = "asset_class", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """``asset_class, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of every class.

    Letters A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs.  Of two or three
    words with ``a >= least`` occurrences, the lowest score of its cuts, floor(1e6 a a / (l r)), counts, at ties the
    shorter first part.  A phrase inside a longer one with at least ``share`` percent of its occurrences is left out.
    Ranks go by score, then occurrences, both descending, then by the bytes of the phrase.  Null or empty texts have no
    words, a null class is ``und``, repeated lines count again, an empty table has no phrases; other columns are ignored.
    """
    found, ids, totals = phrase_counts(lines, value, asset_class, least)
    two, three = found.filter("w3 = 0"), found.filter("w3 > 0")
    pairs = two.select(F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("a").alias("f"))
    inside = three.select("a", F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y")))).alias("p"))
    longest = inside.groupBy("p.x", "p.y").agg(F.max("a").alias("longest"))
    held = two.join(longest.withColumnsRenamed({"x": "w1", "y": "w2"}), ["w1", "w2"], "left").filter(F.coalesce(100 * F.col("longest") < share * F.col("a"), F.lit(True)))
    word = lambda i: ids.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("n").alias(f"n{i}"), *(["asset_class"] if i == 1 else []))
    two = held.drop("longest").join(word(1), "w1").join(word(2), "w2").select("asset_class", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), _score("n1", "n2").alias("score"))
    three = three.join(pairs.toDF("w1", "w2", "left"), ["w1", "w2"]).join(pairs.toDF("w2", "w3", "right"), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    cuts = [F.struct(_score(x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "n1", "right"), (2, "left", "n3"))]
    three = three.withColumn("cut", F.array_min(F.array(*cuts))).select("asset_class", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # The best of each of 64 shares of a class first, so that no class is sorted in one task.
    order = "order by score desc, a desc, phrase"
    best = two.unionByName(three).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.expr(f"row_number() over (partition by asset_class, bucket {order})")).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.expr(f"row_number() over (partition by asset_class {order})").cast("bigint")).filter(F.col("rank") <= top)
    return best.join(totals, "asset_class").select("asset_class", "rank", "phrase", "a", "l", "r", "n", "score")
