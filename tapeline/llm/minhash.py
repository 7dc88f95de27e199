"""Near copies of log messages by b-bit MinHash.

A message is a row of the bot's log with ``log_id`` and ``message``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import graph
from tapeline.llm.bloom import Bloom
from tapeline.llm.text import LOWER, Prints, mix, slices, words
from tapeline.session import materialize, small_batches

BANDS, ROWS, BITS = 32, 5, 2
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_TERMS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))
#: Estimates this far below the limit are still confirmed: over five standard deviations of the estimate.
SLACK = 0.22
#: Least estimate of a pair that puts both into one group.
GROUPED = 0.4
#: Bytes of text whose shingles are taken at a time; a worker needs some forty times as much.
PIECE = 1 << 19
#: Rows of buckets that are dealt to a task together, and pairs that are estimated at a time there.
LOT, PAIRS = 1 << 13, 1 << 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of the rows, one after another, and the set sizes.

    A row of fewer than ``k`` words has its whole sequence as one shingle.
    """
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    prints = Prints(data)(starts, ends)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    running = np.zeros(max(0, len(prints) - k + 1), np.uint64)
    for j in range(k if len(running) else 0):
        running = mix(running * np.uint64(3) + prints[j : j + len(running)])
    sets = []
    for i in range(n):
        if count[i] >= k:
            sets.append(np.unique(running[first[i] : first[i + 1] - k + 1]))
        elif count[i]:
            short = np.zeros(1, np.uint64)
            for j in range(count[i]):
                short = mix(short * np.uint64(3) + prints[first[i] + j : first[i] + j + 1])
            sets.append(mix(short + np.uint64(int(count[i]))))
        else:
            sets.append(prints[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else prints[:0], sizes


def _set_prints(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    edge = np.concatenate([[0], np.cumsum(sizes)])
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(flat + np.uint64(salt)))]) for salt in (17, 0x5851F42D4C957F2D)]
    return tuple((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)


def _minima(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minima of every hash function by row (upper 32 bits); rows without shingles have the largest value."""
    out = np.full((len(sizes), len(_FACTORS)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        edge = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for j, (a, b) in enumerate(zip(_FACTORS, _TERMS, strict=True)):
            out[full, j] = np.minimum.reduceat(flat * a + b, edge) >> np.uint64(32)
    return out


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "message", PIECE):
        flat, sizes = shingle_sets(data, offsets, k)
        one, two = _set_prints(flat, sizes)
        least = _minima(flat, sizes)
        low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
        bits = np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(sizes), -1), axis=1)
        band = np.zeros((len(sizes), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            band = mix(band * np.uint64(5) + least[:, j::ROWS].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([
            rows.column(0), rows.column(2), pa.array(sizes), pa.array(one), pa.array(two), pa.array([x.tobytes() for x in bits], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
        ], names=["log_id", "message_hash", "n_shingles", "f1", "f2", "bits", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches, "message", PIECE):
        flat, sizes = shingle_sets(data, offsets, k)
        one, two = _set_prints(flat, sizes)
        ends = np.cumsum(sizes)
        packed = [flat[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(packed, pa.binary())], names=["f1", "f2", "shingles"])


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def similar(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: share of equal values, less the share that chance makes equal."""
    differ = left ^ right
    any_bit = differ.copy()
    for shift in range(1, BITS):
        any_bit |= differ << np.uint8(shift)
    top = np.uint8(sum(1 << (8 - 1 - BITS * i) for i in range(8 // BITS)))
    equal = 1 - _ones(any_bit & top) / (BANDS * ROWS)
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def _matrix(column: pa.Array) -> np.ndarray:
    width = BANDS * ROWS * BITS // 8
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        value = similar(_matrix(b.column(2)), _matrix(b.column(3)))
        keep = pa.array(value >= GROUPED)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(value).filter(keep)], names=["a", "b", "estimate"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def _met(table: pa.Table, least: float) -> pa.Table:
    """Pairs of the buckets dealt together whose estimate is at least ``least``: members that ask, with all asked ones of the same block and another label."""
    table = table.sort_by([("group", "ascending"), ("q", "ascending"), ("d", "ascending")])
    node, label, asks = (table.column(c).to_numpy() for c in ("node", "label", "asks"))
    bits = _matrix(table.column("bits").combine_chunks())
    keys = np.stack([table.column(c).to_numpy() for c in ("group", "q", "d")])
    edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
    block = np.searchsorted(edges, np.arange(len(node)), "right") - 1
    asking = np.flatnonzero(asks)
    many = np.cumsum(np.diff(edges)[block[asking]])
    a, b, estimate = [node[:0]], [node[:0]], [np.zeros(0)]
    for some in np.split(asking, np.flatnonzero(np.diff(many // PAIRS)) + 1):
        width = np.diff(edges)[block[some]]
        i = np.repeat(some, width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + edges[block[i]]
        apart = ~asks[j] & (label[i] != label[j])
        i, j = i[apart], j[apart]
        value = similar(bits[i], bits[j])
        i, j, value = (x[value >= least] for x in (i, j, value))
        a.append(np.minimum(node[i], node[j]))
        b.append(np.maximum(node[i], node[j]))
        estimate.append(value)
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "estimate": np.concatenate(estimate)})


class _Forest:
    """Which labels have met."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Links between a block of open members and a block of their group that join different components; one for each join."""
    node, label, asks = (table.column(c).to_numpy() for c in ("node", "label", "asks"))
    bits = _matrix(table.column("bits").combine_chunks())
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    given = np.flatnonzero(~asks)
    forest, a, b = _Forest(), [], []
    for i in np.flatnonzero(asks):
        near = given[(similar(bits[i][None, :], bits[given]) >= percent / 100 - SLACK) & (label[given] != label[i])]
        near = near[[forest.root(x) != forest.root(label[i]) for x in label[near]]] if len(near) else near
        if not len(near):
            continue
        flat, mine = np.concatenate([sets[j] for j in near]), sets[i]
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        shared = np.add.reduceat(mine[at] == flat, np.concatenate([[0], np.cumsum(sizes[near])[:-1]]), dtype=np.int64)
        for j in near[100 * shared >= percent * (sizes[near] + len(mine) - shared)]:
            if forest.join(int(label[i]), int(label[j])):
                a.append(node[i])
                b.append(node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_copies(logs: DataFrame, log_id: str = "log_id", message: str = "message", k: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """One row per message: ``log_id, n_shingles, component_id, kept, message_hash``.

    Two messages are linked if ``100 * intersection >= percent * union`` holds
    for their sets of ``k``-word shingles.  Messages with the same set form a
    class, and only one of a class is compared.  Candidates share a band of
    minima.  In a bucket all are compared with its most shared member: packed
    low bits of the minima estimate the similarity, corrected for chance, and
    pairs near the limit or above are confirmed on full sets.  Members that are
    unlike that one are compared in blocks with all of the bucket, since they may
    be like each other.  Groups of candidates that this leaves in several components are compared in blocks,
    the members outside the group's largest component against all.  So each pair
    that shares a band is in one component or was compared; a pair at
    the limit shares no band with probability ``(1 - 0.8**5)**32``, 3 in a
    million.

    ``component_id`` is the smallest id reachable, ``kept`` is true for that id;
    the hash (xxhash64) tells rows of one id apart.
    Null and empty messages have no shingle and no link; rows with a null id
    link with nothing and have a null component; rows with the same id and
    different texts are one node each and share nothing but the id.
    """
    rows = logs.select(F.col(log_id).cast("bigint").alias("log_id"), F.col(message).cast("string").alias("message"), F.xxhash64(F.col(message).cast("string")).alias("message_hash"))
    # Workers keep what they have once needed, so texts and sets reach them in small batches.
    with small_batches(logs.sparkSession):
        signed = materialize(rows.mapInArrow(lambda it: _signed(it, k), "log_id bigint, message_hash bigint, n_shingles bigint, f1 bigint, f2 bigint, bits binary, bands array<bigint>"))
    classes = materialize(signed.filter("n_shingles > 0 and log_id is not null").groupBy("f1", "f2").agg(F.min("log_id").alias("node_id")).withColumn("node", F.xxhash64("f1", "f2")))
    leads = signed.select("log_id", "f1", "f2", "bits", "bands").join(classes, ["f1", "f2"]).filter("log_id = node_id").dropDuplicates(["f1", "f2"])
    leads = materialize(leads.select("node", "node_id", "f1", "f2", "bits", "bands"))
    buckets = materialize(_buckets(leads))
    stars = materialize(_stars(leads, buckets))
    stars = stars.unionByName(materialize(_unlike(leads, buckets, stars, percent / 100 - SLACK, block)))
    groups = materialize(graph.components(stars).withColumnRenamed("component", "group"))
    wanted = materialize(leads.select("node", "node_id", "f1", "f2", "bits").join(groups, "node"))
    # A filter of fixed size lets most other texts go before anything is shuffled; the join below is exact.
    likely = Bloom.of(wanted, "node_id")
    sets = rows.mapInArrow(lambda it: _sets(likely.passing(it, "log_id"), k), "f1 bigint, f2 bigint, shingles binary")
    with small_batches(logs.sparkSession):
        sets = materialize(sets.join(wanted.drop("node_id"), ["f1", "f2"]).dropDuplicates(["node"]).select("node", "group", "bits", "shingles"))
    pairs = stars.filter(F.col("estimate") >= percent / 100 - SLACK).select("a", "b")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    with small_batches(logs.sparkSession):
        links = materialize(both.select("a", "b", "x", "y").mapInArrow(lambda it: _confirmed(it, percent), "a bigint, b bigint"))
    labels = materialize(graph.components(links))
    open_ = materialize(_open(sets, labels, block))
    if not open_.isEmpty():
        more = open_.groupBy("group", "q", "d").applyInArrow(lambda t: _across(t, percent), "a bigint, b bigint")
        labels = materialize(graph.components(links.unionByName(materialize(more))))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    lowest = named.groupBy("label").agg(F.min("node_id").alias("component_id"))
    placed = named.join(lowest, "label").select("f1", "f2", "component_id")
    lone = F.when(F.col("n_shingles") == 0, F.col("log_id")).otherwise(F.col("component_id"))
    out = signed.select("log_id", "message_hash", "n_shingles", "f1", "f2").join(placed, ["f1", "f2"], "left").withColumn("component_id", F.when(F.col("log_id").isNotNull(), lone))
    return out.select("log_id", "n_shingles", "component_id", F.coalesce(F.col("log_id") == F.col("component_id"), F.lit(False)).alias("kept"), "message_hash")


def _buckets(leads: DataFrame) -> DataFrame:
    """``band, a, b``: every member ``b`` of a bucket with the one, ``a``, that shares most buckets with most others."""
    band = leads.select("node", F.explode("bands").alias("band"))
    shared = materialize(band.join(band.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "band"))
    reach = shared.groupBy("node").agg(F.sum("members").alias("reach"))
    placed = shared.select("node", "band").join(reach, "node")
    centre = placed.groupBy("band").agg(F.max(F.struct("reach", "node")).alias("c")).select("band", F.col("c.node").alias("a"))
    return shared.select("band", F.col("node").alias("b")).join(centre, "band").select("band", "a", "b")


def _stars(leads: DataFrame, buckets: DataFrame) -> DataFrame:
    """``a, b, estimate``: members like the most shared one of their bucket."""
    pairs = buckets.filter("a <> b").select("a", "b").distinct()
    bits = leads.select(F.col("node").alias("n"), "bits")
    known = pairs.join(bits.withColumnsRenamed({"n": "b", "bits": "y"}), "b").join(bits.withColumnsRenamed({"n": "a", "bits": "x"}), "a")
    return known.select("a", "b", "x", "y").mapInArrow(_estimated, "a bigint, b bigint, estimate double")


def _unlike(leads: DataFrame, buckets: DataFrame, stars: DataFrame, least: float, block: int) -> DataFrame:
    """``a, b, estimate``: members unlike the most shared one of their bucket, and others of the bucket, at an estimate of at least ``least``."""
    like = buckets.join(stars.select("a", "b", F.lit(True).alias("like")), ["a", "b"], "left")
    member = like.select(F.col("band").alias("group"), F.col("b").alias("node"), F.when(F.col("like"), F.col("a")).otherwise(F.col("b")).alias("label"))
    dealt = materialize(_dealt(member, block))
    lot = F.pmod(F.xxhash64("group", "q", "d"), F.lit(dealt.count() // LOT + 1)).alias("lot")
    known = dealt.join(leads.select("node", "bits"), "node").select(lot, "group", "q", "d", "asks", "node", "label", "bits")
    return known.groupBy("lot").applyInArrow(lambda t: _met(t, least), "a bigint, b bigint, estimate double").distinct()


def _open(sets: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Members of groups in several components, dealt to blocks."""
    member = sets.select("node", "group").join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("label"))
    return _dealt(member, block).join(sets.select("node", "bits", "shingles"), "node")


def _dealt(member: DataFrame, block: int) -> DataFrame:
    """Members of groups with several labels, dealt to blocks: those outside the main label that ask (``q``) and all that are asked (``d``)."""
    part = member.groupBy("group", "label").count()
    whole = part.groupBy("group").agg(F.max(F.struct("count", "label")).alias("main"), F.sum("count").alias("size"), F.count(F.lit(1)).alias("labels"))
    # Two members have been compared already.
    whole = whole.filter("labels > 1 and size > 2").select("group", F.col("main.label").alias("main"), F.ceil(F.col("size") / block).alias("ds"), F.ceil((F.col("size") - F.col("main.count")) / block).alias("qs"))
    mine = member.join(whole, "group").withColumns({"q": F.pmod(F.xxhash64("node"), "qs"), "d": F.pmod(F.xxhash64("node"), "ds")})
    asks = mine.filter("label <> main").withColumn("d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ds") - 1))).withColumn("asks", F.lit(True))
    given = mine.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qs") - 1))).withColumn("asks", F.lit(False))
    return asks.unionByName(given).select("group", "q", "d", "asks", "node", "label")
