"""Long byte passages that repeat across log messages: a logarithmic family of sparse suffix arrays.

A message is a row of the bot's log with ``log_id`` and ``message``.  Suffixes
are kept at anchors only: the place, in every stretch of ``length`` bytes, whose
following ``CORE`` bytes have the smallest hash.  Two equal stretches have their
anchor at the same place, so equal stretches always meet.  An array is sorted by
a 64-bit fingerprint of the suffix's first ``CORE`` bytes; in that order equal
beginnings are neighbours, as in the order of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.bloom import Bloom
from tapeline.llm.text import Prints, mix, slices
from tapeline.session import materialize

CORE = 64
#: Batches whose arrays enter the index one after another.
BATCHES = 4
#: Starts of stretches that one piece holds, from coarse to fine; the first are those of an anchor.
PIECES = (8, 1)
PIECE = "row_id bigint, lo int, hi int, at int, core bigint, whole bigint"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Prints]:
    """Runs of starts that share an anchor: row, first and last start, anchor (all in the slice's bytes)."""
    prints = Prints(data)
    wide = length - CORE + 1
    start = prints.fixed(CORE)
    key = (start & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(start), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= wide:
        least = np.minimum(least[: max(0, len(least) - span)], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: max(0, len(least) - (wide - span))], least[wide - span :])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(start) else start
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])) if len(start) else start
    end = np.concatenate([new[1:] - 1, [len(start) - 1]]).astype(np.int64) if len(start) else start
    return row[new], start[new], start[end], at[new], prints


def _pieces(row_ids: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, step: int, length: int, prints: Prints) -> pa.RecordBatch:
    """Runs cut at multiples of ``step`` bytes before their anchor, with the bytes that all its stretches share and all that they cover."""
    far, near = (at - lo) // step, (at - hi) // step
    count = far - near + 1
    run = np.repeat(np.arange(len(lo)), count)
    block = near[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    anchor = at[run]
    first, last = np.maximum(lo[run], anchor - block * step - step + 1), np.minimum(hi[run], anchor - block * step)
    shared = prints(anchor - block * step, anchor - block * step - step + 1 + length)
    covered = prints(first, last + length)
    core = mix(shared + mix(block.astype(np.uint64) + np.uint64(step << 20)))
    whole = mix(covered ^ mix(((anchor - first).astype(np.uint64) << np.uint64(20)) + (last - first).astype(np.uint64) + np.uint64(step << 44)))
    at0 = base[run]
    return pa.RecordBatch.from_arrays([
        pa.array(row_ids[run]), pa.array((first - at0).astype(np.int32)), pa.array((last - at0).astype(np.int32)), pa.array((anchor - at0).astype(np.int32)),
        pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)),
    ], names=["row_id", "lo", "hi", "at", "core", "whole"])


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    step = length - CORE + 1
    for part, data, offsets in slices(batches, "message"):
        row, lo, hi, at, prints = anchors(data, offsets, length)
        if len(row):
            yield _pieces(part.column(0).to_numpy()[row], offsets[:-1][row], lo, hi, at, step, length, prints)


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that the stretches of each open run cover."""
    for b in batches:
        out = [(b.column(0)[i].as_py(), r["lo"], r["hi"], r["at"], raw[r["lo"] : r["hi"] + length]) for i in range(b.num_rows) for raw in [b.column(1)[i].as_py()] for r in b.column(2)[i].as_py()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row_id", "lo", "hi", "at", "context"])


def _finer(batches: Iterator[pa.RecordBatch], step: int, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of stored contexts; with a list of runs in them (``parts``), of these only."""
    for part, data, offsets in slices(batches, "context"):
        ids, lo, hi, at = (part.column(part.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("row_id", "lo", "hi", "at"))
        shift = offsets[:-1] - lo
        if "parts" in part.schema.names:
            lists = [[(x["lo"], x["hi"]) for x in v] for v in part.column(part.schema.get_field_index("parts")).to_pylist()]
            own = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
            runs = np.array([x for v in lists for x in v], np.int64).reshape(-1, 2)
            ids, lo, hi, at, shift = ids[own], runs[:, 0], runs[:, 1], at[own], shift[own]
        yield _pieces(ids, shift, lo + shift, hi + shift, at + shift, step, length, Prints(data))


class SuffixIndex:
    """Levels of sorted suffix arrays, each twice as large as the one below."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Put a batch in; returns the beginnings that it repeats within itself or from a level.

        The batch enters at the bottom, and levels of one size merge into one of
        the next size; the scan of a merge tells what the batch shares with
        them.  It is merge-scanned against the other levels as well.
        """
        array, size = suffixes.select("core", F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("new")), 0
        while size in self.levels:
            array = array.unionByName(self.levels.pop(size).select("core", "n", F.lit(0).cast("bigint").alias("new")))
            size += 1
        array = materialize(array.groupBy("core").agg(F.sum("n").alias("n"), F.sum("new").alias("new")).sortWithinPartitions("core"))
        found = array.filter("n > 1 and new > 0").select("core")
        for level in self.levels.values():
            found = found.unionByName(array.filter("new > 0").select("core").join(level.select("core").hint("merge"), "core"))
        self.levels[size] = array
        return found


def _matched(pieces: DataFrame) -> DataFrame:
    """``row_id, lo, hi, at, sure, open`` of the pieces that repeat as a whole (``sure``), and of one piece of each content whose shared bytes occur with other contents (``open``)."""
    pieces = pieces.withColumn("pid", F.xxhash64("row_id", "lo", "at"))
    contents = pieces.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("p"))
    several = contents.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    contents = contents.join(several, "core", "left").filter("n > 1 or k is not null")
    both = pieces.join(contents, ["core", "whole"]).filter("n > 1 or pid = p")
    return both.select("row_id", "lo", "hi", "at", (F.col("n") > 1).alias("sure"), (F.col("k").isNotNull() & (F.col("pid") == F.col("p"))).alias("open"))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans with those that touch joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    return np.stack([spans[new, 0], ends[np.concatenate([new[1:] - 1, [len(spans) - 1]])]], axis=1)


def _spans(column: pa.Array, i: int, length: int) -> np.ndarray:
    value = column[i].as_py() or []
    return np.array([(x["lo"], x["hi"] + length) for x in value], np.int64).reshape(-1, 2)


OUT = "row_id bigint, log_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: int, end: int>>, kept binary"


def _cut(raw: bytes, spans: np.ndarray) -> tuple[int, list[dict], bytes]:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return len(raw) - len(kept), [{"start": int(a), "end": int(b)} for a, b in spans], kept


def _settled(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows without open anchors are done; of the others the text, the spans so far and the open contexts go on."""
    kinds = [("row_id", pa.int64()), ("log_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary()), ("open", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32())])))]
    for batch in batches:
        for part, data, offsets in slices([batch], "message"):
            rows = []
            for i in range(part.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                spans, open_ = _merged(_spans(part.column(3), i, length)), part.column(4)[i].as_py()
                ids = part.column(0)[i].as_py(), part.column(1)[i].as_py(), len(raw)
                if open_:
                    rows.append((*ids, None, [{"start": int(a), "end": int(b)} for a, b in spans], raw, open_))
                else:
                    removed, listed, kept = _cut(raw, spans)
                    rows.append((*ids, removed, listed, hashlib.sha256(kept).digest() if digest else kept, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _finished(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, listed, kept = [], [], []
        for i in range(b.num_rows):
            raw = b.column(4)[i].as_py()
            before = np.array([(s["start"], s["end"]) for s in b.column(3)[i].as_py()], np.int64).reshape(-1, 2)
            n, spans, rest = _cut(raw, _merged(np.concatenate([before, _spans(b.column(5), i, length)])))
            removed.append(n)
            listed.append(spans)
            kept.append(hashlib.sha256(rest).digest() if digest else rest)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(removed, pa.int64()), pa.array(listed, span), pa.array(kept, pa.binary())], names=["row_id", "log_id", "n_bytes", "n_removed", "spans", "kept"])


def repeated_passages(logs: DataFrame, log_id: str = "log_id", message: str = "message", length: int = 200, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """``log_id, n_bytes, n_removed, spans, kept`` of every message, as UTF-8 bytes.

    ``spans`` are the maximal runs of bytes covered by a stretch of ``length``
    bytes that starts anywhere else too, in the same message or another; matches
    never cross messages.  ``kept`` are the other bytes, or their SHA-256 if
    ``digest``.  Batches of messages enter a ``SuffixIndex``; the beginnings it
    finds repeated lead to the anchors that carry them.  An anchor whose whole
    surroundings repeat is settled; of others one for each content is cut into
    finer pieces, down to single stretches.  Null is empty; repeated rows repeat
    each other; an empty table stays empty.
    """
    if length < CORE + 8:
        raise ValueError(f"length below {CORE + 8}")
    rows = logs.select(F.col(log_id).cast("bigint").alias("log_id"), F.coalesce(F.col(message).cast("string"), F.lit("")).alias("message"))
    # Rows that repeat id and text share a number; what is found for one holds for the other.
    rows = rows.withColumn("row_id", F.xxhash64("log_id", "message")).select("row_id", "log_id", "message")
    index, hits = SuffixIndex(), []
    for b in range(batches):
        part = rows.select("row_id", "message").filter(F.pmod("row_id", F.lit(batches)) == b)
        hits.append(index.add(part.mapInArrow(lambda it: _anchored(it, length), PIECE).select("core")))
    # A filter of fixed size lets other anchors go before anything is shuffled; one it lets through by chance repeats with nothing.
    repeated = Bloom.of(reduce(DataFrame.unionByName, hits), "core")
    near = materialize(rows.select("row_id", "message").mapInArrow(lambda it: repeated.passing(_anchored(it, length), "core"), PIECE))
    span = F.struct("lo", "hi")
    lists = _matched(near).groupBy("row_id").agg(F.collect_set(F.when(F.col("sure"), span)).alias("sure"), F.collect_set(F.when(F.col("open"), F.struct("lo", "hi", "at"))).alias("open"))
    lists = lists.select("row_id", "sure", F.when(F.size("open") > 0, F.col("open")).alias("open"))
    settled = rows.join(lists, "row_id", "left").select("row_id", "log_id", "message", "sure", "open").mapInArrow(lambda it: _settled(it, length, digest), OUT + ", open array<struct<lo: int, hi: int, at: int>>")
    settled = materialize(settled)
    waiting = settled.filter("open is not null")
    contexts = materialize(waiting.dropDuplicates(["row_id"]).select("row_id", "kept", "open").mapInArrow(lambda it: _contexts(it, length), "row_id bigint, lo int, hi int, at int, context binary"))
    spans, runs = [], contexts
    for step in PIECES:
        # Pieces are many and cheap to make from the contexts, so they are made twice and not stored.
        pieces = runs.mapInArrow(lambda it, step=step: _finer(it, step, length), PIECE)
        found = materialize(_matched(pieces))
        spans.append(found.filter("sure").select("row_id", "lo", "hi"))
        parts = found.filter("open").groupBy("row_id", "at").agg(F.collect_set(span).alias("parts"))
        runs = contexts.join(parts, ["row_id", "at"]).select("row_id", "lo", "hi", "at", "context", "parts")
    more = reduce(DataFrame.unionByName, spans).groupBy("row_id").agg(F.collect_set(span).alias("sure"))
    done = waiting.join(more, "row_id", "left").select("row_id", "log_id", "n_bytes", "spans", "kept", "sure").mapInArrow(lambda it: _finished(it, length, digest), OUT)
    out = settled.filter("open is null").drop("open").unionByName(done)
    return out.select("log_id", "n_bytes", "n_removed", "spans", "kept")
