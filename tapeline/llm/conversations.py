"""Structure repair of conversations: Hirschberg's divide and conquer over four states.

A conversation is the rows of one ``conv_id`` in order of ``turn``, each with ``role`` and ``text``; the project
keeps no conversations, so this operator is general.  Wanted are role initials of the form ``(s?(ua)+)?``.

The four states are: nothing yet, after system, after user, after assistant.  A stretch of rows has, for each
state before it, the least cost of arriving in each state after it, with its last row as the last edit.  Such edit
lists never begin one another, so one rank for each pair of states is enough to tell which list comes first in ASCII
order.  A stretch is halved: the forward costs of the left half and the backward costs of the right half meet in the
middle, the least total with the least rank is the crossing, and both halves are solved the same way.
Each level keeps 16 costs for each of its stretches, so the space is linear in the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

# Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK_PATTERN = r"\A[\x20\x09-\x0D]*\z"
WHOLE_PATTERN = r"[.!?][\x20\x09-\x0D]*\z"

NEVER = 1 << 40
#: The state that an inserted or renamed row leads to, and the inserts that are missing at the end.
NEXT = (2, 2, 3, 2)
MISSING = (0, 2, 1, 0)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
INITIALS = ("", "s", "u", "a")
PIECES = ("D", "IK", "IR", "K", "R")
#: Stretches of one conversation that are joined in one task.
FAN = 4096


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, rank and edit of one row from each state to each state, for each of 16 kinds of rows: 4 initials, must go, truncated."""
    cost = np.full((16, 4, 4), NEVER, np.int64)
    rank, piece = np.zeros((16, 4, 4), np.int64), np.full((16, 4, 4), -1, np.int64)
    for kind in range(16):
        initial, gone, cut = INITIALS[kind >> 2], kind & 2, TRUNCATED * (kind & 1)
        for p in range(4):
            found = [(DELETE, "D", p)]
            for lead, at, price in () if gone else (("", p, cut), ("I", NEXT[p], cut + INSERT)):
                if (at, initial) in KEPT:
                    found.append((price, lead + "K", KEPT[at, initial]))
                found.append((price + REROLE, lead + "R", NEXT[at]))
            best: dict[int, tuple[int, str]] = {}
            for price, edit, q in found:
                best[q] = min(best.get(q, (NEVER, "~")), (price, edit))
            for n, (edit, q) in enumerate(sorted([(best[q][1], q) for q in best] + [("~", q) for q in range(4) if q not in best])):
                rank[kind, p, q] = n
                if q in best:
                    cost[kind, p, q], piece[kind, p, q] = best[q][0], PIECES.index(edit)
    return cost, rank, piece


COST, RANK, PIECE = _tables()


def joined(cost: np.ndarray, rank: np.ndarray, cost2: np.ndarray, rank2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks of pairs of neighbouring stretches, each ``[n, 4, 4]``."""
    total = (cost[:, :, :, None] + cost2[:, None, :, :]) * 4 + rank[:, :, :, None]
    middle = total.argmin(2)
    best = np.minimum(np.take_along_axis(total, middle[:, :, None, :], 2)[:, :, 0, :] // 4, NEVER)
    first = np.take_along_axis(rank, middle, 2)
    second = np.take_along_axis(rank2, middle, 1)
    return best, (first * 4 + second).argsort(2, kind="stable").argsort(2, kind="stable")


class Halves:
    """All halvings of many stretches at once; ``stretch`` numbers the stretch of each leaf, in order."""

    def __init__(self, cost: np.ndarray, rank: np.ndarray, stretch: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            same = np.concatenate([stretch[1:] == stretch[:-1], [False]]) if len(stretch) else np.zeros(0, bool)
            if not same.any():
                break
            head = np.flatnonzero(np.concatenate([[True], ~same[:-1]]))
            place = np.arange(len(stretch)) - np.repeat(head, np.diff(np.append(head, len(stretch))))
            left = np.flatnonzero(place % 2 == 0)
            paired = same[left]
            self.levels.append((cost, rank, left, paired))
            i = left[paired]
            both = joined(cost[i], rank[i], cost[i + 1], rank[i + 1])
            cost, rank, stretch = cost[left], rank[left], stretch[left]
            cost[paired], rank[paired] = both
        self.cost, self.rank = cost, rank

    def crossings(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before and after every leaf, from those before and after each stretch."""
        for cost, rank, left, paired in reversed(self.levels):
            before, after = np.zeros(len(cost), np.int64), np.zeros(len(cost), np.int64)
            before[left], after[left] = p, q
            i, p, q = left[paired], p[paired], q[paired]
            forward, backward = cost[i, p], cost[i + 1, :, q]
            meet = ((forward + backward) * 4 + rank[i, p]).argmin(1)
            after[i], before[i + 1], after[i + 1] = meet, meet, q
            p, q = before, after
        return p, q


def last_state(cost: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state in which the cheapest edits of each whole conversation leave its last row."""
    return ((cost[:, 0] + INSERT * np.array(MISSING)) * 4 + rank[:, 0]).argmin(1)


def _lists(matrix: np.ndarray) -> pa.Array:
    n = len(matrix)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 16), pa.array(matrix.reshape(-1).astype(np.int64)))


def _matrices(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(), dtype=np.int64).reshape(-1, 4, 4)


def _runs(column: pa.Array) -> np.ndarray:
    """Where a run of equal values (nulls too) begins."""
    if len(column) < 2:
        return np.zeros(len(column), np.int64)
    a, b = column[:-1], column[1:]
    differ = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.xor(pc.is_null(a), pc.is_null(b)), pc.not_equal(a, b))
    return np.concatenate([[0], np.flatnonzero(np.asarray(differ)) + 1])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of a conversation inside a batch of rows in order."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    names = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        head = _runs(get("conv_id"))
        size = np.diff(np.append(head, batch.num_rows))
        stretch = np.repeat(np.arange(len(head)), size)
        kind = get("kind").to_numpy().astype(np.int64)
        fault = get("fault").to_numpy()
        tree = Halves(COST[kind], RANK[kind], stretch)
        initial = np.asarray(get("initial"), dtype=object)
        pair = np.array([a + b not in ("su", "ua", "au") for a, b in zip(initial[:-1], initial[1:], strict=True)] + [False])
        pair[head[1:] - 1] = False
        turn = get("turn")
        known, value = np.asarray(turn.is_valid()), np.asarray(turn.fill_null(0))
        new = known.copy()
        new[1:] &= ~(known[:-1] & (value[1:] == value[:-1]) & (stretch[1:] == stretch[:-1]))
        add = lambda x: np.add.reduceat(x.astype(np.int64), head)  # noqa: B023, E731
        sums = dict(zip(names, (size, add(fault == 1), add(fault == 2), add(fault == 3), add(pair), add(new)), strict=True))
        some = add(known) > 0
        low = np.minimum.reduceat(np.where(known, value, np.iinfo(np.int64).max), head)
        high = np.maximum.reduceat(np.where(known, value, np.iinfo(np.int64).min), head)
        edges = pa.array(np.append(head, batch.num_rows).astype(np.int32))
        group = lambda x: pa.ListArray.from_arrays(edges, x)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([
            get("conv_id").take(pa.array(head)), pa.array(at + np.arange(len(head))), *[pa.array(sums[c].astype(np.int64)) for c in names],
            pa.array(initial[head].tolist(), pa.string()), pa.array(initial[head + size - 1].tolist(), pa.string()),
            pa.array(low, mask=~some), pa.array(high, mask=~some), _lists(tree.cost), _lists(tree.rank),
            group(pa.array(kind)), group(get("role").cast(pa.string())), group(get("text").cast(pa.string())),
        ], names=["conv_id", "at", *names, "first", "last", "low", "high", "cost", "rank", "kinds", "roles", "texts"])
        at += len(head)


def _unite(rows: pa.Table) -> pa.Table:
    """Neighbouring stretches of one conversation as one."""
    rows = rows.sort_by("at").combine_chunks()
    tree = Halves(_matrices(rows.column("cost").chunk(0)), _matrices(rows.column("rank").chunk(0)), np.zeros(rows.num_rows, np.int64))
    return pa.table({"conv_id": rows.column("conv_id")[:1], "at": rows.column("bunch")[:1], "cost": _lists(tree.cost), "rank": _lists(tree.rank)})


def _divide(rows: pa.Table, whole: pa.Table) -> pa.Table:
    """States before and after each stretch, from those of the bunch it lies in."""
    rows = rows.sort_by("at").combine_chunks()
    tree = Halves(_matrices(rows.column("cost").chunk(0)), _matrices(rows.column("rank").chunk(0)), np.zeros(rows.num_rows, np.int64))
    p, q = tree.crossings(np.array(whole.column("p").to_pylist()), np.array(whole.column("q").to_pylist()))
    ends = np.zeros(rows.num_rows, bool)
    ends[-1:] = whole.column("ends")[0].as_py()
    return pa.table({"conv_id": rows.column("conv_id"), "at": rows.column("at"), "p": p, "q": q, "ends": ends})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last state of whole conversations."""
    for b in batches:
        q = last_state(_matrices(b.column("cost")), _matrices(b.column("rank"))) if b.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), pa.array(np.zeros(len(q), np.int64)), pa.array(q), pa.array(np.ones(len(q), bool))], names=["conv_id", "at", "p", "q", "ends"])


def _crossings(nodes: DataFrame, fan: int) -> DataFrame:
    """``conv_id, at, p, q, ends`` of stored stretches ``conv_id, at, cost, rank``: bunches of ``fan`` neighbours are solved as one first."""
    kind = nodes.schema["conv_id"].dataType.simpleString()
    placed = f"conv_id {kind}, at bigint, p bigint, q bigint, ends boolean"
    spread = nodes.withColumn("bunch", F.expr(f"(row_number() over (partition by conv_id order by at) - 1) div {fan}"))
    spread = materialize(spread)
    if not spread.agg(F.count_if(F.expr("at <> 0"))).first()[0]:
        return nodes.select("conv_id", "at", "cost", "rank").mapInArrow(_finish, placed)
    unite = spread.groupBy("conv_id", "bunch").applyInArrow(_unite, f"conv_id {kind}, at bigint, cost array<bigint>, rank array<bigint>")
    above = _crossings(materialize(unite), fan).withColumnRenamed("at", "bunch")
    return spread.groupBy("conv_id", "bunch").cogroup(above.groupBy("conv_id", "bunch")).applyInArrow(_divide, placed)


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits, roles and texts of each stretch after repair."""
    spelled = np.array(PIECES, dtype=object)
    names = {2: "user", 3: "assistant"}
    for b in batches:
        get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
        kinds = get("kinds")
        kind, edge = kinds.flatten().to_numpy(), np.append(0, np.cumsum(kinds.value_lengths().to_numpy()))
        stretch = np.repeat(np.arange(b.num_rows), np.diff(edge))
        tree = Halves(COST[kind], RANK[kind], stretch)
        p = get("p").fill_null(0).to_numpy()
        end = last_state(tree.cost, tree.rank)
        q = np.where(np.asarray(get("p").is_null()), end, get("q").fill_null(0).to_numpy())
        ends = np.asarray(get("p").is_null()) | np.asarray(get("ends").fill_null(False))
        before, after = tree.crossings(p, q)
        piece = PIECE[kind, before, after]
        price = tree.cost[np.arange(b.num_rows), p, q] + np.where(ends, INSERT * np.array(MISSING)[q], 0)
        roles, texts = get("roles").flatten().to_pylist(), get("texts").flatten().to_pylist()
        audit, out_roles, out_texts = [], [], []
        for s in range(b.num_rows):
            edits = spelled[piece[edge[s] : edge[s + 1]]].tolist()
            r, t = [], []
            for i, edit in zip(range(edge[s], edge[s + 1]), edits, strict=True):
                if edit == "D":
                    continue
                if edit[0] == "I":
                    r.append(names[NEXT[before[i]]])
                    t.append("")
                r.append(roles[i] if edit[-1] == "K" else names[int(after[i])])
                t.append(texts[i])
            state = int(q[s])
            for _ in range(MISSING[state] if ends[s] else 0):
                edits.append("I")
                state = NEXT[state]
                r.append(names[state])
                t.append("")
            audit.append("".join(edits))
            out_roles.append(r)
            out_texts.append(t)
        yield pa.RecordBatch.from_arrays([
            get("conv_id"), get("at"), pa.array(price), pa.array(audit, pa.string()), pa.array(out_roles, pa.list_(pa.string())), pa.array(out_texts, pa.list_(pa.string())),
        ], names=["conv_id", "at", "cost", "audit", "roles", "texts"])


def _faults(turns: DataFrame) -> DataFrame:
    """Stored rows with ``fault`` (1 blank, 2 duplicate, 3 truncated, 0 none): the first of equal roles and texts is found by an aggregate, not in a sort of the conversation."""
    rows = materialize(turns.withColumn("row_id", F.monotonically_increasing_id()))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row_id")
    same = F.struct(F.xxhash64("role", "text"), F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text")))
    first = rows.select("conv_id", same.alias("same"), place.alias("place")).groupBy("conv_id", "same").agg(F.min("place").alias("place")).select(F.col("place.row_id").alias("row_id"), F.lit(True).alias("fresh"))
    fault = F.when(F.col("text").rlike(BLANK_PATTERN), 1).when(F.col("fresh").isNull(), 2).when(~F.col("text").rlike(WHOLE_PATTERN), 3).otherwise(0)
    return rows.join(first, "row_id", "left").withColumn("fault", fault.cast("int")).drop("fresh")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Repaired stretches and a report of every conversation.

    Stretches: ``conv_id, at, cost, audit, roles, texts``; those of one conversation in order of ``at`` are its edits
    (Keep, Rerole, Delete, Insert by initial) and its rows.  Report: ``conv_id, stretches, gaps, blank, duplicate,
    truncated, illegal, cost``.

    Rows are ordered by turn, nulls first, equal turns by role and text.  The first fault of a row counts: blank,
    duplicate (role and text seen earlier in the conversation), truncated (the last character that is no space is
    none of ``.!?``).  Blank and duplicate rows are deleted.  Null role or text is one space, a null id a conversation
    of its own; repeated rows are duplicates; an empty table has no conversations; further columns are ignored.
    Rows are sorted by ranges of (id, turn), so a long conversation is many stretches in many tasks, which are joined
    ``fan`` at a time.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _faults(turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), filled(role).alias("role"), filled(text).alias("text")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 4).when(initial == "u", 8).when(initial == "a", 12).otherwise(0) + F.when(F.col("fault").isin(1, 2), 2).when(F.col("fault") == 3, 1).otherwise(0)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row_id")]
    ready = rows.withColumns({"initial": initial, "kind": kind.cast("int")}).repartitionByRange(*order).sortWithinPartitions(*order)
    ready = ready.select("conv_id", "turn", "role", "text", "fault", "initial", "kind")
    sums = ", ".join(f"{c} bigint" for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns"))
    key = turns.schema[conv_id].dataType.simpleString()
    parts = materialize(ready.mapInArrow(_stretches, f"conv_id {key}, at bigint, {sums}, first string, last string, low bigint, high bigint, cost array<bigint>, rank array<bigint>, kinds array<bigint>, roles array<string>, texts array<string>"))
    slim = parts.drop("kinds", "roles", "texts")
    spread = slim.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("c"))
    nodes = materialize(slim.join(spread, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "at", "cost", "rank"))
    paths = materialize(_crossings(nodes, fan).select("at", "p", "q", "ends"))
    placed = parts.select("conv_id", "at", "kinds", "roles", "texts").join(paths, "at", "left").select("conv_id", "at", "kinds", "roles", "texts", "p", "q", "ends")
    done = materialize(placed.mapInArrow(_rewritten, f"conv_id {key}, at bigint, cost bigint, audit string, roles array<string>, texts array<string>"))
    return done, _report(slim, done)


def _report(parts: DataFrame, done: DataFrame) -> DataFrame:
    """One row a conversation, from the sums of its stretches and the edges between them."""
    edge = "over (partition by conv_id order by at)"
    seen = parts.withColumns({
        "left": F.expr(f"lag(last) {edge}"),
        "reached": F.expr("max(high) over (partition by conv_id order by at rows between unbounded preceding and 1 preceding)"),
    })
    broken = F.when(F.col("left").isNotNull() & ~F.concat("left", "first").isin("su", "ua", "au"), 1).otherwise(0)
    again = F.when(F.col("reached") == F.col("low"), 1).otherwise(0)
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - again), F.lit(0))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    found = seen.groupBy("conv_id").agg(F.count(F.lit(1)).alias("stretches"), gaps.alias("gaps"), *sums, F.sum(F.col("illegal") + broken).alias("illegal"))
    costs = done.groupBy(F.col("conv_id").alias("c")).agg(F.sum("cost").alias("cost"))
    return found.join(costs, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repaired_turns(done: DataFrame) -> DataFrame:
    """``conv_id, at, place, role, text``: the rows after repair, in order of ``at`` and ``place``."""
    return done.select("conv_id", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")).select("conv_id", "at", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def _lines() -> Column:
    return F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat_ws(":", x["roles"], x["texts"]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and audit of conversations that come in order; only one batch is held."""
    now: tuple | None = None
    for b in batches:
        ids, audits, lines = (b.column(i).to_pylist() for i in range(3))
        out = []
        for i, audit, line in zip(ids, audits, lines, strict=True):
            if now is None or now[0] != i:
                out += [now] if now else []
                now = (i, hashlib.sha256(), [], [False])
            now[2].append(audit)
            for x in line:
                now[1].update((b"\n" if now[3][0] else b"") + x.encode())
                now[3][0] = True
        yield _digests(out, b.schema.field(0).type)
    if now:
        yield _digests([now], b.schema.field(0).type)


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], ["".join(r[2]) for r in rows], [r[1].hexdigest() for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string()), strict=True)], names=["conv_id", "audit", "sha256"])


def digests(done: DataFrame, report: DataFrame) -> DataFrame:
    """``conv_id, audit, sha256``: all edits, and the SHA-256 of the newline-joined ``role:text`` of the repaired rows.

    A digest is a chain: the stretches of a long conversation pass one task in order, a batch at a time.
    """
    key = done.schema["conv_id"].dataType.simpleString()
    long = materialize(report.filter("stretches > 1").select(F.col("conv_id").alias("c")))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = done.join(long, same, "left_anti").select("conv_id", "audit", F.sha2(F.array_join(_lines(), "\n"), 256).alias("sha256"))
    chain = done.join(long, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "audit", _lines().alias("lines"))
    return short.unionByName(chain.mapInArrow(_hashed, f"conv_id {key}, audit string, sha256 string"))
