"""Exact nearest signals by integer features: a kNN join over Voronoi cells.

A signal has ``signal_id`` and ``entry_features``, here whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.vectors import matrix, numbered
from tapeline.session import materialize

PIVOTS = 64
#: Rows of a cell that one task holds.
BLOCK = 4096


def _assigned(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Nearest pivot of each row (rows of one batch may differ in length), the distance and the row's norm."""
    for b in batches:
        dims = b.column(3).to_numpy()
        for d in np.unique(dims):
            part = b.filter(pa.array(dims == d))
            x = matrix(part.column(2))
            square = (x * x).sum(1)[:, None] + (pivots[d] * pivots[d]).sum(1) - 2 * x @ pivots[d].T
            cell = square.argmin(1)
            away = np.sqrt(((x - pivots[d][cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x * x).sum(1)))], names=[*part.schema.names, "cell", "away", "norm"])


def _needed(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The cells that may hold one of a query's best: those whose upper bound reaches the k-th best lower bound.

    A member at distance r from pivot p has a product with q between
    ``q.p - |q| r`` and ``q.p + |q| r``; a cell's summary holds its largest
    distance and its ``k + 1`` smallest ones (one may be the query itself).
    """
    for b in batches:
        dims = b.column(3).to_numpy()
        for d in np.unique(dims):
            part = b.filter(pa.array(dims == d))
            q = matrix(part.column(2))
            far, near, _ = cells[d]
            product, norm = q @ pivots[d].T, np.sqrt((q * q).sum(1))[:, None]
            # A missing distance bounds nothing: 0 * inf of a zero query would be NaN.
            lower = np.where(np.isinf(near), -np.inf, product[:, :, None] - norm[:, :, None] * np.where(np.isinf(near), 0.0, near)).reshape(len(q), -1)
            place = lower.shape[1] - (k + 1)
            best = np.partition(lower, place, axis=1)[:, place] if place >= 0 else np.full(len(q), -np.inf)
            slack = 1e-9 * (1 + norm * (np.abs(pivots[d]).max(initial=0) * np.sqrt(d) + far.max(initial=0)))
            row, cell = np.nonzero(product + norm * far + slack >= best[:, None])
            keep = far[cell] >= 0
            row, cell = row[keep], cell[keep]
            part = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(cell.astype(np.int32))], names=["row_id", "signal_id", "vector", "dims", "cell"])


def _best(given: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each query: highest product, then smallest id."""
    given = given.sort_by([("signal_id", "ascending"), ("row_id", "ascending")])
    x, rows, ids = matrix(given.column("vector")), given.column("row_id").to_numpy(), given.column("signal_id").to_numpy(zero_copy_only=False)
    out = []
    for at in range(0, asks.num_rows, 256):
        part = asks.slice(at, 256)
        q, own = matrix(part.column("vector")), part.column("row_id").to_numpy()
        if not len(x):
            continue
        exact = np.abs(q).max() * np.abs(x).max() * x.shape[1] < 2.0**53
        score = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T
        low = np.iinfo(np.int64).min
        score = np.where(own[:, None] == rows[None, :], low, score)
        order = np.argsort(np.where(score == low, np.iinfo(np.int64).max, -score), axis=1, kind="stable")[:, :k]
        picked = np.take_along_axis(score, order, 1)
        ask, nth = np.nonzero(picked != low)
        who = order[ask, nth]
        out.append(pa.table({"query_row": own[ask], "query_id": part.column("signal_id").to_numpy(zero_copy_only=False)[ask].astype(np.int64), "signal_id": ids[who].astype(np.int64), "row_id": rows[who], "score": picked[ask, nth]}))
    schema = pa.schema([(n, pa.int64()) for n in ("query_row", "query_id", "signal_id", "row_id", "score")])
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def nearest_signals(signals: DataFrame, is_query: Column, k: int = 10, signal_id: str = "signal_id", entry_features: str = "entry_features", pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, signal_id, score``: each query's ``k`` signals with the highest inner product.

    ``is_query`` is a condition on the id column, named ``signal_id``.  Signals
    are grouped by the nearest of ``pivots`` signals; from the distances in each
    cell follow bounds on every product, and a query goes only to the cells that
    may hold one of its best.  Cells are dealt in blocks of about ``block``
    rows, solved there, and the blocks' results are merged.  Ties go to the
    smaller id.  Features must be whole numbers; products are exact below 2**63.

    Rows whose features are null, empty or hold a null or non-finite component,
    and rows with a null id, take no part; signals of another length are no
    candidates of a query.  Fewer candidates than ``k`` give fewer rows.  Of
    rows that repeat an id each is a candidate, and a query, of its own.
    """
    rows = numbered(signals, signal_id, entry_features).filter("dims > 0 and signal_id is not null")
    spark = signals.sparkSession
    chosen = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dims", F.pmod("row_id", F.lit(256))).orderBy(F.xxhash64("signal_id", "row_id")))).filter(F.col("nth") <= pivots)
    # At most ``pivots`` rows of each length reach the driver.
    top = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("signal_id", "row_id")))).filter(F.col("nth") <= pivots).collect()
    centres = {d: np.array([r["vector"] for r in top if r["dims"] == d], float) for d in {r["dims"] for r in top}}
    shared = spark.sparkContext.broadcast(centres)
    schema = "row_id bigint, signal_id bigint, vector array<double>, dims int, cell int, away double, norm double"
    placed = materialize(rows.mapInArrow(lambda it: _assigned(it, shared.value), schema))
    split = placed.withColumn("nth", F.row_number().over(Window.partitionBy("dims", "cell", F.pmod("row_id", F.lit(64))).orderBy("away"))).filter(F.col("nth") <= k + 1)
    near = split.groupBy("dims", "cell").agg(F.slice(F.sort_array(F.collect_list("away")), 1, k + 1).alias("near"))
    found = placed.groupBy("dims", "cell").agg(F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).join(near, ["dims", "cell"]).collect()
    summary = {d: (np.full(len(c), -1.0), np.full((len(c), k + 1), np.inf), np.zeros(len(c), np.int64)) for d, c in centres.items()}
    for r in found:
        far, close, n = summary[r["dims"]]
        far[r["cell"]], n[r["cell"]] = r["far"], r["n"]
        close[r["cell"], : len(r["near"])] = r["near"]
    cells = spark.sparkContext.broadcast(summary)
    counts = spark.createDataFrame([(int(d), int(c), max(1, -(-int(n) // block))) for d, (_, _, ns) in summary.items() for c, n in enumerate(ns)], "dims int, cell int, blocks int")
    asks = rows.filter(is_query).select("row_id", "signal_id", "vector", "dims")
    asks = asks.mapInArrow(lambda it: _needed(it, shared.value, cells.value, k), "row_id bigint, signal_id bigint, vector array<double>, dims int, cell int")
    counts = F.broadcast(counts)  # one row for each pivot
    asks = asks.join(counts, ["dims", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    given = placed.join(counts, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int")).select("row_id", "signal_id", "vector", "dims", "cell", "block")
    key = ["dims", "cell", "block"]
    solved = given.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(lambda d, q: _best(d, q, k), "query_row bigint, query_id bigint, signal_id bigint, row_id bigint, score bigint")
    ranked = solved.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "signal_id", "row_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "signal_id", "score")
