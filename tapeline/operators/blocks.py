"""Ordered computations that never put a whole symbol into one task.

A long series is cut into blocks of consecutive rows.  Three patterns cover
the ordered operators of this package:

* bounded frames: rows near a block edge are copied into the next block
  (``halo``), so a window partitioned by block sees its full frame;
* running values: each block is reduced first, the block results are scanned,
  and the carried value is joined back (``running``);
* linear recursions ``y[i] = a*y[i-1] + u[i]``: the same, with the carry
  damped by powers of ``a`` (``recursion``).

Window partitions therefore hold at most one block plus its halo, whatever the
share of the rows a single symbol has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096
RECURSION_BLOCK = 512
_FIRST = Window.unboundedPreceding


def number_rows(
    df: DataFrame,
    keys: list[str],
    ts: str = "ts",
    chunk_seconds: int = 7 * 86400,
    ties: tuple[str, ...] = (),
    out: str = "bar_idx",
    total: str | None = "n_bars",
) -> DataFrame:
    """Number rows 0.. per key in time order; also the row count per key.

    Rows are ranked inside time chunks and shifted by the counts of earlier
    chunks, so the sort is per chunk, not per key.
    """
    chunked = df.withColumn("_chunk", F.floor(F.unix_seconds(F.col(ts)) / chunk_seconds))
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(_FIRST, -1)
    offsets = counts.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(ts, *ties)
    numbered = chunked.join(offsets, [*keys, "_chunk"]).withColumn(
        out, (F.col("_before") + F.row_number().over(in_chunk) - 1).cast("long")
    )
    if total:
        numbered = numbered.withColumn(total, F.col("_total").cast("long"))
    return numbered.drop("_chunk", "_before", "_total")


def block_of(idx: str = "bar_idx", size: int = BLOCK) -> Column:
    return F.floor(F.col(idx) / size).cast("long")


def halo(
    df: DataFrame, before: int = 0, after: int = 0, idx: str = "bar_idx", size: int = BLOCK
) -> DataFrame:
    """Add ``_blk`` and ``_core``; copy edge rows into the neighbouring blocks.

    ``idx`` must be gap-free per key.  Frames reaching at most ``before`` rows
    back and ``after`` rows ahead are complete for rows with ``_core``.
    """
    if max(before, after) > size:
        raise ValueError("frame longer than a block")
    home, offset = block_of(idx, size), F.col(idx) % size
    copies = [F.struct(home.alias("_blk"), F.lit(True).alias("_core"))]
    if before:
        edge = F.struct((home + 1).alias("_blk"), F.lit(False).alias("_core"))
        copies.append(F.when(offset >= size - before, edge))
    if after:
        edge = F.struct((home - 1).alias("_blk"), F.lit(False).alias("_core"))
        copies.append(F.when((offset < after) & (home > 0), edge))
    return df.select("*", F.inline(F.array_compact(F.array(*copies))))


def framed(
    df: DataFrame,
    keys: list[str],
    build,
    before: int = 0,
    after: int = 0,
    idx: str = "bar_idx",
    size: int = BLOCK,
) -> DataFrame:
    """Add window columns with bounded frames.

    ``build(w)`` gets the window specification and returns ``{name: Column}``.
    """
    window = Window.partitionBy(*keys, "_blk").orderBy(idx)
    spread = halo(df, before, after, idx, size)
    return spread.withColumns(build(window)).filter("_core").drop("_blk", "_core")


def running(
    df: DataFrame,
    keys: list[str],
    specs: dict[str, tuple],
    order: str = "bar_idx",
    block: Column | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Running values from the first row of each key up to the current row.

    ``specs`` maps an output name to ``(kind, column)`` or
    ``(kind, column, inclusive)``; kinds: ``sum``, ``max``, ``min``, ``last``
    (last non-null value).  ``block`` is the block number of a row and must be
    non-decreasing in ``order``.
    """
    blocked = df.withColumn("_b", block if block is not None else block_of(order, size))
    reduce_, inputs, carried, merged = [], {}, [], {}
    scan = Window.partitionBy(*keys).orderBy("_b").rowsBetween(_FIRST, -1)
    for out, spec in specs.items():
        kind, value = spec[0], spec[1]
        inclusive = spec[2] if len(spec) > 2 else True
        src, part, carry = f"_x_{out}", f"_p_{out}", f"_c_{out}"
        inputs[src] = value
        rows = (
            Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(_FIRST, 0 if inclusive else -1)
        )
        x = F.col(src)
        if kind == "last":
            at = F.when(x.isNotNull(), F.col(order))
            reduce_.append(F.max_by(x, at).alias(part))
            carried.append(F.last(part, ignorenulls=True).over(scan).alias(carry))
            merged[out] = F.coalesce(F.last(x, ignorenulls=True).over(rows), F.col(carry))
        elif kind == "sum":
            reduce_.append(F.sum(x).alias(part))
            carried.append(F.sum(part).over(scan).alias(carry))
            zero = F.lit(0)
            merged[out] = F.coalesce(F.sum(x).over(rows), zero) + F.coalesce(F.col(carry), zero)
        elif kind in ("max", "min"):
            agg = F.max if kind == "max" else F.min
            pick = F.greatest if kind == "max" else F.least
            reduce_.append(agg(x).alias(part))
            carried.append(agg(part).over(scan).alias(carry))
            merged[out] = pick(agg(x).over(rows), F.col(carry))
        else:
            raise ValueError(kind)
    blocked = blocked.select("*", *[c.alias(n) for n, c in inputs.items()])
    carry_table = blocked.groupBy(*keys, "_b").agg(*reduce_).select(*keys, "_b", *carried)
    joined = blocked.join(carry_table, [*keys, "_b"], "left")
    kept = [c for c in df.columns if c not in merged]
    return joined.select(*kept, *[c.alias(n) for n, c in merged.items()])


def curve(
    df: DataFrame,
    keys: list[str],
    value: str,
    order: list[str],
    block: Column,
    start: float = 0.0,
    floor_at_start: bool = True,
) -> DataFrame:
    """Running total, its peak and the fall from the peak, in ``order``.

    Each block yields its total and its highest partial sum; the scan over the
    blocks gives every block its base and the peak so far.
    """
    rows = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(_FIRST, 0)
    local = df.withColumn("_b", block).withColumn("_s", F.sum(F.coalesce(value, F.lit(0.0))).over(rows))
    local = local.withColumn("_m", F.max("_s").over(rows))
    per_block = local.groupBy(*keys, "_b").agg(
        F.sum(F.coalesce(value, F.lit(0.0))).alias("_t"), F.max("_s").alias("_h")
    )
    scan = Window.partitionBy(*keys).orderBy("_b").rowsBetween(_FIRST, -1)
    based = per_block.withColumn("_base", F.coalesce(F.sum("_t").over(scan), F.lit(0.0)))
    based = based.withColumn("_peak", F.max(F.col("_base") + F.col("_h")).over(scan)).select(
        *keys, "_b", "_base", "_peak"
    )
    total = F.col("_base") + F.col("_s")
    highs = [F.col("_peak"), F.col("_base") + F.col("_m")] + ([F.lit(0.0)] if floor_at_start else [])
    return (
        local.join(based, [*keys, "_b"])
        .withColumns({"equity": start + total, "peak": start + F.greatest(*highs)})
        .withColumn("drawdown", F.col("peak") - F.col("equity"))
        .drop("_b", "_s", "_m", "_base", "_peak")
    )


def _damped_sum(damp: float):
    return lambda acc, c: acc * damp + c


def recursion(
    df: DataFrame,
    keys: list[str],
    specs: dict[str, tuple[Column, float]],
    idx: str = "bar_idx",
    size: int = RECURSION_BLOCK,
) -> DataFrame:
    """``y[i] = a*y[i-1] + u[i]`` with ``y[-1] = 0``, for ``{out: (u, a)}``.

    Inside a block the solution is a running sum of ``u[i]*a**-i`` (0.3 < a < 1
    keeps it in range).  The value carried from earlier blocks is the sum of
    the block results damped by ``a**size`` per block; blocks whose weight is
    below 1e-40 cannot change a double and are left out of that sum.
    """
    pos = F.col(idx) % size
    blocked = df.withColumn("_b", block_of(idx, size)).withColumn("_pos", pos)
    rows = Window.partitionBy(*keys, "_b").orderBy(idx).rowsBetween(_FIRST, 0)
    inputs, reduce_, carried, solved = {}, [], [], {}
    for out, (u, a) in specs.items():
        if not 0.3 < a < 1:
            raise ValueError("decay outside (0.3, 1)")
        src, part, carry = f"_u_{out}", f"_p_{out}", f"_c_{out}"
        inputs[src] = u
        damp = a**size
        depth = max(1, math.ceil(math.log(1e-40) / (size * math.log(a))))
        reduce_.append(F.sum(F.col(src) * F.pow(F.lit(a), size - 1 - F.col("_pos"))).alias(part))
        earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(-depth, -1)
        carried.append(
            F.aggregate(
                F.collect_list(F.coalesce(part, F.lit(0.0))).over(earlier),
                F.lit(0.0),
                _damped_sum(damp),
            ).alias(carry)
        )
        local = F.sum(F.col(src) * F.pow(F.lit(a), -F.col("_pos"))).over(rows)
        solved[out] = F.coalesce(local, F.lit(0.0)) * F.pow(F.lit(a), F.col("_pos")) + F.coalesce(
            F.col(carry), F.lit(0.0)
        ) * F.pow(F.lit(a), F.col("_pos") + 1)
    blocked = blocked.select("*", *[c.alias(n) for n, c in inputs.items()])
    carry_table = blocked.groupBy(*keys, "_b").agg(*reduce_).select(*keys, "_b", *carried)
    joined = blocked.join(carry_table, [*keys, "_b"], "left")
    kept = [c for c in df.columns if c not in solved]
    return joined.select(*kept, *[c.alias(n) for n, c in solved.items()])
