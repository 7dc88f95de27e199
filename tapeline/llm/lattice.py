"""Near copies of signals by cosine: random projections decoded to E8 lattice points.

A signal has ``signal_id`` and ``entry_features``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import graph
from tapeline.llm.text import mix
from tapeline.llm.vectors import matrix, numbered
from tapeline.session import materialize

TABLES, NEIGHBOURS, WIDTH = 5, 5, 1.8
#: Rows of a bucket that one task holds of each side.
BLOCK = 2048


def shortest() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    whole = [np.bincount([i, j], weights=s, minlength=8) for i, j in itertools.combinations(range(8), 2) for s in itertools.product((1.0, -1.0), repeat=2)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and if the sum is odd, round the worst one the other way."""
    point = np.rint(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8: of the even whole points and the same shifted by one half."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int, neighbours: int, width: float, seed: int = 1) -> np.ndarray:
    """Hashes (rows, tables, 1 + neighbours): a vector's own cell and the next nearest ones."""
    rng = np.random.default_rng(seed)
    around = shortest()
    out = np.zeros((len(unit), tables, 1 + neighbours), np.uint64)
    for t in range(tables):
        y = unit @ rng.normal(size=(unit.shape[1], 8)) / width
        centre = decode(y)
        next_ = np.argsort(-((y - centre) @ around.T), axis=1, kind="stable")[:, :neighbours]
        points = np.concatenate([centre[:, None], centre[:, None] + around[next_]], axis=1)
        h = np.full(points.shape[:2], t + 1 + (unit.shape[1] << 16), np.uint64)  # vectors of another length meet in no cell
        for j in range(8):
            h = mix(h * np.uint64(31) + (2 * points[:, :, j]).astype(np.int64).view(np.uint64))
        out[:, t] = h
    return out


def _probed(batches: Iterator[pa.RecordBatch], tables: int, neighbours: int, width: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column(2).to_numpy()
        for d in np.unique(dims):
            part = b.filter(pa.array(dims == d))
            x = matrix(part.column(1))
            h = (cells(x / np.sqrt((x * x).sum(1))[:, None], tables, neighbours, width) >> np.uint64(1)).astype(np.int64).reshape(len(x), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1], dtype=np.int32)), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "probes"])


def _linked(table: pa.Table, least: float, tables: int) -> pa.Table:
    """Numbers of links, each pair counted in the first table and one direction in which it meets, and links that join the block's parts."""
    node, weight = (table.column(c).to_numpy() for c in ("node", "copies"))
    own, bucket = table.column("own").to_numpy(zero_copy_only=False), table.column("table")[0].as_py()
    x = matrix(table.column("vector"))
    x = x / np.sqrt((x * x).sum(1))[:, None]
    probes = matrix(table.column("probes"), np.int64).reshape(len(x), tables, -1)
    owners = np.flatnonzero(own & table.column("here").to_numpy(zero_copy_only=False))
    askers = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
    up, joins, numbers = {}, [], {}

    def root(i: int) -> int:
        while (j := up.get(i, i)) != i:
            i = j
        return i

    for at in range(0, len(askers), 512):
        a = askers[at : at + 512]
        i, j = np.nonzero(x[a] @ x[owners].T >= least)
        i, j = a[i], owners[j]
        i, j = i[node[i] != node[j]], j[node[i] != node[j]]
        for s in range(0, len(i), 4096):
            p, q = i[s : s + 4096], j[s : s + 4096]
            there = (probes[p] == probes[q][:, :, :1]).any(2)
            back = (probes[q] == probes[p][:, :, :1]).any(2)
            first = (there | back).argmax(1) == bucket
            once = first & (~back[:, bucket] | (node[p] < node[q]))
            for u, v in zip(p[once].tolist(), q[once].tolist(), strict=True):
                numbers[node[u]] = numbers.get(node[u], 0) + int(weight[v])
                numbers[node[v]] = numbers.get(node[v], 0) + int(weight[u])
                ru, rv = root(int(node[u])), root(int(node[v]))
                if ru != rv:
                    up[ru] = rv
                    joins.append((int(node[u]), int(node[v])))
    links = [(int(n), None, int(c)) for n, c in numbers.items()] + [(u, v, None) for u, v in joins]
    columns = list(zip(*links, strict=True)) or [[], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "n"), columns, strict=True)})


def near_signals(signals: DataFrame, least: float = 0.95, signal_id: str = "signal_id", entry_features: str = "entry_features", tables: int = TABLES, neighbours: int = NEIGHBOURS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``signal_id, n_links, component_id, kept``: how many other signals have a cosine of at least ``least``, and the components.

    Signals with the same features are one class.  In each of ``tables`` random
    projections to 8 dimensions a class lies in its E8 cell and asks its own
    cell and the ``neighbours`` next nearest ones; pairs that meet are compared
    in double precision where they meet, in blocks of a bucket, so none below
    ``least`` is linked.  A pair just at 0.95 misses one table in both
    directions with probability 0.053, all five with 4 in ten million; closer
    pairs less.  Pairs are counted where they first meet and are not written
    out.

    Signals whose features are null, empty, all zero or hold a null or
    non-finite component link with nothing, as do those with a null id (whose
    component is null) and those of another length.  Repeated ids are signals of
    their own; their components have the smallest id.
    """
    every = numbered(signals, signal_id, entry_features)
    real = every.filter(F.col("signal_id").isNotNull() & (F.col("dims") > 0) & F.exists("vector", lambda v: v != 0))
    classes = real.withColumn("features", F.transform("vector", lambda v: v + F.lit(0.0))).groupBy("features", "dims").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("signal_id").alias("lowest"))
    classes = materialize(classes)
    probed = classes.select("node", F.col("features").alias("vector"), "dims", "copies").mapInArrow(lambda it: _probed(it, tables, neighbours, width), "node bigint, vector array<double>, dims int, copies bigint, probes array<bigint>")
    probed = materialize(probed)
    asked = probed.select("node", F.posexplode("probes").alias("place", "cell")).select("node", "cell", F.floor(F.col("place") / (1 + neighbours)).cast("int").alias("table"), (F.col("place") % (1 + neighbours) == 0).alias("own"))
    loads = asked.groupBy("cell").agg(F.count_if("own").alias("owners"), F.count(F.lit(1)).alias("askers")).filter("owners > 0 and askers > 1")
    met = asked.join(loads.select("cell", F.ceil(F.col("owners") / block).alias("os"), F.ceil(F.col("askers") / block).alias("qs")), "cell").withColumns({"o": F.pmod(F.xxhash64("node"), "os"), "q": F.pmod(F.xxhash64("node"), "qs")})
    zero = F.lit(0).cast("bigint")
    asks = met.withColumn("o", F.explode(F.sequence(zero, F.col("os") - 1))).withColumns({"asks": F.lit(True), "here": F.lit(False)})
    given = met.filter("own").withColumn("q", F.explode(F.sequence(zero, F.col("qs") - 1))).withColumns({"asks": F.lit(False), "here": F.lit(True)})
    both = asks.unionByName(given).groupBy("cell", "table", "o", "q", "node").agg(F.max("own").alias("own"), F.max("asks").alias("asks"), F.max("here").alias("here"))
    parts = both.join(probed.select("node", F.col("vector"), "copies", "probes"), "node")
    found = materialize(parts.groupBy("cell", "o", "q").applyInArrow(lambda t: _linked(t, least, tables), "a bigint, b bigint, n bigint"))
    labels = graph.components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    lowest = named.groupBy("label").agg(F.min("lowest").alias("component_id"))
    named = named.join(lowest, "label").join(counts, "node", "left").select("features", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("component_id").alias("c"))
    out = every.withColumn("features", F.when(F.col("signal_id").isNotNull(), F.transform("vector", lambda v: v + F.lit(0.0)))).join(named, "features", "left")
    component = F.coalesce("c", "signal_id")
    return out.select("signal_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("signal_id") == component, F.lit(False)).alias("kept"))
