"""Order-dependent selection: keep a row when the last kept row is over.

``until`` says how long a kept row blocks the ones after it (a fixed gap, a
holding time).  The result depends on the order, yet chunks of a key's rows can
be solved apart: where the selection ends in a chunk depends only on which row
it starts with, and these chains merge quickly.  Each chunk is summarised as a
short list of (latest blocking time, end).  Such step functions compose, so
neighbouring chunks are joined ``FAN`` at a time, level by level, to one
function of the whole key; the blocking times come down the same levels, and
every chunk is then selected from its known start.  Chunks are cut by time, and
where that leaves more than ``ROWS`` rows, at approximate quantiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import materialize

#: Rows of a chunk, chunks joined at a time, summaries that one task holds.
ROWS, FAN, GROUP = 50_000, 64, 4096


def _next_free(start: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Index of the first later row that starts when row i is over."""
    after = np.arange(1, len(start) + 1)
    return np.maximum(after, np.searchsorted(start, until, side="left"))


def chunk_summary(start: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uppers, ends): blocked until b <= uppers[k] (first such k) ends at ends[k]."""
    nxt, n = _next_free(start, until), len(start)
    end = until.copy()
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            end[i] = end[nxt[i]]
    last_of_run = np.append(end[1:] != end[:-1], True)
    return start[last_of_run], end[last_of_run]


def composed(uppers: list[np.ndarray], ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The summary of neighbouring chunks from theirs, in order."""
    upper, end = uppers[0], ends[0]
    for u, e in zip(uppers[1:], ends[1:]):
        k = np.searchsorted(u, end, side="left")
        inside = k < len(u)
        through = np.where(inside, e[np.minimum(k, len(u) - 1)], end) if len(u) else end
        later = u > upper[-1] if len(upper) else np.ones(len(u), bool)
        upper, end = np.concatenate([upper, u[later]]), np.concatenate([through, e[later]])
        last_of_run = np.append(end[1:] != end[:-1], True)
        upper, end = upper[last_of_run], end[last_of_run]
    return upper, end


def walk(uppers: list[np.ndarray], ends: list[np.ndarray], blocked: int = np.iinfo(np.int64).min) -> list[int]:
    """Blocking time on entry to each chunk, from that on entry to the first."""
    entry = []
    for upper, end in zip(uppers, ends):
        entry.append(blocked)
        k = np.searchsorted(upper, blocked, side="left")
        if k < len(upper):
            blocked = int(end[k])
    return entry


def select(start: np.ndarray, until: np.ndarray, blocked: int) -> np.ndarray:
    keep = np.zeros(len(start), dtype=bool)
    nxt, i = _next_free(start, until), int(np.searchsorted(start, blocked, side="left"))
    while i < len(start):
        keep[i] = True
        i = int(nxt[i])
    return keep


def _runs(pdf: pd.DataFrame, by: list[str], order: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in order within their keys, and where each key's run starts and the last one ends."""
    pdf = pdf.sort_values([*by, *order], kind="stable", ignore_index=True)
    new = np.ones(len(pdf) + 1, dtype=bool)
    if len(pdf) > 1:
        new[1:-1] = np.any([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in by], axis=0)
    return pdf, np.flatnonzero(new)


def _chunks(df: DataFrame, keys: list[str], start: str, chunk: int) -> DataFrame:
    """Rows with ``_c, _s``: their time chunk and the piece of it, of about ``ROWS`` rows at most, that holds their start."""
    timed = df.withColumn("_c", F.floor(F.col(start) / chunk).cast("long"))
    full = materialize(timed.groupBy(*keys, "_c").count().filter(F.col("count") > ROWS))
    pieces = F.ceil(F.col("count") / ROWS)
    shares = F.transform(F.sequence(F.lit(1), F.greatest(pieces - 1, F.lit(1))), lambda i: i / pieces)
    cuts = timed.join(full, [*keys, "_c"], "left_semi").groupBy(*keys, "_c").agg(F.percentile_approx(start, F.array(*[F.lit(i / 1000) for i in range(1, 1000)]), F.lit(10_000)).alias("_q"))
    wanted = F.array_distinct(F.transform(shares, lambda x: F.element_at("_q", F.greatest(F.lit(1), F.round(x * 1000).cast("int")))))
    cuts = materialize(cuts.join(full, [*keys, "_c"]).select(*keys, "_c", F.when(F.col("count") > ROWS * 1000, F.array_distinct("_q")).otherwise(wanted).alias("_cuts")))
    piece = F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col(start))), F.lit(0))
    return timed.join(cuts, [*keys, "_c"], "left").withColumn("_s", piece).drop("_cuts")


def _step_schema(key_fields: list, *names: str) -> T.StructType:
    kinds = {"_u": T.ArrayType(T.LongType()), "_e": T.ArrayType(T.LongType()), "_s": T.IntegerType(), "_h": T.IntegerType()}
    return T.StructType([*key_fields, *[T.StructField(n, kinds.get(n, T.LongType())) for n in names]])


def _arrays(pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.asarray(x, np.int64) for x in pdf["_u"]], [np.asarray(x, np.int64) for x in pdf["_e"]]


def _entries(nodes: DataFrame, keys: list[str], key_fields: list, top: int) -> DataFrame:
    """``keys, _i, _in``: blocking time on entry to node ``_i`` of each key; ``top`` is the largest number of a node."""
    placed = _step_schema(key_fields, "_i", "_in")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = _runs(pdf, keys, ["_i"])
        ups, ends = _arrays(pdf)
        pdf["_in"] = [x for a, b in zip(edges[:-1], edges[1:]) for x in walk(ups[a:b], ends[a:b])]
        return pdf[[*keys, "_i", "_in"]]

    if top < FAN:
        return nodes.groupBy("_h").applyInPandas(first, placed)

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = _runs(pdf, keys, ["_i"])
        ups, ends = _arrays(pdf)
        done = [composed(ups[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        head = pdf.iloc[edges[:-1]][[*keys, "_h", "_n"]].reset_index(drop=True).rename(columns={"_n": "_i"})
        return head.assign(_u=[x.tolist() for x, _ in done], _e=[y.tolist() for _, y in done])

    def descend(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = _runs(pdf, keys, ["_i"])
        above, _ = _runs(above, keys, ["_n"])  # one row for each key, in the same order
        ups, ends = _arrays(pdf)
        pdf["_in"] = [x for a, b, v in zip(edges[:-1], edges[1:], above["_in"]) for x in walk(ups[a:b], ends[a:b], int(v))]
        return pdf[[*keys, "_i", "_in"]]

    bunched = nodes.withColumn("_n", F.floor(F.col("_i") / FAN))
    united = materialize(bunched.groupBy("_n", "_h").applyInPandas(unite, _step_schema(key_fields, "_h", "_i", "_u", "_e")))
    above = _entries(united, keys, key_fields, top // FAN)
    above = united.select(*keys, "_i", "_h").join(above, [*keys, "_i"]).withColumnRenamed("_i", "_n")
    return bunched.groupBy("_n", "_h").cogroup(above.groupBy("_n", "_h")).applyInPandas(descend, placed)


def greedy_keep(df: DataFrame, keys: list[str], start: str, until: str, tie: str, chunk: int, batches: int = 64) -> DataFrame:
    """Rows kept by the rule; ``start``/``until`` are long, ``chunk`` in their unit.

    Keys of a chunk are solved ``1 / batches`` of them at a time, so that many
    small keys do not cost a call each.  Of the summaries of one key, a task
    holds ``FAN`` at a time.
    """
    columns, by_chunk = df.columns, [*keys, "_c", "_s"]
    key_fields = [f for f in df.schema.fields if f.name in keys]
    chunked = _chunks(df, keys, start, chunk).withColumn("_h", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = _runs(pdf, keys, [start, tie])
        s, u = pdf[start].to_numpy(np.int64), pdf[until].to_numpy(np.int64)
        done = [chunk_summary(s[a:b], u[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        head = pdf.iloc[edges[:-1]][by_chunk].reset_index(drop=True)
        return head.assign(_u=[x.tolist() for x, _ in done], _e=[y.tolist() for _, y in done])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, edges = _runs(pdf, keys, [start, tie])
        s, u, blocked = (pdf[c].to_numpy(np.int64) for c in (start, until, "_in"))
        kept = np.concatenate([select(s[a:b], u[a:b], int(blocked[a])) for a, b in zip(edges[:-1], edges[1:])])
        return pdf.loc[kept, columns]

    slim = chunked.select(*by_chunk, "_h", start, until, tie)
    summary = materialize(slim.groupBy("_c", "_s", "_h").applyInPandas(summarise, _step_schema(key_fields, "_c", "_s", "_u", "_e")))
    numbered = summary.withColumn("_i", F.expr(f"cast(row_number() over (partition by {', '.join(keys)} order by _c, _s) - 1 as bigint)"))
    size, top = numbered.agg(F.count(F.lit(1)), F.coalesce(F.max("_i"), F.lit(0))).first()
    spread = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-size // GROUP)))).cast("int")
    nodes = materialize(numbered.withColumn("_h", spread))
    entry = _entries(nodes.select(*keys, "_i", "_h", "_u", "_e"), keys, key_fields, top)
    entry = materialize(nodes.select(*by_chunk, "_i").join(entry, [*keys, "_i"]).drop("_i"))
    return chunked.join(entry, by_chunk).groupBy("_c", "_s", "_h").applyInPandas(pick, df.schema)
