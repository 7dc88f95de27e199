"""Best-fit packing of trade episodes into training sequences of a fixed number of bars.

An episode is a row with ``trade_id``, ``part`` and ``bars_held``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.session import materialize

#: Rows that one task numbers.
NUMBERED = 100_000


def best_value(worth: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length of the fullest-worth pattern: unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = worth[1 : c + 1] + best[c - 1 :: -1][:c] if c > 1 else worth[1:2] + best[:1]
        j = int(options.argmax())
        if options[j] > best[c - 1]:
            best[c], took[c] = options[j], j + 1
        else:
            best[c], took[c] = best[c - 1], 0
    counts = np.zeros(capacity + 1, np.int64)
    c = capacity
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return counts


def fractional(counts: np.ndarray, rounds: int, eta: float = 0.5) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The configuration program by multiplicative weights: patterns with their amounts, and the best dual bound.

    Weights begin as sizes.  Each round prices the pattern of the greatest weight, takes an equal share of all
    sequences of it (less where that is over what its scarcest length has), and multiplies the weights of its lengths
    by the exponential of minus ``eta`` times the share of them that it covers, halves those of covered lengths, and
    divides all by the largest.  The sum of a pattern's shares is its amount in the mean of all rounds.  Weights are
    prices of the dual program: all lengths at their prices over the dearest pattern is a bound that no packing beats.
    """
    capacity = len(counts) - 1
    size = np.arange(capacity + 1) / capacity
    weight = np.where(counts > 0, size, 0.0)
    covered = np.zeros(capacity + 1)
    share = (counts * size).sum() / rounds
    amounts: dict[bytes, tuple[np.ndarray, float]] = {}
    bound = 0.0
    for _ in range(rounds):
        if not weight.any():
            break
        pattern = best_value(weight, capacity)
        bound = max(bound, float(weight @ counts / (weight @ pattern)))
        used = np.flatnonzero(pattern)
        amount = min(share, max(1.0, float((counts[used] / pattern[used]).min())))
        covered += amount * pattern
        key = pattern.tobytes()
        amounts[key] = (pattern, amounts.get(key, (pattern, 0.0))[1] + amount)
        weight[used] *= np.exp(-eta * np.minimum(1, amount * pattern[used] / counts[used]))
        weight[(counts > 0) & (covered >= counts)] *= 0.5
        weight /= weight.max()
    return list(amounts.values()), bound


def bounded_plan(histogram: dict[int, int], capacity: int, rounds: int = 600) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns ``{length: count}`` with the number of sequences that follow each, and a lower bound of all packings.

    Every length is used exactly as often as it occurs.  The amounts of the fractional solution are rounded, as far as
    the counts reach, largest first; what is left goes by best fit, longest first, into the free room of all sequences
    and into new ones.  If best fit alone needs fewer sequences, that plan is taken.
    The work depends on the number of lengths, at most ``capacity``, not on the number of episodes.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full: list[tuple[dict[int, int], int]] = []
    if counts[capacity]:
        full.append(({capacity: 1}, int(counts[capacity])))
        counts[capacity] = 0
    plain = _best_fit(full, counts, capacity)
    if not counts.any():
        return plain, sum(t for _, t in plain)
    amounts, bound = fractional(counts, rounds)
    done, left = list(full), counts.copy()
    for pattern, amount in sorted(amounts, key=lambda x: -x[1]):
        used = np.flatnonzero(pattern)
        times = int(min(np.floor(amount + 0.5), (left[used] // pattern[used]).min()))
        if times > 0:
            done.append(({int(x): int(pattern[x]) for x in used}, times))
            left -= times * pattern
    priced = _best_fit(done, left, capacity)
    least = int(np.ceil(bound - 1e-6)) + sum(t for _, t in full)
    return min((priced, plain), key=lambda made: sum(t for _, t in made)), least


def plan(histogram: dict[int, int], capacity: int, rounds: int = 600) -> list[tuple[dict[int, int], int]]:
    """The patterns of ``bounded_plan``."""
    return bounded_plan(histogram, capacity, rounds)[0]


def _best_fit(done: list[tuple[dict[int, int], int]], counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The remaining lengths, longest first, each into the sequence with the least room that takes it."""
    by_room: dict[int, list] = {}
    free = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: dict[int, int], times: int) -> None:
        by_room.setdefault(room, []).append((pattern, times))
        free[room] = True

    for pattern, times in done:
        put(capacity - sum(x * n for x, n in pattern.items()), pattern, times)
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = int(fits[0]) + length
                pattern, times = by_room[room].pop()
                free[room] = bool(by_room[room])
                take = min(n, times)
                if times > take:
                    put(room, pattern, times - take)
            else:
                room, pattern = capacity, {}
                each = max(1, min(n, capacity // length))
                take = n // each
                put(room - each * length, {length: each}, take)
                n -= take * each
                continue
            put(room - length, {**pattern, length: pattern.get(length, 0) + 1}, take)
            n -= take
    return [x for found in by_room.values() for x in found]


def _intervals(patterns: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, first sequence, items a sequence, offset), in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((seen.get(length, 0), first, n, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        first += times
    return out


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rank``: a gapless number from 0 within ``by``, counted in blocks so that no value is sorted in one task."""
    blocks = max(1, rows.count() // NUMBERED)
    split = rows.withColumn("_block", F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int"))
    sizes = split.groupBy(by, "_block").count()
    before = sizes.withColumn("_before", F.expr(f"sum(count) over (partition by {by} order by _block) - count")).drop("count")
    ranked = split.withColumn("_in", F.expr(f"row_number() over (partition by {by}, _block order by {order}) - 1"))
    return ranked.join(before, [by, "_block"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_block", "_before", "_in")


def pack_episodes(episodes: DataFrame, capacity: int = 2048, trade_id: str = "trade_id", part: str = "part", bars_held: str = "bars_held", rounds: int = 600) -> DataFrame:
    """``trade_id, part, bars_held, sequence_id, offset`` of every episode, in as few sequences as the plan finds.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the
    driver; episodes of one length are then dealt to the sequences by number.
    Episodes of null or no length take no place: their sequence and offset are
    null.  Longer ones than ``capacity`` raise an error; cut them first.
    Repeated rows are episodes of their own; an empty table stays empty.
    """
    rows = materialize(episodes.select(F.col(trade_id).alias("trade_id"), F.col(part).alias("part"), F.col(bars_held).cast("bigint").alias("bars_held"), F.monotonically_increasing_id().alias("row_id")))
    placed = rows.filter("bars_held > 0")
    histogram = {r["bars_held"]: r["count"] for r in placed.filter(F.col("bars_held") <= capacity).groupBy("bars_held").count().collect()}
    if not placed.filter(F.col("bars_held") > capacity).isEmpty():
        raise ValueError("an episode is longer than a sequence")
    table = _intervals(plan(histogram, capacity, rounds))
    spark = episodes.sparkSession
    item = T.StructType([T.StructField(n, T.LongType()) for n in ("first_rank", "first_sequence", "each", "at")])
    slots = spark.createDataFrame(list(table.items()), T.StructType([T.StructField("bars_held", T.LongType()), T.StructField("slots", T.ArrayType(item))]))
    # At most one row for each length up to the capacity.
    ranked = numbered(placed, "bars_held", "row_id").join(F.broadcast(slots), "bars_held")
    slot = F.element_at(F.filter("slots", lambda s: s["first_rank"] <= F.col("rank")), -1)
    dealt = ranked.withColumn("s", slot).withColumn("n", F.col("rank") - F.col("s.first_rank"))
    out = dealt.select(
        "row_id", (F.col("s.first_sequence") + F.floor(F.col("n") / F.col("s.each"))).alias("sequence_id"),
        (F.col("s.at") + F.pmod(F.col("n"), F.col("s.each")) * F.col("bars_held")).alias("offset"),
    )
    return rows.join(out, "row_id", "left").select("trade_id", "part", "bars_held", "sequence_id", "offset")
