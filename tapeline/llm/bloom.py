"""A membership filter of fixed size that lets tasks drop most rows before a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.text import mix

#: Bits of a filter, 8 MB, whatever it holds; beyond some ten million keys it lets more and more through, and costs time but no row.
BITS = 26


def _places(keys: np.ndarray) -> list[np.ndarray]:
    h = mix(keys.astype(np.int64).view(np.uint64))
    return [h & np.uint64((1 << BITS) - 1), h >> np.uint64(64 - BITS)]


class Bloom:
    def __init__(self, spark, bits: np.ndarray):
        self.shared = spark.sparkContext.broadcast(bits)

    @classmethod
    def of(cls, rows: DataFrame, key: str) -> Bloom:
        """Bits of all keys; words of 64 bits are merged by Spark, at most ``2**BITS / 64`` rows."""

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

        one = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key")).mapInArrow(marked, "word bigint, bit bigint")
        got = one.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros((1 << BITS) // 64, np.int64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        at = np.flatnonzero(words)
        return cls(rows.sparkSession, (at.astype(np.int32), words[at]))

    def passing(self, batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
        """The rows whose key may be in the filter; null keys are not."""
        at, value = self.shared.value
        words = np.zeros((1 << BITS) // 64, np.uint64)
        words[at] = value.view(np.uint64)
        for b in batches:
            column = b.column(b.schema.get_field_index(key))
            keep = np.ones(len(column), bool)
            for p in _places(np.asarray(column.fill_null(0))):
                keep &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
            keep &= np.asarray(column.is_valid())
            yield b.filter(pa.array(keep))
