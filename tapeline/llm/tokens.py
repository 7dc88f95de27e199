"""Token ids of whole texts with the installed tokenizers, word by word."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of these characters only are split into words here, as the tokenizer's own pattern does after taking lower case letter by letter.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xff]*").fullmatch
_LETTER = "a-z\xdf-\xf6\xf8-\xff"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+").findall
CACHE = 600_000
#: Longer words are encoded each time, so that what is kept stays small.
LONGEST = 48


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; the ids of words met before are looked up."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, found: set[str]) -> None:
        """Make words known: they are encoded together, and every word ends with an end-of-word piece."""
        new = list(found.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(found)
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            ids = np.frombuffer(self.whole([" ".join(part)])[0], "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                raw, to = ids.tobytes(), (ends * 4).tolist()
                self.known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *to], to, strict=False))
            else:
                self.known.update(zip(part, self.whole(part), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [_WORDS(t.lower()) if _PLAIN(t) and "<|" not in t else None for t in texts]
        self.learn({w for s in split if s for w in s if len(w) <= LONGEST})
        odd = iter(self.whole([t for t, s in zip(texts, split, strict=True) if s is None]))
        known, out = self.known, []
        for s in split:
            if s is None:
                out.append(next(odd))
                continue
            try:
                out.append(b"".join([known[w] for w in s]))
            except KeyError:
                out.append(b"".join([known[w] if w in known else self.whole([w])[0] for w in s]))
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One per Python worker."""
    return Encoder(name)


def token_pieces(logs: DataFrame, tokenizer: str, log_id: str = "log_id", message: str = "message", longest: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of at most ``longest`` token ids: ``log_id, piece, start, length, ids_crc32``.

    A message is its ids and then the id ``end``; only longer ones are cut.  The
    checksum is over little-endian unsigned 32-bit ids.  Null is the empty
    message, which is one piece with the end id.
    """
    stop = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                ids = [x + stop for x in encode([t or "" for t in texts.slice(at, 256).to_pylist()])]
                rows = [(i, p, p * longest, x[4 * p * longest : 4 * (p + 1) * longest]) for i, x in enumerate(ids) for p in range(-(-len(x) // (4 * longest)))]
                row, piece, start, raw = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, 256).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ], names=["log_id", "piece", "start", "length", "ids_crc32"])

    rows = logs.select(F.col(log_id).cast("bigint").alias("log_id"), F.col(message).cast("string").alias("message"))
    return rows.mapInArrow(cut, "log_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
