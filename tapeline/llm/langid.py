"""Language of texts by a byte convolutional network, trained and applied in numpy.

The trading project has no texts of several languages, so the operator is general: a text has ``text_id`` and ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.text import slices
from tapeline.session import materialize

WINDOW, WIDE, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
REACH = max(WIDTHS)
#: Texts that the fit takes at most for a language, those with the smallest hash of seed and id.
MOST_OF_A_LANGUAGE = 2_000
#: Windows of a text that the fit takes at most, spread over the text.
WINDOWS_OF_A_TEXT = 4
_ASCII = re.compile(rb"[A-Za-z]").search
Net = dict[str, np.ndarray]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over whole rows (256 marks what lies beyond the end), the row of each, and its bytes."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * WINDOW
    held = np.minimum(WINDOW, offsets[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))].astype(np.int16) if len(data) else 0, 256), row, held


def _hidden(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Max-pooled filter values, where each was found, and the stretches of embedded bytes."""
    e = net["embed"][x]
    n = WINDOW - REACH + 1
    stretch = np.concatenate([e[:, j : j + n] for j in range(REACH)], axis=2)
    z = stretch @ net["filters"]
    return z.max(axis=1) + net["bias"], z, stretch


def _mask() -> np.ndarray:
    """A filter of width w sees the first w bytes of a stretch."""
    return np.concatenate([np.repeat((np.arange(REACH) < w).astype(np.float32), WIDE)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def outputs(net: Net, x: np.ndarray, block: int = 128) -> np.ndarray:
    """Log-probabilities of the languages by window."""
    out = [np.maximum(_hidden(net, x[at : at + block])[0], 0) @ net["out"] + net["shift"] for at in range(0, len(x), block)]
    return log_softmax(np.concatenate(out)) if out else np.zeros((0, net["out"].shape[1]), np.float32)


def fit(x: np.ndarray, y: np.ndarray, kinds: int, epochs: int = 6, batch: int = 64, rate: float = 4e-3) -> Net:
    """Adam on the cross entropy of windows."""
    rng = np.random.default_rng(9)
    mask = _mask()
    net = {
        "embed": rng.normal(0, 0.5, (257, WIDE)).astype(np.float32), "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(mask.shape[1], np.float32), "out": rng.normal(0, 0.2, (mask.shape[1], kinds)).astype(np.float32), "shift": np.zeros(kinds, np.float32),
    }
    net["embed"][256] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            part = order[at : at + batch]
            a, z, stretch = _hidden(net, x[part])
            h = np.maximum(a, 0)
            d = np.exp(log_softmax(h @ net["out"] + net["shift"]))
            d[np.arange(len(part)), y[part]] -= 1
            d /= len(part)
            dh = (d @ net["out"].T) * (a > 0)
            top = z.argmax(axis=1)
            found = np.take_along_axis(stretch, top[:, :, None], axis=1)
            grad = {"out": h.T @ d, "shift": d.sum(0), "bias": dh.sum(0), "filters": np.einsum("nf,nfk->kf", dh, found) * mask}
            back = (dh[:, :, None] * net["filters"].T[None]).reshape(len(part), -1, REACH, WIDE)
            embed = np.zeros_like(net["embed"])
            place = top[:, :, None] + np.arange(REACH)
            np.add.at(embed, x[part][np.arange(len(part))[:, None, None], place], back)
            embed[256] = 0
            grad["embed"] = embed
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def train(texts: DataFrame, text_id: str = "text_id", text: str = "text", lang: str = "lang", most: int = MOST_OF_A_LANGUAGE, seed: int = 5) -> tuple[list[str], Net]:
    """Languages, in order, and the network fitted to at most ``most`` texts of each.

    Rows without a text or a language take no part.  Texts are taken by hash,
    ``most`` of each language and a tenth more before the cut; windows of the
    bounded sample are fitted in one task.
    """
    rows = texts.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) > 0))
    order = F.xxhash64(F.lit(seed), F.col(text_id), F.col(text))
    chosen = rows.select(F.col(lang).cast("string").alias("lang"), order.alias("order"), F.col(text).cast("string").alias("text"))
    share = F.least(F.lit(1.0), F.lit(1.1 * most) / F.count(F.lit(1)))
    # A stored table of one row for each language: the planner knows its size and sends it to the texts if it is small, so no text is dealt by
    # language.  Hashes are even, so a share of their range holds about that share of the texts.
    cut = materialize(chosen.groupBy("lang").agg(share.alias("share")))
    chosen = chosen.join(cut, "lang").filter((F.col("order") / 2.0**64 + 0.5) <= F.col("share")).select("lang", "order", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            x, row, _ = windows(data, offsets)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            picked = np.concatenate([np.unique(np.linspace(a, b - 1, WINDOWS_OF_A_TEXT).astype(int)) for a, b in zip(first[:-1], first[1:], strict=True) if b > a] or [np.zeros(0, int)])
            blobs = [w.astype("<i2").tobytes() for w in x[picked]]
            own = pa.array(row[picked])
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(blobs, pa.binary())], names=["lang", "order", "window"])

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("order", "ascending"), ("window", "ascending")])
        kind, order = np.unique(np.array(table.column("lang").to_pylist(), object), return_inverse=True)[1], table.column("order").to_numpy()
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (order[1:] != order[:-1])])
        nth = np.cumsum(new) - 1
        first = nth[np.searchsorted(kind, np.arange(kind.max() + 1))]
        table = table.filter(pa.array(nth - first[kind] < most))
        x = np.frombuffer(b"".join(table.column("window").to_pylist()), "<i2").reshape(-1, WINDOW)
        names, y = np.unique(np.array(table.column("lang").to_pylist(), object), return_inverse=True)
        net = fit(x, y, len(names))
        keys = list(net)
        return pa.table({"name": ["langs", *keys], "langs": [names.tolist(), *[[]] * len(keys)], "shape": [[], *[list(net[k].shape) for k in keys]], "value": [[], *[net[k].ravel().astype(float).tolist() for k in keys]]}, schema=pa.schema([("name", pa.string()), ("langs", pa.list_(pa.string())), ("shape", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]))

    cut_windows = chosen.mapInArrow(cut_up, "lang string, order bigint, window binary").withColumn("one", F.lit(1))
    got = cut_windows.groupBy("one").applyInArrow(fitted, "name string, langs array<string>, shape array<int>, value array<double>").collect()
    langs = next((list(r["langs"]) for r in got if r["name"] == "langs"), [])
    return langs, {r["name"]: np.array(r["value"], np.float32).reshape(r["shape"]) for r in got if r["name"] != "langs"}


def predict(texts: DataFrame, model: tuple[list[str], Net], text_id: str = "text_id", text: str = "text", unknown: str = "und") -> DataFrame:
    """``text_id, lang_pred, score`` of every whole text.

    The log-probabilities of its windows are averaged by their bytes; ``score``
    is the share of the winner.  A text that is null or has no letter is
    ``unknown`` with score 0, as is every text if nothing was learnt.
    """
    langs, net = model
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for part, data, offsets in slices(batches, "text", 1 << 20):
            n = part.num_rows
            raw = data.tobytes()
            lettered = np.zeros(n, bool)
            for i in range(n):
                one = raw[offsets[i] : offsets[i + 1]]
                lettered[i] = bool(_ASCII(one)) or any(map(str.isalpha, one.decode()))
            name, score = np.full(n, unknown, object), np.zeros(n)
            if names:
                x, row, held = windows(data, offsets)
                total = np.zeros((n, len(names)))
                np.add.at(total, row, outputs(weights, x) * held[:, None])
                share = np.exp(log_softmax(total / np.maximum(np.bincount(row, weights=held, minlength=n), 1)[:, None]))
                name = np.where(lettered, np.array(names, object)[share.argmax(1)], unknown)
                score = np.where(lettered, share.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name.tolist(), pa.string()), pa.array(score.astype(float))], names=["text_id", "lang_pred", "score"])

    rows = texts.select(F.col(text_id).cast("bigint").alias("text_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(predicted, "text_id bigint, lang_pred string, score double")
