"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are cut into chunks of ``CHUNK`` bytes that overlap (a chunk begins every ``STEP``
bytes). Each byte has a small embedding; ``FILTERS`` learned filters of ``SPAN`` bytes slide over a chunk with a stride, and
each filter keeps its largest response in the chunk. Over all chunks of the text the maximum and the mean of these
responses go, with a bias, into one logistic unit. Embeddings, filters and the unit are trained together by Adam with
hand-written gradients on a bounded sample of labelled rows; the sample's chunks per text are bounded in training only.

When scoring, a filter is a sum of table rows (byte value at each filter position), so the work is a few float additions
per byte, and long texts are handled in pieces of bounded size.

Bounds: ``SAMPLE_ROWS`` labelled rows, drawn by a hash of the text and balanced over the labels; ``TRAIN_CHUNKS`` chunks of each.

Defined results: null and empty texts are scored as the empty text (one chunk of zero bytes). Labels that are null teach
nothing; where one label or none is known, the score is that label's share (0.5 where none). Ids are never read. A text
with several label rows teaches once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 3000
TRAIN_CHUNKS = 12
CHUNK = 256
STEP = 192
SPAN = 8
STRIDE = 4
WIDTH = 8
FILTERS = 24
EPOCHS = 7
BATCH = 32
RATE = 0.004
PIECE = 1024
PER_CHUNK = (CHUNK - SPAN) // STRIDE + 1


def chunks_of(raw: bytes) -> np.ndarray:
    """(chunks, CHUNK) byte values that cover the whole text; the last chunk is filled up with zero bytes."""
    n = max(1, -(-(len(raw) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))


class Model:
    def __init__(self, embed: np.ndarray, filters: np.ndarray, shift: np.ndarray, out: np.ndarray, bias: float, constant: float | None = None):
        self.embed, self.filters, self.shift, self.out, self.bias, self.constant = embed, filters, shift, out, bias, constant

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS): each filter's largest response."""
        found = self.embed[chunks].reshape(len(chunks), CHUNK * WIDTH)
        windows = np.lib.stride_tricks.as_strided(found, (len(chunks), PER_CHUNK, SPAN * WIDTH), (found.strides[0], STRIDE * WIDTH * 4, 4))
        flat = windows.reshape(-1, SPAN * WIDTH) @ self.filters
        return np.maximum(flat.reshape(len(chunks), PER_CHUNK, FILTERS).max(1) + self.shift, 0)

    def scores(self, raws: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raws), self.constant)
        most, total, n = np.zeros((len(raws), FILTERS), np.float32), np.zeros((len(raws), FILTERS)), np.zeros(len(raws))
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            found = self.responses(np.concatenate([c for _, c in waiting]))
            at = 0
            for i, c in waiting:
                own = found[at : at + len(c)]
                np.maximum(most[i], own.max(0), out=most[i])
                total[i] += own.sum(0, dtype=np.float64)
                n[i] += len(c)
                at += len(c)
            waiting.clear()

        for i, raw in enumerate(raws):
            cut = chunks_of(raw)
            for at in range(0, len(cut), PIECE):
                waiting.append((i, cut[at : at + PIECE]))
                held += len(waiting[-1][1])
                if held >= PIECE:
                    flush()
                    held = 0
        if waiting:
            flush()
        pooled = np.concatenate([most, total / n[:, None]], 1)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))


def fit(raws: list[bytes], labels: list[int], prior: float | None = None, seed: int = 11) -> Model:
    """``prior`` is the share of label 1 among all labelled rows, where the sample's differs."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32)
    filters = rng.normal(0, (SPAN * WIDTH) ** -0.5, (SPAN * WIDTH, FILTERS)).astype(np.float32)
    shift, out = np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max() or prior in (0, 1):
        return Model(embed, filters, shift, out, 0.0, constant=float(y.mean()) if len(y) else 0.5)
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weights = {"embed": embed, "filters": filters, "shift": shift, "out": out, "bias": np.zeros(1, np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    cuts = [chunks_of(r) for r in raws]
    step, steps = 0, EPOCHS * -(-len(raws) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(raws))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            picked = [cuts[i] if len(cuts[i]) <= TRAIN_CHUNKS else cuts[i][np.sort(rng.choice(len(cuts[i]), TRAIN_CHUNKS, replace=False))] for i in some]
            sizes = np.array([len(c) for c in picked])
            owner, starts = np.repeat(np.arange(len(some)), sizes), np.cumsum([0, *sizes[:-1]])
            chunks = np.concatenate(picked)
            places = (np.arange(PER_CHUNK) * STRIDE)[:, None] + np.arange(SPAN)
            windows = weights["embed"][chunks[:, places]].reshape(len(chunks) * PER_CHUNK, SPAN * WIDTH)
            raw_out = (windows @ weights["filters"]).reshape(len(chunks), PER_CHUNK, FILTERS)
            best = raw_out.argmax(1)
            pooled = np.take_along_axis(raw_out, best[:, None], 1)[:, 0] + weights["shift"]
            live = np.maximum(pooled, 0)
            mean = np.add.reduceat(live, starts) / sizes[:, None]
            most = np.maximum.reduceat(live, starts)
            z = np.concatenate([most, mean], 1) @ weights["out"] + weights["bias"][0]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * balance[some] / len(some)
            to_pool = error[:, None] * weights["out"]
            top = live == most[owner]
            back = to_pool[owner, FILTERS:] / sizes[owner, None] + np.where(top, to_pool[owner, :FILTERS] / np.add.reduceat(top, starts, dtype=np.float32)[owner], 0)
            back = np.where(pooled > 0, back, 0).astype(np.float32)
            used = windows.reshape(len(chunks), PER_CHUNK, -1)[np.arange(len(chunks))[:, None], best]  # (chunks, FILTERS, SPAN * WIDTH)
            to_bytes = (back[:, :, None] * weights["filters"].T[None]).reshape(-1, WIDTH)
            where = chunks[np.arange(len(chunks))[:, None, None], best[:, :, None] * STRIDE + np.arange(SPAN)].ravel()
            gradients = {
                "embed": np.stack([np.bincount(where, to_bytes[:, k], 256) for k in range(WIDTH)], 1),
                "filters": np.einsum("cf,cfk->kf", back, used), "shift": back.sum(0),
                "out": np.concatenate([most, mean], 1).T @ error + 1e-5 * weights["out"], "bias": np.array([error.sum()]),
            }
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in gradients.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    # The descent weighs both labels alike; the bias goes back to the labels' true shares, so that scores are chances.
    share = float(y.mean()) if prior is None else prior
    bias = float(weights["bias"][0]) + float(np.log(share / (1 - share)))
    return Model(weights["embed"], weights["filters"], weights["shift"], weights["out"], bias)


def train(docs: DataFrame, labels: DataFrame, teaches: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on labelled rows where ``teaches`` (on the labels' columns) holds."""
    known = labels.filter(teaches & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if not counts:
        return fit([], [])
    draw = (F.xxhash64("_id") % 1_000_003 + 1_000_003) % 1_000_003
    each = sample_rows // 2
    rate = F.when(F.col("_label") == 1, int(min(1.0, each / max(1, counts.get(1, 0))) * 1_000_003)).otherwise(int(min(1.0, each / max(1, counts.get(0, 0))) * 1_000_003))
    drawn = F.broadcast(known.filter(draw < rate).limit(2 * sample_rows))  # at most that many ids
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(drawn, "_id")
    picked = rows.orderBy(F.xxhash64("_text"), "_id", "_label").limit(2 * sample_rows).select("_text", "_label").collect()
    return fit([r["_text"].encode("utf-8", "replace") for r in picked], [r["_label"] for r in picked], counts.get(1, 0) / sum(counts.values()))


def with_quality(docs: DataFrame, model: Model, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Adds ``score`` to the columns ``passing`` (all by default; a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand floats
    keep = [c for c in (passing if passing is not None else docs.columns) if c != "score"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in batches:
            yield pd.Series(known.scores([("" if t is None else t).encode("utf-8", "replace") for t in batch]), dtype="float64")

    return docs.select(*keep, score(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("score"))
