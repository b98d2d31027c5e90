"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is lower-cased; bytes that are no letters become one blank; every window of three and of four bytes (word edges
included) is hashed to a row of an embedding table. The mean of the rows goes through a linear softmax. Embeddings and
weights are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows, then a
temperature and a rejection threshold are fitted on rows kept out of the descent. As mean and softmax input are linear,
scoring needs only the product of the two tables: a few floats per window, summed per text over the whole text.

Bounds of the sample: ``SAMPLE_ROWS`` distinct texts in all, spread evenly over all languages that occur, but at least ``LEAST_ROWS`` a
language, drawn by a hash of text, so that copies count once. Everything else reads all rows.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0 and is rejected; rows with a null language
teach nothing; where no row teaches anything every text is ``und``; an empty table gives an empty one. Rows that repeat an id or
a text are scored each by itself and alike. Ties go to the language that sorts first. Ids are
never read. Extra columns are kept by ``with_language`` (its own columns replace columns of the same name).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.columns import let_go, release

SAMPLE_ROWS = 2400
LEAST_ROWS = 40
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 6
MIN_STEPS = 6000
RATE = 0.5
MOST_REJECTING = 0.4
MISS = 0.002
PIECE = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _letters(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_BLANKS) + b"  "


def _rows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the three-byte and of the four-byte window at each position."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    four = three[:-1] | (b[3:] << np.uint32(24))
    return (three * np.uint32(2654435761)) >> np.uint32(17), ((four ^ np.uint32(0x9E3779B9)) * np.uint32(2246822519)) >> np.uint32(17)


def windows(raw: bytes) -> np.ndarray:
    """Table rows of all windows of one text."""
    return np.concatenate(_rows(raw)).astype(np.int64)


class Model:
    """``table``: one row of logits per hash bucket; ``langs`` in sorted order; temperature and threshold."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table.astype(np.float32), bias, temperature, threshold
        self.columns = [np.ascontiguousarray(self.table[:, k]) for k in range(len(langs))]

    def logits(self, raws: list[bytes]) -> np.ndarray:
        """One row per text. Long texts are cut into pieces that overlap by a window; short ones are joined."""
        owner, parts = [], []
        for i, raw in enumerate(raws):
            for at in range(0, len(raw) - 3, PIECE):
                owner.append(i)
                parts.append((raw[at : at + PIECE + 3], min(PIECE, len(raw) - 2 - at), min(PIECE, len(raw) - 3 - at)))
        total, n = np.zeros((len(raws), len(self.langs))), np.zeros(len(raws))
        first = 0
        while first < len(parts):
            last, size = first + 1, len(parts[first][0])
            while last < len(parts) and size + len(parts[last][0]) <= PIECE:
                size += len(parts[last][0])
                last += 1
            group = parts[first:last]
            starts = np.cumsum([0, *(len(g[0]) for g in group[:-1])])
            for kind, found in enumerate(_rows(b"".join(g[0] for g in group) + b"    ")):
                counts = np.array([g[1 + kind] for g in group])
                edges = np.stack([starts, starts + counts], 1).ravel()
                for k, column in enumerate(self.columns):
                    np.add.at(total[:, k], owner[first:last], np.add.reduceat(column[found], edges)[::2])
                np.add.at(n, owner[first:last], counts)
            first = last
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        texts = list(texts)
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = [i for i, t in enumerate(texts) if self.langs and t is not None and _LETTER.search(t)]
        for at in range(0, len(told), 256):
            some = told[at : at + 256]
            z = self.logits([_letters(texts[i]) for i in some]) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, best, row in zip(some, p.argmax(1), p, strict=True):
                names[i], scores[i] = self.langs[best], float(row[best])
        return names, scores


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Trains on labelled texts; every fifth row (in a shuffled order) calibrates only."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    bags = []
    for i in order:
        found, counts = np.unique(windows(_letters(texts[i])), return_counts=True)
        bags.append((found, (counts / max(1, counts.sum())).astype(np.float32), names.index(langs[i])))
    held, learn = bags[::5], [b for i, b in enumerate(bags) if i % 5] or bags
    embed = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    epochs = max(EPOCHS, -(-MIN_STEPS // len(learn)))
    steps, total = 0, epochs * len(learn)
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            found, share, y = learn[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ embed[found]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = weight @ p
            weight -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            embed[found] -= (rate * 20 * share)[:, None] * back  # a row's share of the mean is small: rows learn faster than weights
    model = Model(names, embed @ weight, bias.astype(np.float64))
    z = np.array([share @ model.table[found] + model.bias for found, share, _ in held])
    y = np.array([label for _, _, label in held])

    def chances(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.05, 5, 40)
    losses = [-np.log(np.maximum(chances(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = chances(model.temperature)
    right = p.max(1)[p.argmax(1) == y]
    model.threshold = float(min(MOST_REJECTING, np.quantile(right, MISS))) if len(right) else 0.0
    return model


def train(docs: DataFrame, teaches: Column, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on a sample of the rows where ``teaches`` holds and text and language are given."""
    rows = docs.filter(teaches & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.withColumn("draw", F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)))  # the same for all copies of a text
    found = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()  # one row per language
    if not found:
        return fit([], [])
    each = max(sample_rows // len(found), LEAST_ROWS)
    rates = F.create_map(*(F.lit(v) for r in found for v in (r["lang"], int(min(1.0, 1.5 * each / max(r["n"], 1)) * (1 << 62)))))
    drawn = rows.filter(F.col("draw") <= rates[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    quota = drawn.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("_place") <= each)
    picked = quota.orderBy("lang", "draw").select("text", "lang").collect()  # at most ``each`` distinct texts a language
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets times one float per language

    @F.pandas_udf("lang_pred string, score double, lang_accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        known = shared.value
        for batch in batches:
            names, scores = known.predict(batch)
            yield pd.DataFrame({"lang_pred": names, "score": scores, "lang_accepted": [n != "und" and s >= known.threshold for n, s in zip(names, scores, strict=True)]})
        release()

    return predict


def with_language(docs: DataFrame, model: Model, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and lang_accepted to the columns ``passing`` (all by default)."""
    own = ["lang_pred", "score", "lang_accepted"]
    keep = [c for c in (passing if passing is not None else docs.columns) if c not in own]
    found = docs.select(*keep, _predictor(docs, model)(F.col(text).cast("string")).alias("_found"))
    return found.select(*keep, "_found.lang_pred", "_found.score", "_found.lang_accepted")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is known, with their own columns alone."""
    found = docs.select(F.struct(*docs.columns).alias("row"), _predictor(docs, model)(F.col(text).cast("string")).alias("found"))
    return found.filter("found.lang_accepted").select("row.*")
