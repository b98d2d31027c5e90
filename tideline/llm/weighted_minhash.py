"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Words are runs of letters and digits, in lower case; a shingle is five words (all words of a shorter text). A shingle
weighs (1 + ln tf) * (1 + min(ln(N / df), ln RARE) / ln RARE): all shingles found in fewer than one text in ``RARE`` weigh
alike, commoner ones less, down to one half. Only those common ones need document frequencies. They are found in two
passes: Misra-Gries counters per batch of texts, whose errors are added up, give a superset; an exact recount of it follows.
Both are bounded by RARE times the mean number of shingles of a text, however large the corpus; if the errors reach the
threshold, the counters double and the pass repeats.

Each text gets ``BANDS`` * ``ROWS`` samples (Ioffe 2010); the samples of a band make a bucket key. Texts with the same words
are put together first and sampled once. In each bucket every text is compared with one centre, drawn by a hash of text
and bucket, so that centres differ from band to band. A text whose comparison fails is compared again: with a centre of
those that failed in its bucket, and, for each other band, with a centre of the bucket's members that share that band
too. These turns are linear in bucket members times bands. ``connected_components`` unites their links; then every pair of a
bucket that is still in two components is screened: each text outside the bucket's largest component meets all others,
in cells of ``BLOCK`` by ``BLOCK`` texts, by outlines (sums of weights by hash) that give an upper bound of the similarity.
Pairs whose bound reaches the threshold are verified, so no bucket is capped and no pair that shares a band is left out, and
only pairs that pass the bound are emitted. Screening takes texts outside the largest component times bucket members.
Compared pairs are verified by the weighted Jaccard similarity of the whole texts.

Defined results: a text without words (null, empty, punctuation) links with nothing. Rows with equal words are one class
at any frequency. Links are between texts, not ids: a null id sorts last and never names a class that has another id, and rows that repeat an id with
other texts are each in the class of their own text. An empty table gives an empty one.
``kept`` marks the smallest id of a class. Extra columns are ignored by ``classes`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.columns import let_go, release
from tideline.operators.graph import connected_components
from tideline.session import scratch_folder

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
RARE = 64
COUNTERS = 1 << 16
MERGED_WORDS = 1_000_000
PIECE = 1 << 20
COLUMNS = 4096
BLOCK = 512
LEAST_OUTLINE, MOST_OUTLINE = 64, 8192

_WORD_BYTE = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_rng = np.random.default_rng(20260101)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = (_rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def _gamma_two() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 2**16 even levels."""
    want = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < want
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma_two().astype(np.float32)
_LN_C = np.log(_gamma_two()).astype(np.float32)
_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS:
        for base in (_BASE, _BACK):
            steps = np.full(PIECE + 2, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def _piece_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of at most PIECE bytes."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], _WORD_BYTE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, back = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[b] * powers[: len(b)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * back[starts]), starts


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text. Short texts are joined, long ones cut between words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        found, starts = _piece_words(b"\n".join(raw for _, raw in waiting))
        cuts = np.searchsorted(starts, np.cumsum([len(raw) + 1 for _, raw in waiting]))
        for (i, _), part in zip(waiting, np.split(found, cuts[:-1]), strict=True):
            out[i].append(part)
        waiting.clear()

    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "replace")
        at = 0
        while at < len(raw) or not at:
            end = min(len(raw), at + PIECE - 1)
            while end < len(raw) and end > at and _WORD_BYTE[raw[end - 1]]:
                end -= 1  # a word is never cut, unless it fills a whole piece
            end = end if end > at else min(len(raw), at + PIECE - 1)
            if size + end - at + 1 > PIECE and waiting:
                flush()
                size = 0
            waiting.append((i, raw[at:end]))
            size += end - at + 1
            at = max(end, 1)
    if waiting:
        flush()
    return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64) for parts in out]


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _BASE + words[k : len(words) - n + 1 + k]
    return np.unique(_mixed(total), return_counts=True)


class Weights:
    """Weights of shingles: ``common`` hashes (sorted) with their document frequencies, out of ``texts`` texts."""

    def __init__(self, common: np.ndarray, frequency: np.ndarray, texts: int):
        order = np.argsort(common)
        self.common = common[order]
        self.share = (np.log(np.maximum(texts, 1) / np.maximum(frequency[order], 1)) / math.log(RARE)).clip(0, 1)

    def __call__(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weight = np.full(len(found), 2.0)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
            hit = self.common[at] == found
            weight[hit] = 1 + self.share[at[hit]]
        return weight * (1 + np.log(counts))


def samples(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """BANDS * ROWS consistent samples of weighted shingles, each hashed to 64 bits."""
    n_samples = len(_FACTORS)
    best, chosen = np.full(n_samples, np.inf, np.float32), np.zeros(n_samples, np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    rows = np.arange(n_samples)
    for at in range(0, len(found), COLUMNS):
        part, log_s = found[at : at + COLUMNS], log_weight[at : at + COLUMNS]
        x = part[None, :] * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        x *= _MIX[1]
        draws = x.view(np.uint16).reshape(n_samples, len(part), 4)
        r, beta = _R.take(draws[:, :, 3]), draws[:, :, 2] * np.float32(2**-16)
        t = np.floor(log_s / r + beta)
        value = _LN_C.take(draws[:, :, 1]) - r * (t - beta + np.float32(1))
        where = value.argmin(1)
        least = value[rows, where]
        better = least < best
        best[better] = least[better]
        chosen[better] = _mixed(part[where] + t[rows, where].astype(np.int64).astype(np.uint64) * _BASE)[better]
    return chosen


def band_keys(chosen: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for row in chosen.reshape(BANDS, ROWS).T:
        key = _mixed(key * _BASE + row)
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inner = np.minimum(a[1][at], b[1][bt]).sum()
    outer = a[1].sum() + b[1].sum() - inner
    return float(inner / outer) if outer > 0 else 0.0


def _batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    let_go()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            yield some, word_hashes(some.column(column).to_pylist())
    release()


def _counters(most: int):
    """Misra-Gries counters of one task: (hash, count), with the error in the row of a null hash."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, error, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        waiting: list[np.ndarray] = []

        def merge() -> None:
            nonlocal held, counts, error
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            held, where = np.unique(np.concatenate([held, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(held)).astype(np.int64)
            if len(counts) > most:
                cut = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
                held, counts, error = held[counts > cut], counts[counts > cut] - cut, error + int(cut)
            waiting.clear()

        size = 0
        for _, words in _batches(batches):
            waiting += [shingles(w)[0] for w in words]
            texts += len(words)
            size += sum(map(len, words))
            if size > MERGED_WORDS:
                merge()
                size = 0
        if waiting:
            merge()
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *held.view(np.int64).tolist()], pa.int64()), pa.array([error, *counts.tolist()], pa.int64()), pa.array([texts] + [0] * len(held), pa.int64())],
            names=["h", "n", "texts"],
        )

    return count


def _recount(asked: np.ndarray):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[(asked & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for _, words in _batches(batches):
            for w in words:
                found = shingles(w)[0]
                found = found[maybe[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(asked, found), len(asked) - 1)
                total[at[asked[at] == found]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(total)], names=["h", "n"])

    return count


def weights(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> Weights:
    """Document frequencies of all shingles found in at least one text in RARE."""
    slim = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    while True:
        folder = scratch_folder(docs.sparkSession, "shingle-counters")
        slim.mapInArrow(_counters(counters), "h bigint, n bigint, texts bigint").write.mode("overwrite").parquet(folder)
        rows = docs.sparkSession.read.schema("h bigint, n bigint, texts bigint").parquet(folder)
        told = rows.filter("h IS NULL").agg(F.sum("n").alias("error"), F.sum("texts").alias("texts")).first()
        error, texts = told["error"] or 0, told["texts"] or 0
        if not texts:
            return Weights(np.zeros(0, np.uint64), np.zeros(0), 0)
        if error < texts / RARE:
            break
        counters *= 4
    least = texts / RARE
    # At most RARE times the mean number of shingles can be as frequent: a bound that doesn't grow with the corpus.
    asked = rows.filter("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") + error >= least).select("h").collect()
    asked = np.sort(np.array([r["h"] for r in asked], np.int64).view(np.uint64))
    if not len(asked):
        return Weights(asked, np.zeros(0), texts)
    if error == 0:
        exact = rows.filter("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n"))
    else:
        exact = slim.mapInArrow(_recount(asked), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    found = exact.filter(F.col("n") >= least).collect()
    return Weights(np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.float64), texts)


def _sign(shared):
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        for batch, words in _batches(batches):
            digests, bands = [], []
            for w in words:
                digests.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None)
                if len(w):
                    found, counts = shingles(w)
                    bands.append(band_keys(samples(found, weigh(found, counts))))
                else:
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column("text_hash")], names=["doc_id", "digest", "bands", "text_hash"])

    return sign


def _verify(shared):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, last, centre = shared.value, None, None

        def vector(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, counts = shingles(words)
            return found, weigh(found, counts)

        for batch, words in _batches(batches, "member_text"):
            scores = []
            for c, text, w in zip(batch.column("centre").to_pylist(), batch.column("centre_text"), words, strict=True):
                if c != last:
                    last, centre = c, vector(word_hashes([text.as_py()])[0])
                scores.append(similarity(centre, vector(w)))
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("member"), pa.array(scores, pa.float64())], names=["centre", "member", "similarity"])

    return verify


def outline(found: np.ndarray, weight: np.ndarray) -> bytes:
    """Sums of the weights by the low bits of the hashes, rounded up: about as many sums as shingles, a power of two."""
    size = min(max(1 << (len(found) - 1).bit_length(), LEAST_OUTLINE), MOST_OUTLINE)
    sums = np.bincount((found & np.uint64(size - 1)).astype(np.int64), weight, size)
    with np.errstate(over="ignore"):
        short = sums.astype(np.float16)
        return np.where(short < sums, np.nextafter(short, np.float16(np.inf)), short).tobytes()


def _folded(sums: np.ndarray, size: int) -> np.ndarray:
    while sums.shape[-1] > size:
        half = sums.shape[-1] // 2
        sums = sums[..., :half] + sums[..., half:]
    return sums


def possible(asked: list[tuple], others: list[tuple], threshold: float) -> Iterator[tuple]:
    """Pairs of the (member, component, main, weight, outline) of a cell that lie in two components and whose similarity may reach the
    threshold: the least of two sums is never less than the sum of the least weights. Pairs of two texts outside the main
    component come up twice in a bucket and are given once."""
    parts: dict[int, list[tuple]] = {}
    for row in sorted(others, key=lambda r: r[3]):
        parts.setdefault(len(row[4]) // 2, []).append(row)
    tables = []
    for size, rows in parts.items():
        member, component, weight = np.array([r[0] for r in rows], object), np.array([r[1] for r in rows], object), np.array([r[3] for r in rows])
        in_main = np.array([r[1] == r[2] for r in rows])
        tables.append((size, member, component, weight, in_main, {size: np.stack([np.frombuffer(r[4], np.float16) for r in rows]).astype(np.float32)}))
    least = threshold / (1 + threshold) * (1 - 1e-5)  # of the two weights added, for what both have; less what rounding can add
    for one, own, _, heavy, raw in asked:
        sums = np.frombuffer(raw, np.float16).astype(np.float32)
        for size, member, component, weight, in_main, by_size in tables:
            low, high = np.searchsorted(weight, [heavy * threshold * (1 - 1e-5), heavy / max(threshold, 1e-9) * (1 + 1e-5)])
            some = low + np.flatnonzero((component[low:high] != own) & (in_main[low:high] | (member[low:high] > one)))
            if not len(some):
                continue
            width = min(size, len(sums))
            if width not in by_size:
                by_size[width] = _folded(by_size[size], width)
            both = np.minimum(by_size[width][some], _folded(sums, width)).sum(1)
            for k in some[both >= least * (heavy + weight[some])]:
                yield one, member[k]


def _outlines(shared):
    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = shared.value
        for batch, words in _batches(batches):
            weight, raw = [], []
            for w in words:
                found, counts = shingles(w)
                own = weigh(found, counts)
                weight.append(float(own.sum()))
                raw.append(outline(found, own))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(weight, pa.float64()), pa.array(raw, pa.binary())], names=["member", "weight", "outline"])

    return draw


def _screen(threshold: float):
    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def told(pairs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["centre", "member"])

        waiting: list[tuple] = []
        for _, cell in itertools.groupby(rows(), lambda r: r[:3]):
            sides: tuple[list, list] = ([], [])
            for row in cell:
                sides[row[3]].append(row[4:])
            for pair in possible(sides[True], sides[False], threshold):
                waiting.append(pair)
                if len(waiting) == 10_000:
                    yield told(waiting)
                    waiting = []
        yield told(waiting)

    return screen


def _cells(buckets: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, block, asked_block, asked, member, component, main): the members of each bucket that holds several components, by block; and
    those outside its largest component, asked of every block."""
    labelled = buckets.join(placed, "member", "left").select("key", "member", F.coalesce("component", "member").alias("component"))
    counted = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    blocks = largest.select("key", F.col("most.component").alias("main"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("asked_blocks"))

    def dealt(count: str):
        return F.pmod(F.xxhash64("member", "key"), F.col(count))

    def every(count: str):
        return F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1)

    def cell(block, asked_block, asked: bool):
        return F.struct(block.alias("block"), asked_block.alias("asked_block"), F.lit(asked).alias("asked"))

    others = F.transform(every("asked_blocks"), lambda k: cell(dealt("blocks"), k, False))
    asked = F.transform(every("blocks"), lambda k: cell(k, dealt("asked_blocks"), True))
    both = F.concat(others, F.filter(asked, lambda _: F.col("component") != F.col("main")))
    return labelled.join(blocks, "key").select("key", F.explode(both).alias("cell"), "member", "component", "main").select("key", "cell.*", "member", "component", "main")


def united(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signatures, nodes, placed, joined): (doc_id, digest, text_hash) of each row; (node, digest, least) of each text's words, ``least`` the smallest id that has
    them; (member, component) of the nodes that the two turns link; (member, component) of the components that screening links further."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "minhash")
    shared = spark.sparkContext.broadcast(weights(docs, text))
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    hashed = slim.withColumn("text_hash", F.xxhash64("text"))
    hashed.mapInArrow(_sign(shared), "doc_id bigint, digest binary, bands array<bigint>, text_hash bigint").write.parquet(f"{folder}/signatures")
    signed = spark.read.parquet(f"{folder}/signatures")
    # A node stands for the texts of equal words, whatever ids they have; one row speaks for it. Numbers are fixed by writing them.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    told = signed.filter("digest IS NOT NULL").groupBy("digest").agg(first, F.min("doc_id").alias("least"))
    told.select(F.monotonically_increasing_id().alias("node"), "digest", "least", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    named = nodes.select("node", F.col("digest").alias("_digest"), F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
    speaks = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    once = signed.join(named, speaks & (F.col("digest") == F.col("_digest"))).select("node", "bands")
    keys = once.select(F.col("node").alias("member"), F.explode("bands").alias("key")).distinct()
    draw = F.struct(F.xxhash64("member", "key").alias("draw"), F.col("member").alias("id"))
    full = keys.groupBy("key").agg(F.min(draw)["id"].alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys.join(full, "key").write.parquet(f"{folder}/buckets")
    buckets = spark.read.parquet(f"{folder}/buckets")
    wanted = named.join(buckets.select(F.col("member").alias("node")).distinct(), "node", "left_semi")
    hashed.join(wanted, speaks).select("node", "text").dropDuplicates(["node"]).write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        both = (
            pairs.join(texts.select(F.col("node").alias("member"), F.col("text").alias("member_text")), "member")
            .join(texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")), "centre")
        )
        schema = "centre bigint, member bigint, similarity double"
        both.select("centre", "member", "centre_text", "member_text").mapInArrow(_verify(shared), schema).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    compared = buckets.filter("member <> centre")
    first = compare(compared.select("centre", "member").distinct(), "compared-by-bucket")
    good = first.filter(F.col("similarity") >= threshold).select("centre", "member")
    compared.filter("n > 2").join(good, ["centre", "member"], "left_anti").select("key", "member").write.parquet(f"{folder}/failed")
    failed = spark.read.parquet(f"{folder}/failed")
    # Texts that failed meet the members of their bucket that share another band with them, and each other.
    bands = once.select(F.col("node").alias("member"), F.explode("bands").alias("other")).distinct()
    shared_bands = buckets.select("key", "member").join(failed.select("key").distinct(), "key", "left_semi").join(bands, "member").filter("other <> key")
    sub_draw = F.struct(F.xxhash64("member", "key", "other").alias("draw"), F.col("member").alias("id"))
    sub_centres = shared_bands.groupBy("key", "other").agg(F.min(sub_draw)["id"].alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    sub_pairs = failed.join(bands, "member").filter("other <> key").join(sub_centres, ["key", "other"]).select("centre", "member")
    among = failed.join(failed.groupBy("key").agg(F.min(draw)["id"].alias("centre")), "key").select("centre", "member")
    ordered = sub_pairs.union(among).filter("member <> centre").select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member")).distinct()
    known = first.select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member"))
    second = compare(ordered.join(known, ["centre", "member"], "left_anti"), "compared-by-two-bands")
    connected_components(first.union(second).filter(F.col("similarity") >= threshold), "centre", "member").write.parquet(f"{folder}/placed")
    placed = spark.read.parquet(f"{folder}/placed")
    # What is still in two components of a bucket (of two members, the first turn has compared both).
    _cells(buckets.filter("n > 2"), placed).write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    open_texts = texts.join(cells.select(F.col("member").alias("node")).distinct(), "node", "left_semi")
    open_texts.select("node", "text").mapInArrow(_outlines(shared), "member bigint, weight double, outline binary").write.parquet(f"{folder}/outlines")
    cell = ["key", "block", "asked_block"]
    outlined = cells.join(spark.read.parquet(f"{folder}/outlines"), "member").select(*cell, "asked", "member", "component", "main", "weight", "outline")
    screened = outlined.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_screen(threshold), "centre bigint, member bigint")
    passing = screened.select(F.least("centre", "member").alias("centre"), F.greatest("centre", "member").alias("member")).distinct()
    known = known.union(second.select("centre", "member"))
    third = compare(passing.join(known, ["centre", "member"], "left_anti"), "compared-by-outline").filter(F.col("similarity") >= threshold)
    for end in ("centre", "member"):
        names = placed.select(F.col("member").alias(end), F.col("component").alias(f"{end}_component"))
        third = third.join(names, end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))
    connected_components(third, "centre_component", "member_component").write.parquet(f"{folder}/joined")
    joined = spark.read.parquet(f"{folder}/joined")
    return signed.select("doc_id", "digest", "text_hash"), nodes.select("node", "digest", "least"), placed, joined


def _classes(docs: DataFrame, text: str, doc_id: str, threshold: float) -> DataFrame:
    signed, nodes, placed, joined = united(docs, text, doc_id, threshold)
    near = nodes.join(placed.withColumnRenamed("member", "node").withColumnRenamed("component", "near"), "node", "left").withColumn("linked", F.col("near").isNotNull()).withColumn("near", F.coalesce("near", "node"))
    whole = near.join(joined.withColumnRenamed("member", "near").withColumnRenamed("component", "whole"), "near", "left")
    linked = whole.select("digest", "least", F.when(F.col("linked") | F.col("whole").isNotNull(), F.coalesce("whole", "near")).alias("component"))
    names = linked.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component", "left").select("digest", F.coalesce("name", "least").alias("class_id"))
    found = signed.join(named, "digest", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return found.select("doc_id", "class_id", "text_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of the class), kept."""
    return _classes(docs, text, doc_id, threshold).select("doc_id", "class_id", "kept")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` whose id names their class, with their own columns alone."""
    dropped = _classes(docs, text, doc_id, threshold).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("own_id"), F.xxhash64(whole).alias("own_hash"))
    gone = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return rows.join(dropped, gone, "left_anti").select("row.*")
