"""Ranked lexical search over hashed max-sketches.

Terms are runs of letters, digits and non-ASCII characters, A-Z lowered. Weights and scores are the integers of ``weight`` and
``impact``; a document's score for an item adds up weight times impact over the item's terms.

``build`` reads every text once and writes an index to the shared folder: a row per document (id, number of terms, sketch,
text) and rows (term, documents that hold it), partial counts of a task. A sketch has ``ROWS`` rows of B coordinates of one
byte, B a power of two at twice the distinct terms or above. Each term falls on one coordinate of every row, and a coordinate
holds the greatest frequency of its terms. As the impact grows with the frequency, a coordinate stands for the greatest
impact that has fallen on it; 255 stands for 255 and more, whose impact is below 10**6.

``search`` takes the items in blocks of at most ``BLOCK_TERMS`` terms. For each document all terms of a block are looked up in its
sketch at once; the least of a term's coordinates bounds its impact, and their weighted sum bounds the score of every item.
In a batch each item takes the documents by falling bound and scores them exactly, from the whole text, until the bound is
under the item's threshold: the ``top``-th best score that the task has found. A bound equal to the threshold is still scored, so ties
are kept. A task gives at most ``top`` rows an item; a ranking of those ends the search. Nothing is sampled or capped: what a
sketch lets through for nothing costs time alone.

Defined results: a null text has no terms, and a document without terms counts nowhere. An item without terms, or whose terms occur nowhere, gets no rows. Rows that
repeat a document id are documents of their own; rows that repeat an item id are items of their own. Equal scores rank by document id, null last. An empty table on
either side gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tideline.llm.columns import let_go, release
from tideline.session import scratch_folder

TOP = 10
ROWS = 4
LEAST, MOST = 64, 1 << 20
HELD_TERMS = 200_000
BLOCK_TERMS = 50_000
PIECE = 4 << 20
BATCH = 256
_INDEX = "doc_id bigint, n bigint, sketch binary, text string, term binary, df bigint"
_FOUND = "item bigint, doc_id bigint, score bigint"

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impact(frequency, length_factor):
    """Works on integers and on integer arrays."""
    return (1_000_000_000 * frequency) // (1000 * frequency + 8 * length_factor)


def length_factor(n: int, documents: int, terms: int) -> int:
    return 10 + (90 * n * documents) // terms


def term_counts(text: str | None) -> Counter:
    """How often each term occurs. Long texts are read piece by piece, cut where no term is."""
    found: Counter = Counter()
    raw = (text or "").encode("utf-8", "replace").translate(_LOWERED)
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            last = _TERM.match(raw, end)
            end = last.end() if last else end
        found.update(_TERM.findall(raw, at, end))
        at = end
    return found


def _places(terms: Iterable[bytes]) -> np.ndarray:
    """ROWS hashes of 32 bits for each term."""
    first = np.fromiter(map(zlib.crc32, terms), np.uint64)
    mixed = (first[None, :] + np.uint64(1)) * _STEPS[:, None]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64)


def sketch(counts: Counter) -> bytes:
    """Coordinatewise maxima of the frequencies."""
    if not counts:
        return b""
    size = min(MOST, max(LEAST, 1 << (2 * len(counts) - 1).bit_length()))
    cells = np.zeros((ROWS, size), np.uint8)
    value = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255).astype(np.uint8)
    for row, place in zip(cells, _places(counts), strict=True):
        np.maximum.at(row, place & (size - 1), value)
    return cells.tobytes()


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    names = ["doc_id", "n", "sketch", "text", "term", "df"]
    held: Counter = Counter()

    def told() -> pa.RecordBatch:
        n = len(held)
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            some = batch.slice(at, BATCH)
            totals, sketches = [], []
            for text in some.column("text"):
                counts = term_counts(text.as_py())
                totals.append(counts.total())
                sketches.append(sketch(counts))
                held.update(counts.keys())
            n = some.num_rows
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(totals, pa.int64()), pa.array(sketches, pa.binary()), some.column("text"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
            if len(held) > HELD_TERMS:
                yield told()
                held = Counter()
    yield told()
    release()


@dataclass(frozen=True)
class Index:
    folder: str
    documents: int
    terms: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(self.folder)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of all documents; further searches can use it."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "max-sketches")
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    slim.mapInArrow(_index, _INDEX).write.parquet(folder)
    known = spark.read.schema(_INDEX).parquet(folder).filter("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    return Index(folder, known["documents"], known["terms"] or 0)


class Items:
    """A block of items as arrays: the distinct terms with weights, and each item's terms in a row."""

    def __init__(self, items: list[tuple[int, list[bytes]]], weights: dict[bytes, int]):
        kept = [(number, [t for t in terms if weights.get(t)]) for number, terms in items]
        kept = [(number, terms) for number, terms in kept if terms]
        self.numbers = [number for number, _ in kept]
        self.terms = sorted({t for _, terms in kept for t in terms})
        place = {t: i for i, t in enumerate(self.terms)}
        self.place = place
        self.weights = np.array([weights[t] for t in self.terms], np.int64)
        self.flat = np.array([place[t] for _, terms in kept for t in terms], np.int64)
        self.starts = np.cumsum([0, *(len(terms) for _, terms in kept)])[:-1].astype(np.int64)
        self.hashes = _places(self.terms)

    def sums(self, worth: np.ndarray) -> np.ndarray:
        """Per item, the sum over its terms."""
        return np.add.reduceat(worth[self.flat], self.starts)

    def bounds(self, raw: bytes, factor: int) -> np.ndarray:
        cells = np.frombuffer(raw, np.uint8).reshape(ROWS, -1)
        least = cells[0][self.hashes[0] & (cells.shape[1] - 1)]
        for row, place in zip(cells[1:], self.hashes[1:], strict=True):
            least = np.minimum(least, row[place & (cells.shape[1] - 1)])
        table = impact(np.arange(256, dtype=np.int64), factor)
        table[255] = 1_000_000
        return self.sums(self.weights * table[least])

    def scores(self, counts: Counter, factor: int) -> np.ndarray:
        worth = np.zeros(len(self.terms), np.int64)
        for term in counts.keys() & self.place.keys():
            i = self.place[term]
            worth[i] = int(self.weights[i]) * impact(counts[term], factor)
        return self.sums(worth)


class Best:
    """The best ``top`` (score, id) of an item so far."""

    def __init__(self, top: int):
        self.top, self.rows, self.threshold = top, [], 1

    def offer(self, score: int, doc: int | None) -> None:
        if score < self.threshold:
            return
        self.rows.append((-score, doc is None, doc or 0))
        self.rows.sort()
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.threshold = -self.rows[-1][0]


def _search(shared, documents: int, terms: int, top: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        items: Items = shared.value
        best = [Best(top) for _ in items.numbers]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                some = batch.slice(at, BATCH)
                ids, texts = some.column("doc_id").to_pylist(), some.column("text")
                factors = [length_factor(n, documents, terms) for n in some.column("n").to_pylist()]
                bounds = np.stack([items.bounds(raw, f) for raw, f in zip(some.column("sketch").to_pylist(), factors, strict=True)])
                exact: dict[int, np.ndarray] = {}
                wanted = np.flatnonzero((bounds >= [b.threshold for b in best]).any(0))
                for q in wanted.tolist():
                    for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                        if bounds[i, q] < best[q].threshold:
                            break
                        if i not in exact:
                            exact[i] = items.scores(term_counts(texts[i].as_py()), factors[i])
                        best[q].offer(int(exact[i][q]), ids[i])
        rows = [(number, None if missing else doc, -low) for number, b in zip(items.numbers, best, strict=True) for low, missing, doc in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["item", "doc_id", "score"])
        release()

    return search


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """Items with their terms, in blocks of at most BLOCK_TERMS terms (but at least one item)."""
    block, size = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        terms = list(term_counts(row["text"]))
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((number, row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of every item."""
    spark = items.sparkSession
    rows = index.rows(spark)
    slim = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    folder = scratch_folder(spark, "found")
    kind = slim.schema["item_id"].dataType.simpleString()
    for k, block in enumerate(_blocks(slim)):
        asked = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, _, terms in block for t in terms})], "term binary")
        counted = rows.filter("term IS NOT NULL").select("term", "df").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df"))  # BLOCK_TERMS terms at most, or one item's
        weights = {bytes(r["term"]): weight(index.documents, r["df"]) for r in counted.collect()}
        shared = Items([(number, terms) for number, _, terms in block], weights)
        if not shared.numbers:
            continue
        sent = spark.sparkContext.broadcast(shared)
        found = rows.filter("n > 0").select("doc_id", "n", "sketch", "text").mapInArrow(_search(sent, index.documents, index.terms, top), _FOUND)
        names = spark.createDataFrame([(number, name) for number, name, _ in block], f"item bigint, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        ranked.join(names, "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/block={k}")
    schema = f"item_id {kind}, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/block=-1")  # so that there is a table where no item has a term
    return spark.read.schema(schema).parquet(folder).select("item_id", "rank", "doc_id", "score")
