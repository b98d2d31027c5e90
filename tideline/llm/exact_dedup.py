"""Exact duplicates through an extendible-hash index on shared files.

Map tasks strip white space, and put equal texts of their own rows together before anything moves, so a text that makes
up a third of the table reaches its owner as one entry per map task. Owner tasks hold ranges of the 64-bit key. Each
builds an extendible-hash directory over its range: a full bucket splits, and the directory doubles when the bucket was
as deep as the directory. Entries of one key are chained; only byte-equal texts join one class. The classes are written
to the shared folder (bucket, key, chain position, digest, row to keep, size), and every row then looks up its class.

Defined results: null text is empty; all empty texts are one class. A null id sorts after all others. Rows that repeat
an id are separate members of their class; when the id is the one kept, each of them says so. Extra columns are ignored
by ``classes`` and kept by ``deduplicated``. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tideline.llm.columns import let_go
from tideline.session import scratch_folder

WHITE = bytes([0x20, *range(0x09, 0x0E)])
RANGE_BITS = 12
BUCKET_ENTRIES = 512
MAX_DEPTH = 20
HELD_BYTES = 48 << 20
_ENTRY = pa.schema([("key", pa.int64()), ("range_", pa.int32()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_CLASS = pa.schema([("bucket", pa.string()), ("key", pa.int64()), ("chain", pa.int32()), ("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_MEMBER = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("digest", pa.string())])


def key_of(digest: bytes) -> int:
    """Signed 64-bit key of a digest."""
    return int.from_bytes(digest[:8], "big", signed=True)


class Directory:
    """Extendible hashing over the low bits of a key: 2**depth slots that point to buckets of at most ``capacity`` keys.

    Copies of one key share one chain. A bucket whose keys still agree in the low MAX_DEPTH bits grows instead of splitting."""

    def __init__(self, capacity: int = BUCKET_ENTRIES):
        self.capacity = capacity
        self.depth = 0
        self.slots: list[dict] = [{"depth": 0, "chains": {}, "low": 0}]

    def chain(self, key: int) -> list:
        """The chain of a key, made when the key is new."""
        while True:
            bucket = self.slots[key & ((1 << self.depth) - 1)]
            found = bucket["chains"].get(key)
            if found is not None:
                return found
            if len(bucket["chains"]) < self.capacity or bucket["depth"] >= MAX_DEPTH:
                bucket["chains"][key] = found = []
                return found
            self._split(bucket)

    def _split(self, bucket: dict) -> None:
        if bucket["depth"] == self.depth:
            self.slots = self.slots + self.slots
            self.depth += 1
        bit = 1 << bucket["depth"]
        upper = {"depth": bucket["depth"] + 1, "low": bucket["low"] | bit, "chains": {k: c for k, c in bucket["chains"].items() if k & bit}}
        bucket["chains"] = {k: c for k, c in bucket["chains"].items() if not k & bit}
        bucket["depth"] += 1
        for slot in range(upper["low"], len(self.slots), bit << 1):
            self.slots[slot] = upper

    def buckets(self) -> Iterator[dict]:
        seen: set[int] = set()
        for bucket in self.slots:
            if id(bucket) not in seen:
                seen.add(id(bucket))
                yield bucket


def _better(a: tuple, b: tuple) -> tuple:
    """Of (n_points, doc_id): more code points, then the smaller id, null last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes]]:
    let_go()
    text = batch.column("text")
    points = pc.utf8_length(text).to_pylist()
    for doc, n, raw in zip(batch.column("doc_id").to_pylist(), points, text.cast(pa.binary()).to_pylist(), strict=True):
        yield doc, n, raw.translate(None, WHITE)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        keys = [key_of(hashlib.sha256(body).digest()) for body in held]
        rows = list(held.values())
        columns = [keys, [(k % (1 << 64)) >> (64 - RANGE_BITS) for k in keys], [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows], list(held)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY)

    for batch in batches:
        for doc, n, body in _bodies(batch):
            row = held.get(body)
            if row is None:
                held[body] = [n, doc, 1]
                size += len(body) + 200
            else:
                row[0], row[1] = _better((row[0], row[1]), (n, doc))
                row[2] += 1
            if size > HELD_BYTES:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, keys, digests = [], [], []
        for doc, _, body in _bodies(batch):
            digest = hashlib.sha256(body)
            docs.append(doc)
            keys.append(key_of(digest.digest()))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((docs, keys, digests), _MEMBER, strict=True)], schema=_MEMBER)


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges: dict[int, Directory] = {}
    for batch in batches:
        for key, range_, doc, points, n, body in zip(*(batch.column(c).to_pylist() for c in _ENTRY.names), strict=True):
            chain = ranges.setdefault(range_, Directory()).chain(key)
            for link in chain:
                if link[3] == body:
                    link[0], link[1] = _better((link[0], link[1]), (points, doc))
                    link[2] += n
                    break
            else:
                chain.append([points, doc, n, body])
    for range_, directory in ranges.items():
        rows = []
        for bucket in directory.buckets():
            name = f"{range_:03x}/{bucket['low']:x}/{bucket['depth']}"
            for key, chain in bucket["chains"].items():
                rows += [(name, key, i, hashlib.sha256(link[3]).hexdigest(), link[1], link[2]) for i, link in enumerate(chain)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CLASS, strict=True)], schema=_CLASS)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def write_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Builds the index of ``docs`` in ``folder`` (a fresh shared one by default) and returns its classes as read back."""
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "exact-index")
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    entries = slim.mapInArrow(_entries, _ddl(_ENTRY))
    entries.repartition("range_").mapInArrow(_own, _ddl(_CLASS)).write.mode("overwrite").parquet(folder)
    return spark.read.schema(_ddl(_CLASS)).parquet(folder)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = write_index(docs, text, doc_id).filter("group_size > 1").select("key", "digest", "keep_id", "group_size")
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = slim.mapInArrow(_members, _ddl(_MEMBER)).join(index, ["key", "digest"], "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(alone, True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stay, with their own columns alone."""
    dropped = classes(docs, text, doc_id).filter(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    body = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]", "")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("bigint").alias("own_id"), F.sha2(body.cast("binary"), 256).alias("digest"))
    gone = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("text_sha256"))
    return rows.join(dropped, gone, "left_anti").select("row.*")
