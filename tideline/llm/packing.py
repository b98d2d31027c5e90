"""Packs tokenised documents into sequences by bounded-space online best-fit.

Texts become ids (one end id after each), documents longer than a sequence are cut into whole sequences and a rest, and
the pieces, a few numbers each, are written to the shared folder. Pieces are dealt at random to as many packing tasks as
keep each near ``SHARD_PIECES``; every task packs its pieces as they come, longest first. It keeps a fixed number of open bins. A bitset has
bit f set when an open bin has f free tokens, so the tightest bin that takes a piece is the lowest set bit at or above
its length: one shift and one mask. When no bin takes the piece and all are open, the fullest bin closes first.

Ids come from the library, once per distinct word: the vocabulary's splitting never joins across a blank, tab or line
end, nor a small Latin-1 letter with ASCII punctuation at the end of a word, so a text's ids are its words' ids in a row. Words are kept in
a table of at most about ``KEPT_BYTES``, long texts go part by part. Texts are never cut short.

Defined results: null text is empty and gives one piece that holds the end id alone. Rows that repeat an id are packed
as documents of their own. Offsets in a sequence are gapless from 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.columns import kept, release
from tideline.session import scratch_folder

SEQUENCE = 4096
END_ID = 1
OPEN_BINS = 1 << 15
SHARD_PIECES = 100_000
KEPT_BYTES = 48 << 20
PART = 4 << 20
_ENTRY = 120  # what a word costs in the table besides its letters and ids
_LOWERED = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\r" else b for b in range(256))
_BLANKS = bytes(32 if b in b"\t\n\r" else b for b in range(256))
_BLANK = re.compile(rb"[ \t\n\r]")
_SMALL = {bytes([b]) for b in range(97, 123)}
_LATIN = {chr(c).encode() for c in range(0xDF, 0x100) if c != 0xF7}
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PLACED = f"{_PIECES}, sequence_id bigint, offset bigint"


class Words(dict):
    """Little-endian 32-bit ids of each word, as bytes. Keys are UTF-8 with A-Z lowered, but for words that hold an added token
    when lowered: those keep their case, as added tokens are matched by the letter."""

    def __init__(self, path: str, most_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        super().__init__({b"": b""})
        self.library = Tokenizer.from_file(path)
        self.most_bytes, self.bytes = most_bytes, 0
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.library.get_added_tokens_decoder().values()) or b"(?!)", re.I)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def split(self, raw: bytes) -> list[bytes]:
        """Words of a text between blanks, tabs and line ends."""
        words = raw.translate(_LOWERED).split(b" ")
        if self.added.search(raw):
            cased = raw.translate(_BLANKS).split(b" ")
            words = [c if self.added.search(c) else w for w, c in zip(words, cased, strict=True)]
        return words

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that are new. ASCII punctuation that follows a small Latin-1 letter at the end is encoded by itself."""
        if self.bytes > self.most_bytes:  # what the present words don't need goes
            present = {w: self[w] for w in words & self.keys()} | {b"": b""}
            self.clear()
            self.update(present)
            self.bytes = sum(map(len, present)) + sum(map(len, present.values())) + _ENTRY * len(present)
        new = words.difference(self)
        runs, rest, parted = [], [], []
        asked: set[bytes] = set()
        risky = self.added.search(b" ".join(new)) is not None
        for word in new:
            base = word.rstrip(_PUNCTUATION)
            if base != word and (base[-1:] in _SMALL or base[-2:] in _LATIN) and not (risky and self.added.search(word)):
                parted.append(word)
                asked.add(base)
                asked.add(word[len(base) :])
            elif word.isalpha():
                runs.append(word.decode())
            else:
                shown = word.decode()
                (runs if shown.isalpha() and max(shown) <= "\u00ff" else rest).append(shown)
        for word in asked.difference(self, new):
            shown = word.decode()
            (runs if shown.isalpha() and max(shown) <= "\u00ff" else rest).append(shown)
        self._runs(runs)
        for word, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[word.encode()] = np.array(found.ids, "<u4").tobytes()
        for word in parted:
            base = word.rstrip(_PUNCTUATION)
            self[word] = self[base] + self[word[len(base) :]]
        self.bytes += 2 * sum(map(len, new)) + _ENTRY * (len(runs) + len(rest) + len(parted))

    def _runs(self, words: list[str]) -> None:
        """Words of Latin-1 letters only, many to a call: each ends with its one token that is marked as a word's end."""
        joined = [" ".join(words[at : at + 100]) for at in range(0, len(words), 100)]
        for i, found in enumerate(self.library.encode_batch_fast(joined, add_special_tokens=False)):
            some = words[100 * i : 100 * i + 100]
            ids = np.array(found.ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(some) + 1:
                raise ValueError("the vocabulary doesn't mark the end of each word")
            raw = ids.tobytes()
            self.update(zip(map(str.encode, some), (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))


def _words(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    return kept(("words", path), lambda: Words(path))


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about PART bytes that end before a blank."""
    at = 0
    while len(raw) - at > PART and (blank := _BLANK.search(raw, at + PART)):
        yield raw[at : blank.start()]
        at = blank.end()
    yield raw[at:]


def _encoded(table: Words, texts: Iterable[bytes]) -> Iterator[bytes]:
    """Ids of each text; texts are taken together up to PART bytes, longer ones go part by part."""
    waiting, size = [], 0

    def flush() -> Iterator[bytes]:
        split = [table.split(raw) for raw in waiting]
        table.learn(set().union(*split))
        yield from (b"".join(map(table.__getitem__, words)) for words in split)

    for raw in texts:
        if waiting and size + len(raw) > PART:
            yield from flush()
            waiting, size = [], 0
        if len(raw) <= PART:
            waiting.append(raw)
            size += len(raw)
            continue
        whole = bytearray()
        for part in _parts(raw):
            words = table.split(part)
            table.learn(set(words))
            whole += b"".join(map(table.__getitem__, words))
        yield bytes(whole)
    yield from flush()


def _cut(path: str, sequence: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _words(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = (value.as_buffer().to_pybytes() for value in some.column("text"))
                rows = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), _encoded(table, texts), strict=True):
                    raw = ids + end
                    for piece, start in enumerate(range(0, len(raw), 4 * sequence)):
                        part = raw[start : start + 4 * sequence]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return cut


class OpenBins:
    """At most ``most`` open bins of ``size`` tokens, found by free space through a bitset."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of that length."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.size, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(found)
            self.bits |= 1 << rest
            self.count += 1
        return found, self.size - free


def _pack(sequence: int, most: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, OpenBins(sequence, most)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            found = [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "sequence_id", "offset"])

    return pack


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32. ``path`` is the vocabulary's place on every machine."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(_cut(path, sequence, end_id), _PIECES)


def packed(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "pieces")
    pieces(docs, path, doc_id, text, sequence, end_id).write.mode("overwrite").parquet(folder)
    written = spark.read.schema(_PIECES).parquet(folder)
    shards = max(1, -(-written.count() // shard_pieces))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = written.repartition(shards, order).sortWithinPartitions(F.desc("length"), order)  # long pieces come first, short ones fill
    return dealt.mapInArrow(_pack(sequence, open_bins), _PLACED)
