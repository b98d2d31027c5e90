"""Aligns the tokens of two tokenizers (A: a byte-level vocabulary, B: pieces with byte fallback) by the bytes they cover.

Each vocabulary is a matrix of tokens by bytes of the text (one row per token occurrence, a one for each byte it covers), held in compressed sparse rows made here. The
row product A * transpose(B), row by row after Gustavson, gives every pair of tokens that share bytes: overlap links. Where a token of A and one of B
end together a group ends; the products of the group incidences (ids by group, with how often the group holds the id) give the id pairs linked by a group, with
their occurrences. No group's pairs are written out one by one: ids that a group repeats come as counts.

Neither vocabulary joins across a single blank between two visible characters, nor across a small letter and the ASCII punctuation after it (B is looked through for pieces that
would), so a text falls into units that are encoded and aligned once per distinct unit (a table of at most about ``KEPT_BYTES``). Both tokenizers end there, so groups never pass a unit's end.

Counts over the corpus: documents are dealt into blocks of about ``BLOCK_LINKS`` distinct (document, pair); a block has a dictionary of its pairs with the number of its
documents that hold them. Dictionaries are added up by pair, the highest count of each A id is found, and the answer goes back to the blocks, joined by pair and
grouped by block. A pair has at most one row a block, so no common pair makes a hot key, and a block's size is bounded.

Defined results: null and empty texts, and texts whose tokens of A or B don't add up to a blank and the text, have no tokens: zeros, empty groups_sha256. Rows that repeat an
id are documents of their own. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.columns import kept, release
from tideline.session import scratch_folder

KEPT_BYTES = 96 << 20
PART = 1 << 20
BLOCK_LINKS = 3_000_000
JOINED = 1 << 15
_VISIBLE = r"!-~¡-¬®-˿Α-ϿЀ-ҁ"
_SMALL = r"a-zß-öø-ÿ"
_PUNCTUATION = r"!-/:-@\[-`{-~"
_BLANK_CUT = re.compile(rf"(?<=[{_VISIBLE}])(?= [{_VISIBLE}])")
_CUT = re.compile(rf"(?<=[{_VISIBLE}])(?= [{_VISIBLE}])|(?<=[{_SMALL}])(?=[{_PUNCTUATION}])")
_MIXED = re.compile(rf"[{_SMALL}][{_PUNCTUATION}]")
_CLEAN = re.compile(rf"(?: [{_VISIBLE}]|[{_PUNCTUATION}])(?:.*[{_VISIBLE}])?", re.DOTALL)
_PLAIN = re.compile(rf"[{_VISIBLE} ]*")
# Fixed value: how byte-level vocabularies of this family part a text before merging.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = " The Quick, brown's fox don't 12 345 a-b (x) é ñandú ß naïve; \"q\" %%% ... Ωμέγα привет http://a.b/c?d=1&e=2"
_FILLER = " a"  # stands before a unit that starts with punctuation; its tokens are left out
_WRITTEN = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, at binary, times binary, place int, pair bigint, docs bigint"
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, n_best bigint, count_sum bigint"
B_BITS = 24


class Rows:
    """A sparse matrix in compressed rows: row r holds columns[starts[r]:starts[r + 1]] with those values."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int, n_columns: int):
        order = np.lexsort((column, row))
        self.columns, self.values, self.n_columns = column[order], value[order], n_columns
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Rows:
        return Rows(self.columns, self.rows, self.values, self.n_columns, len(self.starts) - 1)

    def times(self, other: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the product. Each entry of a row brings the other's row of its column, scaled; equal places are added up."""
        lengths = np.diff(other.starts)[self.columns]
        row = np.repeat(self.rows, lengths)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(other.starts[self.columns], lengths) + inside
        place, back = np.unique(row * np.int64(max(1, other.n_columns)) + other.columns[at], return_inverse=True)
        total = np.bincount(back, np.repeat(self.values, lengths) * other.values[at], len(place)).astype(np.int64)
        return place // max(1, other.n_columns), place % max(1, other.n_columns), total


def _ones(owner: np.ndarray, column: np.ndarray, n_rows: int, n_columns: int) -> Rows:
    return Rows(owner, column, np.ones(len(owner), np.int64), n_rows, n_columns)


def _grouped(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times)."""
    place, times = np.unique(group * np.int64(1 << B_BITS) + ids, return_counts=True)
    return place >> B_BITS, place & ((1 << B_BITS) - 1), times


def _letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: visible Latin-1 letters stand for themselves, the rest from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both libraries, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocabulary = _letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = []
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        for i, piece in enumerate(pieces):
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.cut = _BLANK_CUT if any(_MIXED.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i)) else _CUT
        self.lengths = [np.array([len(t) for t in known], np.int64) for known in (self.a_bytes, self.b_bytes)]
        most = max(map(len, self.lengths))
        self.digits = np.zeros((most, 9), np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(most)], np.int64)
        for i in range(most):
            self.digits[i, : self.n_digits[i]] = np.frombuffer(str(i).encode(), np.uint8)
        self.quick = self._quick(vocabulary)

    def _quick(self, vocabulary: dict[str, int]):
        """A second library for plain texts, a few times faster, with the same vocabulary and parting; None where a probe differs."""
        import tiktoken

        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if token not in special}
        if len(ranks) != len(vocabulary) - len(special & vocabulary.keys()):
            return None
        made = tiktoken.Encoding("plain", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        return made if made.encode_ordinary(_PROBE) == self.a.encode(_PROBE, add_special_tokens=False).ids else None

    def units(self, text: str) -> list[str]:
        return self.cut.split(" " + text)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of texts that start with a blank."""
        plain = [self.quick is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(self.a.encode_batch_fast([t for t, quick in zip(texts, plain, strict=True) if not quick], add_special_tokens=False))
        a = [np.array(self.quick.encode_ordinary(t) if quick else next(others).ids, np.int64) for t, quick in zip(texts, plain, strict=True)]
        return a, [np.array(ids, np.int64) for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def adds_up(self, ids: tuple[np.ndarray, np.ndarray], raw: bytes) -> bool:
        return all(b"".join(map(known.__getitem__, own.tolist())) == raw for own, known in zip(ids, (self.a_bytes, self.b_bytes), strict=True))

    def tokens(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """([ids of A, ids of B], [the unit of each], which units add up). Clean units are encoded joined."""
        size = list(map(len, map(str.encode, units)))
        clean = [_CLEAN.fullmatch(u) is not None for u in units]
        # Plain ones come first, then those that start with punctuation, then the rest.
        plain = [c and u[0] == " " and _PLAIN.fullmatch(u) is not None for u, c in zip(units, clean, strict=True)]
        kinds = ([i for i, p in enumerate(plain) if p], [i for i, p in enumerate(plain) if clean[i] and not p])
        texts: list[tuple[str, list[int]]] = []
        for some in kinds:
            at = 0
            while at < len(some):
                members, total = [], 0
                while at < len(some) and total < JOINED:
                    members.append(some[at])
                    total += size[some[at]]
                    at += 1
                texts.append(("".join([units[i] if units[i][0] == " " else _FILLER + units[i] for i in members]), members))
        texts += [(units[i] if units[i][0] == " " else _FILLER + units[i], [i]) for i, c in enumerate(clean) if not c]
        good = np.zeros(len(units), bool)
        ids: tuple[list, list] = ([], [])
        owner: tuple[list, list] = ([], [])

        def take(some: list[tuple[str, list[int]]]) -> list[int]:
            """Encodes texts; gives the units of those that don't add up."""
            failed: list[int] = []
            for (text, inside), a, b in zip(some, *self.encode([t for t, _ in some]), strict=True):
                if not self.adds_up((a, b), text.encode()):
                    failed += inside
                    continue
                parts = [part for i in inside for part in ((size[i],) if units[i][0] == " " else (len(_FILLER), size[i]))]
                names = [part for i in inside for part in ((i,) if units[i][0] == " " else (-1, i))]
                ends, names = np.cumsum(parts), np.array(names)
                for k, own in enumerate((a, b)):
                    reached = np.cumsum(self.lengths[k][own])
                    at = np.searchsorted(ends, reached)
                    if len(np.intersect1d(ends, reached, assume_unique=True)) != len(ends):
                        raise ValueError("a token passes the end of a unit")
                    kept_tokens = names[at] >= 0
                    ids[k].append(own[kept_tokens])
                    owner[k].append(names[at][kept_tokens])
                good[inside] = True
            return failed

        alone = take(texts)
        take([(units[i] if units[i][0] == " " else _FILLER + units[i], [i]) for i in alone])
        flat = [np.concatenate([np.zeros(0, np.int64), *some]) for some in ids]
        unit = [np.concatenate([np.zeros(0, np.int64), *some]) for some in owner]
        order = [np.argsort(u, kind="stable") for u in unit]
        return [f[o] for f, o in zip(flat, order, strict=True)], [u[o] for u, o in zip(unit, order, strict=True)], good


def align(n: int, ids: list[np.ndarray], unit: list[np.ndarray], lengths: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Alignment of ``n`` units whose tokens of A and B cover the same bytes: ids, unit and length in bytes of each token of both. ``group_a``, ``group_b``: each token's group;
    ``groups``, ``overlaps``: how many of each a unit has; ``pair_unit``, ``pair``, ``times``: id pairs linked in a unit, with their occurrences."""
    end_a, end_b = (np.cumsum(x) for x in lengths)
    size = int(end_a[-1]) if len(end_a) else 0
    ends = np.zeros(size + 1, np.int64)
    ends[end_a] += 1
    ends[end_b] += 1
    common = ends == 2
    before = np.cumsum(common) - common  # groups that ended earlier
    group_a, group_b, n_groups = before[end_a], before[end_b], int(common.sum())
    a, b = (_ones(np.repeat(np.arange(len(x)), x), np.arange(size), len(x), size) for x in lengths)
    overlap, _, _ = a.times(b.transposed())
    ga, ia, ta = _grouped(group_a, ids[0])
    gb, ib, tb = _grouped(group_b, ids[1])
    # The group incidences of each unit's ids of A, times those of B, which are held by group: transposed.
    unit_of_group = np.zeros(n_groups, np.int64)
    unit_of_group[group_a] = unit[0]
    owners, owner = np.unique(unit_of_group[ga] * np.int64(1 << B_BITS) + ia, return_inverse=True)
    left = Rows(owner, ga, ta, len(owners), n_groups)
    row, id_b, times = left.times(Rows(gb, ib, tb, n_groups, 1 << B_BITS))
    return {
        "group_a": group_a, "group_b": group_b, "groups": np.bincount(unit_of_group, minlength=n), "overlaps": np.bincount(unit[0][overlap], minlength=n),
        "pair_unit": owners[row] >> B_BITS, "pair": ((owners[row] & ((1 << B_BITS) - 1)) << B_BITS) | id_b, "times": times,
    }


def _shown(n: int, ids: list[np.ndarray], unit: list[np.ndarray], groups: list[np.ndarray], encoders: Encoders) -> list[bytes]:
    """The groups of each unit as text: of every group A's ids, then B's. All units are written into one line, a mark after each id."""
    key = np.concatenate([2 * groups[0], 2 * groups[1] + 1])
    order = np.argsort(key, kind="stable")
    key, owner, told = key[order], np.concatenate(unit)[order], np.concatenate(ids)[order]
    last = np.concatenate([key[1:] != key[:-1], [True]]) if len(key) else np.zeros(0, bool)
    marks = np.where(last, np.where(key & 1, ord(";"), ord("|")), ord(",")).astype(np.uint8)
    length = encoders.n_digits[told]
    ends = np.cumsum(length + 1)
    line = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - length - 1
    for k in range(int(length.max()) if len(length) else 0):
        long = length > k
        line[starts[long] + k] = encoders.digits[told[long], k]
    line[ends - 1] = marks
    raw, cuts = line.tobytes(), np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(n + 1))].tolist()
    return [raw[s : max(s, e - 1)] for s, e in zip(cuts, cuts[1:], strict=False)]


class Units:
    """What is known of each unit: its place in the arrays. ``numbers``: n_a (-1 where the tokens don't add up), n_b, n_groups, n_links, n_overlaps; ``pairs`` and
    ``times`` from starts[place] to starts[place + 1]; ``shown``: its groups as text."""

    def __init__(self, a_path: str, b_path: str, most_bytes: int = KEPT_BYTES):
        self.encoders, self.most_bytes = Encoders(a_path, b_path), most_bytes
        self.place: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.numbers, self.starts = np.zeros((0, 5), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in pairs and times, how many of them each place has)."""
        lengths = self.starts[places + 1] - self.starts[places]
        return np.repeat(self.starts[places] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum())), lengths

    def learn(self, units: set[str]) -> None:
        if self.bytes > self.most_bytes:  # what the present texts don't need goes
            names = list(units & self.place.keys())
            places = np.array([self.place[u] for u in names], np.int64)
            at, lengths = self._gathered(places)
            self.pairs, self.times, self.numbers = self.pairs[at], self.times[at], self.numbers[places]
            self.starts = np.concatenate([[0], np.cumsum(lengths)])
            self.shown = [self.shown[i] for i in places.tolist()]
            self.place = dict(zip(names, range(len(names)), strict=True))
            self.bytes = self._cost(names, self.shown, len(self.pairs))
        new = list(units.difference(self.place))
        at = 0
        added = []
        while at < len(new):
            some, size = [], 0
            while at < len(new) and (not some or size + len(new[at]) <= PART):
                some.append(new[at])
                size += len(new[at])
                at += 1
            added.append(self._align(some))
        if new:
            shown, numbers, lengths, pairs, times = zip(*added, strict=True)
            self.place.update(zip(new, range(len(self.shown), len(self.shown) + len(new)), strict=True))
            self.shown += itertools.chain.from_iterable(shown)
            self.numbers = np.concatenate([self.numbers, *numbers])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])
            self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
            self.bytes += self._cost(new, self.shown[-len(new) :], sum(map(len, pairs)))

    @staticmethod
    def _cost(names: list[str], shown: list[bytes], pairs: int) -> int:
        return 300 * len(names) + sum(map(len, names)) + sum(map(len, shown)) + 16 * pairs

    def _align(self, units: list[str]) -> tuple:
        n = len(units)
        ids, unit, good = self.encoders.tokens(units)
        lengths = [known[own] for known, own in zip(self.encoders.lengths, ids, strict=True)]
        found = align(n, ids, unit, lengths)
        cuts = np.searchsorted(found["pair_unit"], np.arange(n + 1))
        links = np.diff(np.concatenate([[0], np.cumsum(found["times"])])[cuts])
        n_a, n_b = (np.bincount(u, minlength=n) for u in unit)
        numbers = np.stack([np.where(good, n_a, -1), n_b, found["groups"], links, found["overlaps"]], 1)
        shown = _shown(n, ids, unit, [found["group_a"], found["group_b"]], self.encoders)
        return shown, numbers, np.diff(cuts), found["pair"], found["times"]

    def document(self, units: list[str], digest) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(the five numbers, pairs, times) of a text of known units, whose groups go into ``digest``; None where a unit doesn't add up."""
        places = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        numbers = self.numbers[places]
        if numbers[:, 0].min() < 0:
            return None
        digest.update(b";".join(map(self.shown.__getitem__, places.tolist())))
        once, often = np.unique(places, return_counts=True)
        at, lengths = self._gathered(once)
        return numbers.sum(0), *_added(self.pairs[at], self.times[at] * np.repeat(often, lengths))


def _added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, back = np.unique(pairs, return_inverse=True)
    return known, np.bincount(back, times, len(known)).astype(np.int64)


class Block:
    """Documents of a block: their rows, and the (document, pair) entries with how often each is linked."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc: int | None, row: tuple, pairs: np.ndarray, times: np.ndarray) -> None:
        self.docs.append((doc, *row))
        self.pairs.append(pairs)
        self.times.append(times)
        self.size += len(pairs) + 20

    def told(self) -> Iterator[pa.RecordBatch]:
        known, place, docs = np.unique(np.concatenate([np.zeros(0, np.int64), *self.pairs]), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *map(len, self.pairs)]).tolist()
        place = place.astype(np.int32)
        at = [place[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)]
        times = [t.astype(np.int32).tobytes() for t in self.times]
        columns = [pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(zip(*self.docs, strict=True))]
        n = len(self.docs)
        yield _batch([np.full(n, self.number), *columns, pa.array(at, pa.binary()), pa.array(times, pa.binary()), None, None, None], n)
        n = len(known)
        yield _batch([np.full(n, self.number), *[None] * 9, np.arange(n, dtype=np.int32), known, docs], n)


_TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in _WRITTEN.split(", ")]


def _batch(columns: list, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_NOTHING = (0, 0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _document(table: Units, units: list[str] | None, learnt: bool) -> tuple[tuple, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256), pairs and times of one text. Units that aren't learnt yet are, part by part."""
    if units is None:
        return _NOTHING
    totals, digest, found = np.zeros(5, np.int64), hashlib.sha256(), []
    step = len(units) if learnt else 100_000
    for at in range(0, len(units), step):
        some = units[at : at + step]
        if not learnt:
            table.learn(set(some))
        if at:
            digest.update(b";")
        told = table.document(some, digest)
        if told is None:
            return _NOTHING
        totals += told[0]
        found.append(told[1:])
    pairs, times = found[0] if len(found) == 1 else _added(*map(np.concatenate, zip(*found, strict=True)))
    return (*totals.tolist(), digest.hexdigest()), pairs, times


def _write(a_path: str, b_path: str, block_links: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table: Units = kept(("aligned units", a_path, b_path), lambda: Units(a_path, b_path))
        first, made = TaskContext.get().partitionId() << 32, 0
        block = Block(first)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at < batch.num_rows and (not some or size + len(texts[at].as_buffer()) <= PART):
                    some.append((ids[at].as_py(), texts[at].as_py()))
                    size += len(texts[at].as_buffer())
                    at += 1
                split = [table.encoders.units(text) if text else None for _, text in some]
                learnt = size <= PART
                if learnt:
                    table.learn(set().union(*filter(None, split)))
                for (doc, _), units in zip(some, split, strict=True):
                    block.add(doc, *_document(table, units, learnt))
                    if block.size > block_links:
                        yield from block.told()
                        made += 1
                        block = Block(first + made)
        if block.docs:
            yield from block.told()
        release()

    return write


def _answer(_key: tuple, docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    order = np.argsort(dictionary.column("place").to_numpy())
    count = dictionary.column("count").to_numpy()[order]
    best = dictionary.column("best").to_numpy()[order]
    at = [np.frombuffer(raw, np.int32) for raw in docs.column("at").to_pylist()]
    times = np.frombuffer(b"".join(docs.column("times").to_pylist()), np.int32).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *at])
    ends = np.cumsum([0, *map(len, at)])
    weighted = np.concatenate([[0], np.cumsum(times * count[flat])])
    leading = np.concatenate([[0], np.cumsum(times * (count[flat] == best[flat]))])
    own = docs.select([c.split()[0] for c in _RESULT.split(", ")[:7]])
    return own.append_column("n_best", pa.array(np.diff(leading[ends]), pa.int64())).append_column("count_sum", pa.array(np.diff(weighted[ends]), pa.int64()))


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum. The paths are the vocabularies' places on every machine."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "alignment")
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    slim.mapInArrow(_write(a_path, b_path, block_links), _WRITTEN).write.parquet(f"{folder}/blocks")
    dictionary = spark.read.schema(_WRITTEN).parquet(f"{folder}/blocks").filter("pair IS NOT NULL").select("block", "place", "pair", "docs")
    counts = dictionary.groupBy("pair").agg(F.sum("docs").alias("count"))
    counts.withColumn("a", F.shiftright("pair", B_BITS)).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("pair bigint, count bigint, a bigint").parquet(f"{folder}/counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    told = dictionary.select("block", "place", "pair").join(counts.join(best, "a").select("pair", "count", "best"), "pair").select("block", "place", "count", "best")
    rows = spark.read.schema(_WRITTEN).parquet(f"{folder}/blocks").filter("pair IS NULL").select("block", *[c.split()[0] for c in _RESULT.split(", ")[:7]], "at", "times")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_answer, _RESULT)
