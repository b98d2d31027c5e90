"""Token counts from a compiled finite-state transducer.

The vocabulary is a sentencepiece BPE model with byte fallback. Its merges never cross a blank that follows a non-blank
(no piece holds one; checked when the model is read), nor a character outside the vocabulary, which becomes its bytes. In
between, the last token of every prefix is the only piece that ends there and is compatible with the last token before
it (the two, encoded together, stay two), so the encoding of all prefixes follows from left to right. What future
characters can ask for is bounded by the longest piece: the suffix that may still grow into a piece, with the last
tokens and relative counts at its positions. These are the states of a deterministic transducer over characters; a
transition is annotated with the change in the number of tokens of the text so far.

States are compiled when texts first reach them and kept for the worker's life in tables of bounded size; when a table is
full it starts again from the states in use. Texts run as one stream cut into equal chunks, one lane each. The state map
of a chunk is constant from its first reset (blank after non-blank, unknown character, end of a text) on; maps of chunks
compose by a prefix scan that gives every chunk its entry state; then the heads before the first resets run. Chunks
without any reset wait for the exit of their predecessor. Texts are never cut short; a long one spans many chunks.

Defined results: null text is empty and has no tokens. Extra columns pass through. Ids are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tideline.llm.columns import kept

LANES = 2048
CHUNK = 512
TABLE_CELLS = 1 << 25
SEARCHED = 24
BLANK = "▁"
# Classes below FIRST are resets: the state after them doesn't depend on the state before.
END, WORD, FIRST = 0, 5, 6  # 1 to 4: a character outside the vocabulary, of so many bytes
UNKNOWN = 0  # the state of a lane before its first reset
START = 1  # nothing of a word read yet: at the start of a text, or after an unknown character


class Vocabulary:
    """Pieces, prefixes of pieces, and which two tokens can follow each other."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank after a non-blank: words don't part there")
        self.score = {p: self.library.get_score(self.library.piece_to_id(p)) for p in pieces}
        self.characters = {c for p in pieces for c in p}
        if not self.characters <= set(pieces):
            raise ValueError("a character of a piece is no piece")
        self.grows: dict[str, list[str]] = {}
        for p in pieces:
            for k in range(1, len(p)):
                self.grows.setdefault(p[:k], []).append(p)
        self._opens: dict[tuple[str, str], bool] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """The pieces of a short text, merged in the order of their scores, leftmost first among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can be the token after ``before`` (empty: the first of its run)."""
        found = self._fits.get((before, piece))
        if found is None:
            if len(self._fits) > 1 << 20:
                self._fits.clear()
            found = self._fits[before, piece] = self.encode(before + piece) == ([before, piece] if before else [piece])
        return found

    def opens(self, before: str, start: str) -> str | frozenset | None:
        """What ``before`` means to pieces that go on from ``start``: those that can follow it, None where none can.

        Where many pieces go on from ``start`` the token itself stands for the answer."""
        longer = self.grows[start]
        if len(longer) > SEARCHED:
            return before
        found = self._opens.get((before, start), 0)
        if found == 0:
            if len(self._opens) > 1 << 20:
                self._opens.clear()
            found = self._opens[before, start] = frozenset(p for p in longer if self.fits(before, p)) or None
        return found


def _cell(state: int, change: int) -> int:
    """A table cell: the next state and the change of the count (a piece of n characters changes it by 2 - n at least)."""
    return state << 6 | change + 32


class Transducer:
    """Lazily compiled states. A state is (suffix, last tokens at its positions, counts there relative to now)."""

    def __init__(self, vocabulary: Vocabulary, cells: int = TABLE_CELLS):
        self.vocabulary, self.cells = vocabulary, cells
        self.class_of = np.zeros(0x110000, np.int16)
        self.character: list[str] = [""] * FIRST
        points = np.arange(0x110000)
        self.class_of[:] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        self.known = np.array(sorted(ord(c) for c in vocabulary.characters))
        self.class_of[self.known] = -1
        self.clear(64)

    def clear(self, width: int) -> None:
        self.width = width
        self.keys: list[tuple | None] = [None]
        self.number: dict[tuple, int] = {}
        self.table = np.full((1024, width), -1, np.int32)
        self.table[UNKNOWN] = _cell(UNKNOWN, 0)
        self.number[("", ("",), (0,))] = START
        self.keys.append(("", ("",), (0,)))
        self.word = self._state((BLANK, ("", BLANK), (-1, 0)))
        self._resets(UNKNOWN)
        self._resets(START)
        self._resets(self.word)

    def _resets(self, state: int) -> None:
        self.table[state, :FIRST] = [_cell(START, n) for n in range(WORD)] + [_cell(self.word, 1)]

    def _state(self, key: tuple) -> int:
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.width), -1, np.int32)])
            if found > 2:
                self._resets(found)
        return found

    def classes(self, text: str) -> np.ndarray:
        """Classes of the characters; blanks after non-blanks become WORD later, in the stream."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found = self.class_of[points]
        if len(found) and found.min() < 0:
            for c in np.unique(points[found < 0]):
                self.class_of[c] = len(self.character)
                self.character.append(chr(c))
            if len(self.character) > self.width:
                wider = max(2 * self.width, len(self.character)) - self.width
                self.table = np.pad(self.table, ((0, 0), (0, wider)), constant_values=-1)
                self.table[UNKNOWN, self.width :] = _cell(UNKNOWN, 0)
                self.width += wider
            found = self.class_of[points]
        return found

    @property
    def full(self) -> bool:
        return len(self.keys) * self.width > self.cells

    def compile(self, state: int, kind: int) -> None:
        """Fills one cell of the table."""
        suffix, tokens, counts = self.keys[state]
        grown, letter = suffix + self.character[kind], self.vocabulary
        for k in range(len(suffix), -1, -1):  # the piece grown[-(k + 1):] starts k positions before the new character
            piece, before = grown[len(grown) - 1 - k :], tokens[len(tokens) - 1 - k]
            if before is None or piece not in letter.score:
                continue
            if piece in before if isinstance(before, frozenset) else letter.fits(before, piece):
                count = counts[len(counts) - 1 - k] + 1
                break
        else:
            raise RuntimeError(f"no token ends after {grown!r}")
        # Positions where no future piece can begin are forgotten, so that prefixes with the same future share a state.
        n, means = len(grown), [None] * len(grown)
        for i, token in enumerate(tokens):
            start = grown[i:]
            if start in letter.grows:
                means[i] = frozenset(p for p in token if p.startswith(start)) or None if isinstance(token, frozenset) else letter.opens(token, start) if token is not None else None
        first = next((i for i in range(n) if means[i] is not None), n)
        target = self._state((
            grown[first:], (*means[first:], piece), (*(c - count if m is not None else 0 for c, m in zip(counts[first:], means[first:], strict=True)), 0),
        ))
        self.table[state, kind] = _cell(target, count)

    def run(self, states: np.ndarray, symbols: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """Lanes in step: ``symbols`` and ``changes`` are (steps, lanes). The states after the last step."""
        for t in range(len(symbols)):
            row = symbols[t]
            cells = states * np.int64(self.width) + row
            after = self.table.ravel().take(cells)
            if len(after) and after.min() < 0:
                for cell in np.unique(cells[after < 0]).tolist():
                    self.compile(cell // self.width, cell % self.width)
                after = self.table.ravel().take(cells)
            changes[t] = (after & 63) - 32
            states = after >> 6
        return states

    def restart(self, states: np.ndarray) -> np.ndarray:
        """Empties a full table; the given states get new numbers."""
        keys = [self.keys[s] for s in states]
        self.clear(self.width)
        return np.array([UNKNOWN if k is None else self._state(k) for k in keys], np.int64)

    def chunk_changes(self, symbols: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Changes of the count at every symbol of (chunks, length), and the state after the last chunk."""
        chunks, length = symbols.shape
        steps = np.ascontiguousarray(symbols.T)
        changes = np.zeros((length, chunks), np.int8)
        # State maps: constant from the first reset on. Lanes start unknown, which costs and changes nothing.
        exits = self.run(np.full(chunks, UNKNOWN, np.int64), steps, changes)
        head = np.where((symbols < FIRST).any(1), (symbols < FIRST).argmax(1), length)
        entries = np.full(chunks, -1, np.int64)
        entries[0] = entry
        waits = np.ones(chunks, bool)
        while waits.any():
            # Prefix scan over composed maps: a constant map absorbs what comes before it.
            entries[1:] = np.where(exits[:-1] != UNKNOWN, exits[:-1], -1)
            ready = np.flatnonzero(waits & (entries >= 0))
            waits[ready] = False
            states, lanes, t = entries[ready], ready, 0
            while len(lanes):
                going = head[lanes] > t
                done = lanes[~going]
                if len(done):
                    whole = head[done] == length
                    exits[done[whole]] = states[~going][whole]
                    lanes, states = lanes[going], states[going]
                if len(lanes):
                    out = np.zeros((1, len(lanes)), np.int8)
                    states = self.run(states, steps[t : t + 1, lanes], out)
                    changes[t, lanes] = out[0]
                t += 1
        return np.ascontiguousarray(changes.T), int(exits[-1])

    def counts(self, texts: Iterable[str]) -> np.ndarray:
        """The number of tokens of each text."""
        waiting: list[np.ndarray] = []
        held, entry, open_, before_blank = 0, START, 0, False
        size = LANES * CHUNK
        results: list[int] = []

        def flush() -> None:
            nonlocal waiting, held, entry, open_, before_blank
            stream = np.concatenate(waiting).astype(np.int64)
            waiting, held = [], 0
            kind = self.class_of[ord(BLANK)]
            blanks = stream == kind
            parts = blanks.copy()
            parts[1:] &= ~blanks[:-1] & (stream[:-1] != END)
            parts[0] &= not before_blank
            stream[parts] = WORD
            before_blank = bool(blanks[-1]) or stream[-1] == END
            changes = np.zeros(len(stream), np.int64)
            whole = (len(stream) // CHUNK) * CHUNK
            if whole:
                got, entry = self.chunk_changes(stream[:whole].reshape(-1, CHUNK), entry)
                changes[:whole] = got.ravel()
            if whole < len(stream):
                got, entry = self.chunk_changes(stream[whole:][None], entry)
                changes[whole:] = got.ravel()
            ends = np.flatnonzero(stream == END)
            edges = np.concatenate([[0], ends + 1])
            sums = np.add.reduceat(np.concatenate([changes, [0]]), edges)
            sums[0] += open_
            results.extend(sums[:-1].tolist())
            open_ = int(sums[-1]) if edges[-1] < len(stream) else 0
            if self.full:
                entry = int(self.restart(np.array([entry]))[0])

        for text in texts:
            if text:
                for at in range(-1, len(text), size):
                    piece = text[max(at, 0) : at + size].replace(" ", BLANK)
                    waiting.append(self.classes(BLANK + piece if at < 0 else piece))
                    held += len(waiting[-1])
                    if held >= size:
                        flush()
            waiting.append(np.array([END], np.int16))
            held += 1
        if waiting:
            flush()
        return np.array(results, np.int64)


def transducer(path: str) -> Transducer:
    """The worker's transducer for a vocabulary file: what tasks before have compiled is used again."""
    return kept(("transducer", path), lambda: Transducer(Vocabulary(path)))


def with_counts(docs: DataFrame, path: str, limit: int, text: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to the columns ``passing`` (all by default).

    ``path`` is the vocabulary file's place on every machine."""
    own = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in (passing if passing is not None else docs.columns) if c not in own]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in batches:
            yield pd.Series(machine.counts(batch), dtype="int64")

    found = docs.select(*keep, F.octet_length(whole).cast("bigint").alias("n_bytes"), count(whole).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
