"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

Texts are cut where the vocabulary's own pre-tokenizer surely cuts, on the bytes of a
chunk at once; each distinct piece is encoded once per worker and its ids are reused.
The ids equal those of encoding the whole text with ``add_special_tokens=False``;
strings of special tokens within a text are ordinary text.

Cuts, with letters, digits, marks and white space of ASCII only:

* before white space that follows a character which surely is none;
* after a single line break or tab between two such characters;
* between letter and digit, letter or digit and mark, and mark and letter or digit,
  unless the mark is an apostrophe, which may start an ending.

Pieces are told apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os
import re
import sys
import types
from itertools import chain

import numpy as np
import pandas as pd

from eavista.llm.shared import mixed, random_words, slices

CHUNK = 1 << 20
# Distinct pieces that a worker remembers, some 40 bytes each; beyond, it forgets all and starts anew.
REMEMBERED = 500_000

# Pieces encoded in one call, and what keeps a piece out of such a call: white space after
# its first character, or what the separating pieces are made of.
TOGETHER = 256
UNSAFE = re.compile(r"(?s).\s|[\n\x01]")

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
TABLE = random_words(20, 256)

OTHER, SPACE, BREAK, LETTER, DIGIT, MARK, APOSTROPHE = range(7)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for code in range(128):
        char = chr(code)
        if char == " ":
            kinds[code] = SPACE
        elif char in "\t\n\v\f\r":
            kinds[code] = BREAK
        elif char.isalpha():
            kinds[code] = LETTER
        elif char.isdigit():
            kinds[code] = DIGIT
        elif char == "'":
            kinds[code] = APOSTROPHE
        elif 32 < code < 127:
            kinds[code] = MARK
    return kinds


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums that give a hash of any stretch of bytes, see ``stretch_hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(MULTIPLIER, len(data)), out=sums[1:])
    return sums


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers, from rows of their own product: a running product is slow."""
    side = 1 << 10
    low = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(side - 1, base)]))
    step = low[-1:] * base
    high = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.repeat(step, n // side)]))
    return (high[:, None] * low).ravel()[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(INVERSE, n + 1)


def stretch_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]``, alike wherever the stretch stands."""
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a piece starts; row starts are among them."""
    n = len(data)
    kinds = np.concatenate([[OTHER] * 3, CLASSES[data]]).astype(np.uint8)
    here, one, two = kinds[3:], kinds[2:-1], kinds[1:-2]
    ascii_solid = np.isin(np.arange(7), [LETTER, DIGIT, MARK, APOSTROPHE])
    # A byte beyond ASCII before white space: solid unless it may end a wide blank.
    wide = np.concatenate([np.zeros(3, np.uint8), data])
    b1, b2, b3 = wide[2:-1], wide[1:-2], wide[:-3]
    blank = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3))
    solid = ascii_solid[one] | ((b1 >= 0x80) & ~blank)
    white = (here == SPACE) | (here == BREAK)
    before_white = white & solid
    after_break = np.zeros(n, bool)
    after_break[1:] = (one[1:] == BREAK) & before_white[:-1] & ascii_solid[here[1:]]
    word, mark = (here == LETTER) | (here == DIGIT), (here == MARK) | (here == APOSTROPHE)
    was_word = (one == LETTER) | (one == DIGIT)
    inside = (was_word & mark) | (word & (one == MARK)) | (was_word & word & (here != one))
    start = before_white | after_break | inside
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes chunks of texts; ``words`` for a vocabulary that drops white space and case."""

    def __init__(self, path: str, words: bool, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words, self.end = words, end
        # Pieces are encoded many at a time, with a piece between them that is one id of its own.
        self.between = " \x01 " if words else "\n"
        (self.mark,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.inverse = inverse_powers(CHUNK)
        self.forget()

    def forget(self) -> None:
        self.known, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.counts, self.ids, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has."""
        encode, between = self.tokenizer.encode_batch_fast, self.between
        alone = np.array([UNSAFE.search(piece) is not None for piece in pieces])
        safe = [piece for piece, is_alone in zip(pieces, alone) if not is_alone]
        groups = [between.join(safe[i : i + TOGETHER]) + between for i in range(0, len(safe), TOGETHER)]
        joined = encode(groups, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(x.ids for x in joined)), np.uint32)
        marks = ids == self.mark
        counts = np.zeros(len(pieces), np.int64)
        counts[~alone] = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        ids = ids[~marks]
        if alone.any():
            rest = [piece for piece, is_alone in zip(pieces, alone) if is_alone]
            apart = [x.ids for x in encode(rest, add_special_tokens=False)]
            at, sizes = (np.cumsum(counts) - counts)[alone], [len(x) for x in apart]
            ids = np.insert(ids, np.repeat(at, sizes), list(chain.from_iterable(apart)))
            counts[alone] = sizes
        return ids, counts

    def learn(self, values: np.ndarray, pieces: list[str]) -> None:
        """The ids of further pieces, kept end to end."""
        found, counts = self.ids_of(pieces)
        while self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(found)] = found
        self.used += len(found)
        known = np.concatenate([self.known, values])
        places = np.concatenate([self.places, len(self.counts) + np.arange(len(values))])
        order = np.argsort(known, kind="stable")
        self.known, self.places = known[order], places[order]
        self.counts = np.concatenate([self.counts, counts])

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where the pieces with these hashes are kept; -1 for pieces not seen."""
        if not len(self.known):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        return np.where(self.known[at] == values, self.places[at], -1)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            data = LOWER[data]
        if len(self.known) > REMEMBERED:
            self.forget()
        if len(data) > len(self.inverse) - 1:
            self.inverse = inverse_powers(len(data))
        starts = cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        sums = prefix_hashes(data)
        codes, values = pd.factorize(stretch_hashes(sums, self.inverse, starts, ends))
        place = self.find(values)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = len(self.counts) + np.arange(len(fresh))
            first = np.empty(len(values), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw, at = data.tobytes(), first[fresh]
            self.learn(values[fresh], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at], ends[at])])
        place = place[codes]
        counts = self.counts[place]
        begin = (np.cumsum(self.counts) - self.counts)[place]
        # Ids of the pieces, and the end id after each row.
        pieces_of = np.searchsorted(starts, offsets)
        before = np.concatenate([[0], np.cumsum(counts)])
        rows = len(offsets) - 1
        at = before[pieces_of] + np.arange(rows + 1)
        out = np.full(at[-1], self.end, np.uint32)
        body = np.ones(len(out), bool)
        body[at[1:] - 1] = False
        total = int(counts.sum())
        out[body] = self.ids[np.repeat(begin - before[:-1], counts) + np.arange(total)]
        return out, at

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """``(first row, last row, ids, their offsets)`` for runs of the rows, in order."""
        for i, j in slices(offsets, CHUNK):
            at = offsets[i : j + 1]
            yield i, j, *self.chunk(data[at[0] : at[-1]], at - at[0])


def worker_encoder(path: str, words: bool, end: int) -> Encoder:
    """This worker process's encoder: a later task in the same process finds the pieces of an earlier one."""
    kept = sys.modules.setdefault("_pieces_of_this_worker", types.ModuleType("_pieces_of_this_worker"))
    if getattr(kept, "of", None) != (path, words, end):
        kept.of, kept.encoder = (path, words, end), Encoder(path, words, end)
    return kept.encoder
