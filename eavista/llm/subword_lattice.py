"""Likelihood of texts over all ways to cut them into subword pieces.

Pieces are those of an existing vocabulary file. A word, with the mark of a word's start
before it, is a lattice: an arc for every piece that stands at a place. The word's
probability is the sum over all paths of the product of the pieces' probabilities, got by a
forward recursion in logarithms, place by place for many words at once. As no piece of
a word reaches into another, a text's log probability is the sum over its words, plus that of
the piece that ends a text. A character that no piece covers is an arc of its byte pieces.

The file's scores are the prior of the pieces: logarithms, or, in a vocabulary of merges,
ranks, whose reciprocals then serve. Expectation-maximisation over the training words (each
distinct word once, with its count) turns them into probabilities: expected counts come from
the forward and a backward recursion, and the prior counts as ``PRIOR`` further pieces, so
that every piece keeps a probability above 0.

How the work is dealt:

1. Tasks cut texts into blocks of some ``BLOCK`` bytes. A block keeps its texts as codes of
   its distinct words; within a block words are told apart by 64-bit hashes.
2. Counts of distinct words are added up over blocks, and each distinct word is scored once.
   A word has one row per block, so the most frequent one has no more than any other.
3. Scores go back to the blocks, which add them up by document.

Null text counts as empty; a text without words has the end alone. A row without an id is
learnt from. Rows that repeat are rows each. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eavista.llm.shared import blobs, random_words, slices, stored, utf8
from eavista.llm.tokens import LOWER, inverse_powers, prefix_hashes, stretch_hashes

BLOCK = 16 << 20
# Bytes hashed at a time, and code points of words whose lattices are held at a time.
HASHED = 4 << 20
HELD = 1 << 17
# Rounds of expectation-maximisation, and the pieces that the prior counts for.
ROUNDS = 3
PRIOR = 10_000.0

START = 0x2581
# Stands for a START within a text, which is no start; beyond all code points.
FOREIGN = 0x110000
SMOOTH = 0.5
LN10 = float(np.log(10))

PACKED = "block long, ids binary, known binary, held binary, sizes binary, codes binary, words array<string>, taught array<long>, texts long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Pieces:
    """A trie of pieces, its edges in a hash table, and the prior of each piece.

    Pieces are numbered by the vocabulary; ``bytes_at`` has the number of each byte's piece
    and ``end`` that of a text's end.
    """

    keys: np.ndarray
    nodes: np.ndarray
    piece_of: np.ndarray
    prior: np.ndarray
    bytes_at: np.ndarray
    end: int


MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(2**64 - 1)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def read_pieces(path: str, ranks: bool = True) -> Pieces:
    """The pieces of a sentencepiece file; ``ranks`` where its scores are minus the ranks of merges."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(size)])
    bytes_at, words = np.zeros(256, np.int64), {}
    for i in range(size):
        if model.is_byte(i):
            bytes_at[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            words[model.id_to_piece(i)] = i
    prior = 1 / (1 - scores) if ranks else np.exp(scores)
    # Pieces without a score of their own, as bytes and the end, are as rare as the rarest.
    named = np.zeros(size, bool)
    named[list(words.values())] = True
    prior = np.where(named, prior, prior[named].min())
    unusable = [i for i in range(size) if not named[i] and i != model.eos_id() and not model.is_byte(i)]
    prior[unusable] = 0
    edges: dict[tuple[int, int], int] = {}
    piece_of = [-1]
    for word, i in words.items():
        node = 0
        for char in word:
            edge = (node, ord(char))
            if edge not in edges:
                edges[edge] = len(piece_of)
                piece_of.append(-1)
            node = edges[edge]
        piece_of[node] = i
    bits = int(len(edges) * 4).bit_length()
    keys, nodes = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int32)
    codes = np.array([(node << 21) | code for node, code in edges], np.uint64)
    for key, slot, node in zip(codes, _slots(codes, bits), edges.values()):
        while keys[slot] != EMPTY:
            slot = (slot + 1) % len(keys)
        keys[slot], nodes[slot] = key, node
    return Pieces(keys, nodes, np.array(piece_of, np.int32), prior / prior.sum(), bytes_at, model.eos_id())


def _step(pieces: Pieces, node: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The trie's nodes after one more character; 0 where there is none."""
    keys = (node.astype(np.uint64) << np.uint64(21)) | code.astype(np.uint64)
    slot = _slots(keys, len(pieces.keys).bit_length() - 1)
    there = pieces.keys[slot]
    out = np.where(there == keys, pieces.nodes[slot], 0)
    open_ = np.flatnonzero((there != keys) & (there != EMPTY))
    while len(open_):
        slot[open_] = (slot[open_] + 1) % len(pieces.keys)
        there = pieces.keys[slot[open_]]
        hit = there == keys[open_]
        out[open_[hit]] = pieces.nodes[slot[open_[hit]]]
        open_ = open_[~hit & (there != EMPTY)]
    return out


def arcs(pieces: Pieces, points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, piece)`` of every piece that stands in ``points``, and the code points without one.

    ``last`` is, for each place, the place at which its word ends. A code point that no piece
    covers has an arc whose number counts on from the vocabulary's.
    """
    size = len(pieces.prior)
    at, node, length = np.arange(len(points)), np.zeros(len(points), np.int32), 0
    found = []
    bare = np.ones(len(points), bool)
    while len(at):
        node = _step(pieces, node, points[at + length])
        length += 1
        on = np.flatnonzero(node)
        at, node = at[on], node[on]
        piece = pieces.piece_of[node]
        here = np.flatnonzero(piece >= 0)
        found.append((at[here], np.full(len(here), length, np.int32), piece[here]))
        if length == 1:
            bare[at[here]] = False
        on = np.flatnonzero(at + length < last[at])
        at, node = at[on], node[on]
    lone = np.flatnonzero(bare)
    codes, which = np.unique(points[lone], return_inverse=True)
    found.append((lone, np.ones(len(lone), np.int32), (size + which).astype(np.int32)))
    return *(np.concatenate(part) for part in zip(*found)), codes


def byte_pieces(pieces: Pieces, code: int) -> np.ndarray:
    char = chr(START if code == FOREIGN else code)
    return pieces.bytes_at[np.frombuffer(char.encode("utf-8", "replace"), np.uint8)]


def _sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups, which come in order, and the logarithms of the sums of exponentials over each."""
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    most = np.maximum.reduceat(values, first)
    spread = np.repeat(most, np.diff(np.append(first, len(values))))
    return groups[first], most + np.log(np.add.reduceat(np.exp(values - spread), first))


class Lattice:
    """The arcs of some words, end to end: word w has the places ``off[w]`` to ``off[w + 1]``, both its own."""

    def __init__(self, pieces: Pieces, logs: np.ndarray, points: np.ndarray, off: np.ndarray) -> None:
        sizes = np.diff(off)
        self.first = off[:-1] + np.arange(len(sizes))
        self.final = self.first + sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        start, length, self.piece, self.bare = arcs(pieces, points, off[1:][word])
        extra = [logs[byte_pieces(pieces, int(code))].sum() for code in self.bare]
        self.logs = np.concatenate([logs, extra])[self.piece]
        self.word = word[start]
        self.depth = start - off[self.word]
        self.source = start + self.word
        self.target = self.source + length
        self.reach = self.depth + length
        self.places = len(points) + len(sizes)

    def _in_order(self, level: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
        """The arcs of one level after the other, in order of place."""
        order = np.lexsort((place, level))
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        yield from np.split(order, cuts) if len(order) else ()

    def forward(self) -> np.ndarray:
        alpha = np.full(self.places, -np.inf)
        alpha[self.first] = 0
        for some in self._in_order(self.reach, self.target):
            place, total = _sums(alpha[self.source[some]] + self.logs[some], self.target[some])
            alpha[place] = total
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full(self.places, -np.inf)
        beta[self.final] = 0
        for some in self._in_order(-self.depth, self.source):
            place, total = _sums(beta[self.target[some]] + self.logs[some], self.source[some])
            beta[place] = total
        return beta

    def expected(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece, and of each code point without one, by words that occur so often."""
        alpha, beta = self.forward(), self.backward()
        share = np.exp(alpha[self.source] + self.logs + beta[self.target] - alpha[self.final][self.word])
        return np.bincount(self.piece, share * counts[self.word], size + len(self.bare))


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each behind a START, and where each begins."""
    texts = words.to_pylist()
    points = np.frombuffer("".join(["\x00" + text for text in texts]).encode("utf-32-le", "replace"), np.uint32).copy()
    off = np.cumsum([0, *[len(text) + 1 for text in texts]])
    points[points == START] = FOREIGN
    points[off[:-1]] = START
    return points, off


def lattices(pieces: Pieces, logs: np.ndarray, words: pa.Array) -> Iterator[tuple[int, int, Lattice]]:
    """``(first word, last word, lattice)`` for runs of words."""
    points, off = _points(words)
    for i, j in slices(off, HELD):
        yield i, j, Lattice(pieces, logs, points[off[i] : off[j]], off[i : j + 1] - off[i])


def log_probabilities(pieces: Pieces, logs: np.ndarray, words: pa.Array) -> np.ndarray:
    """Natural logarithms of the words' probabilities."""
    parts = []
    for _, _, lattice in lattices(pieces, logs, words):
        parts.append(lattice.forward()[lattice.final])
    return np.concatenate(parts) if parts else np.zeros(0)


def expected_counts(pieces: Pieces, logs: np.ndarray, words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece."""
    size = len(pieces.prior)
    total = np.zeros(size)
    for i, j, lattice in lattices(pieces, logs, words):
        uses = lattice.expected(counts[i:j], size)
        total += uses[:size]
        for code, n in zip(lattice.bare, uses[size:]):
            np.add.at(total, byte_pieces(pieces, int(code)), n)
    return total


def learnt(pieces: Pieces, words: DataFrame, texts: int, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Logarithms of the pieces' probabilities, from ``words`` (word, c) and the number of texts."""
    spark = words.sparkSession
    known = spark.sparkContext.broadcast(pieces)
    with np.errstate(divide="ignore"):
        logs = np.log(pieces.prior)
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(logs)

        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(known.value.prior))
            for batch in batches:
                total += expected_counts(known.value, given.value, batch["word"], batch["c"].to_numpy())
            some = np.flatnonzero(total)
            yield pa.record_batch({"piece": pa.array(some, pa.int32()), "n": pa.array(total[some])})

        # A row per piece of the vocabulary at most.
        sums = words.select("word", "c").mapInArrow(uses, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        total = prior * pieces.prior
        total[pieces.end] += texts
        for piece, n in sums.collect():
            total[piece] += n
        with np.errstate(divide="ignore"):
            logs = np.log(total / total.sum())
    return logs


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: runs of bytes other than white space, within a text."""
    solid = np.concatenate([[False], (data != 0x20) & ~((data >= 0x09) & (data <= 0x0D)), [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid[1:] & (~solid[:-1] | edge)
    end = solid[:-1] & (~solid[1:] | edge)
    return np.flatnonzero(start), np.flatnonzero(end)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(starts), np.uint64), 0
    inverse = inverse_powers(HASHED)
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + HASHED, "right")))
        part = data[base : ends[upto - 1]]
        if len(part) >= len(inverse):
            inverse = inverse_powers(len(part))
        out[at:upto] = stretch_hashes(prefix_hashes(part), inverse, starts[at:upto] - base, ends[at:upto] - base)
        at = upto
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = utf8(batch["text"])
        ids, known = batch["doc_id"].fill_null(0).to_numpy(), batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        held = batch["held_out"].to_numpy(zero_copy_only=False)
        for i, j in slices(offsets, BLOCK):
            off = offsets[i : j + 1]
            part, off = LOWER[data[off[0] : off[-1]]], off - off[0]
            starts, ends = _words_of(part, off)
            codes, values = pd.factorize(_hashes(part, starts, ends))
            doc = np.searchsorted(off, starts, "right") - 1
            # Of rows with equal offsets the last has the text.
            sizes = np.bincount(doc, minlength=j - i)
            first = np.empty(len(values), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            a, n = starts[first], (ends - starts)[first]
            bounds = np.concatenate([[0], np.cumsum(n)])
            chars = part[np.repeat(a - bounds[:-1], n) + np.arange(bounds[-1])]
            words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(bounds), pa.py_buffer(chars)).cast(pa.string())
            taught = np.bincount(codes, ~held[i:j][doc], len(values)).astype(np.int64)
            yield pa.record_batch({
                "block": pa.array([block], pa.int64()),
                "ids": blobs([ids[i:j].astype(np.int64)]), "known": blobs([known[i:j]]), "held": blobs([held[i:j]]),
                "sizes": blobs([sizes.astype(np.int64)]), "codes": blobs([codes.astype(np.uint32)]),
                "words": pa.ListArray.from_arrays([0, len(words)], words),
                "taught": pa.ListArray.from_arrays([0, len(taught)], pa.array(taught)),
                "texts": pa.array([int((~held[i:j]).sum())], pa.int64()),
            })
            block += 1


def _added(end_count: int, floor: float, end_log: float):
    """Adds up the scores of a block's documents; ``floor`` is the logarithm of the base's denominator."""

    def run(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        sizes, codes = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["codes"], np.uint32)
        at = found["pos"].to_numpy()
        c, logs = np.zeros(len(at)), np.zeros(len(at))
        c[at], logs[at] = found["c"].to_numpy(), found["log"].to_numpy()
        base = np.log10(c + SMOOTH) - floor

        def per_text(values: np.ndarray) -> np.ndarray:
            out, some = np.zeros(len(sizes)), sizes > 0
            if some.any():
                out[some] = np.add.reduceat(values[codes], (np.cumsum(sizes) - sizes)[some])
            return out

        ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        return pa.table({
            "doc_id": pa.array(ids, mask=~known),
            "held_out": pa.array(np.frombuffer(row["held"], bool)),
            "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(per_text((c > 0).astype(float)).astype(np.int64) + int(end_count > 0)),
            "base_score": pa.array(per_text(base) + np.log10(end_count + SMOOTH) - floor),
            "score": pa.array((per_text(logs) + end_log) / LN10),
        })

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def scored(docs: DataFrame, vocabulary: str, ranks: bool = True, rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    ``score`` is the model's log10 probability of the text; ``base_score`` that of a model of
    whole words with ``SMOOTH`` added to every count. Both learn from the rows not held out.
    """
    pieces = read_pieces(vocabulary, ranks)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    packed = stored(texts.mapInArrow(_pack, PACKED), "blocks")
    words = packed.select("block", F.posexplode(F.arrays_zip("words", "taught")).alias("pos", "w"))
    counted = words.groupBy("w.words").agg(F.sum("w.taught").alias("c"))
    counted = stored(counted.select(F.col("words").alias("word"), "c"), "words")
    total = counted.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = packed.agg(F.sum("texts")).first()[0] or 0
    tokens, distinct = (total.n or 0) + ends, total.v + int(ends > 0)
    logs = learnt(pieces, counted.filter("c > 0"), ends, rounds, prior)
    return _with_scores(packed, counted, pieces, logs, ends, tokens, distinct)


def _with_scores(packed, counted, pieces: Pieces, logs: np.ndarray, ends: int, tokens: int, distinct: int) -> DataFrame:
    spark: SparkSession = packed.sparkSession
    model = spark.sparkContext.broadcast((pieces, logs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log_probabilities(*model.value, batch["word"])
            yield pa.record_batch({"word": batch["word"], "c": batch["c"], "log": pa.array(found, pa.float64())})

    scores = stored(counted.mapInArrow(score, "word string, c long, log double"), "scores")
    words = packed.select("block", F.posexplode("words").alias("pos", "word"))
    found = words.join(scores, "word").select(F.col("block").alias("of"), "pos", "c", "log")
    rows = packed.drop("words", "taught", "texts").groupBy("block").cogroup(found.groupBy("of"))
    floor = float(np.log10(tokens + SMOOTH * (distinct + 1)))
    sums = rows.applyInArrow(_added(ends, floor, float(logs[pieces.end])), SCORED)
    return sums.withColumn("train_tokens", F.lit(tokens).cast("long"))
