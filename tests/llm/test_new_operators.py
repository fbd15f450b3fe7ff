"""Lattice scores, conversation tries and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eavista.llm import prefix_trie, spelling, subword_lattice
from eavista.llm.queries import vocabulary

EXTRA = ", block int, pos string, word string, h long, depth long, k int, top string, list string"
FILL = (1, "p", "w", 2, 3, 4, "t", "l")


# Lattice scores

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return subword_lattice.read_pieces(MODEL)


@pytest.fixture(scope="module")
def names():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not model.is_byte(i) and i > 2}


def cuttings(word, names, pieces):
    """All ways to cut a word, as lists of piece numbers."""
    text = "▁" + word.replace("▁", "\U0010FFFF")

    def ways(at):
        if at == len(text):
            yield []
            return
        if text[at] not in names:
            char = "▁" if text[at] == "\U0010FFFF" else text[at]
            for rest in ways(at + 1):
                yield [int(pieces.bytes_at[b]) for b in char.encode()] + rest
        for end in range(at + 1, min(at + 16, len(text)) + 1):
            if text[at:end] in names:
                for rest in ways(end):
                    yield [names[text[at:end]]] + rest

    return list(ways(0))


WORDS = ["the", "a", "erinan", "中文x", "▁a", "▁", "\U0001F9FF", "naïve", "aaaa", "x́"]


def test_marginals_are_sums_over_all_cuttings(pieces, names, monkeypatch):
    logs = np.log(np.where(pieces.prior > 0, pieces.prior, 1))
    wanted = [math.log(sum(math.exp(sum(logs[p] for p in way)) for way in cuttings(w, names, pieces))) for w in WORDS]
    for held in (1 << 17, 3):
        monkeypatch.setattr(subword_lattice, "HELD", held)
        found = subword_lattice.log_probabilities(pieces, logs, pa.array(WORDS))
        assert np.allclose(found, wanted, rtol=1e-12)
    assert len(cuttings("erinan", names, pieces)) > 10


def test_expected_counts_are_those_of_all_cuttings(pieces, names):
    logs, counts = np.log(np.where(pieces.prior > 0, pieces.prior, 1)), np.arange(1.0, len(WORDS) + 1)
    wanted = np.zeros(len(logs))
    for word, n in zip(WORDS, counts):
        ways = cuttings(word, names, pieces)
        shares = np.array([math.exp(sum(logs[p] for p in way)) for way in ways])
        for way, share in zip(ways, shares / shares.sum()):
            np.add.at(wanted, way, n * share)
    found = subword_lattice.expected_counts(pieces, logs, pa.array(WORDS), counts)
    assert np.allclose(found, wanted, rtol=1e-9, atol=1e-12)


def scored_rows():
    texts = ["The cat  the\tdog", "the cat", None, "", " \n", "unheard OF words É", "▁odd ▁ a", "b" * 3000 + " the", "the cat", "the " * 500, "\x85x\xa0y z"]
    ids = [*range(len(texts) - 1), None]
    return [(i, t) for i, t in zip(ids, texts)] + [(1, "the cat"), (1, "another text of that id"), (6, "kept out")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_lattice_scores(spark, pieces, names, monkeypatch, block):
    monkeypatch.setattr(subword_lattice, "BLOCK", block)
    rows = scored_rows()
    docs = spark.createDataFrame([r + FILL for r in rows], "doc_id long, text string" + EXTRA).repartition(3)
    found = subword_lattice.scored(docs, MODEL, rounds=1).collect()
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [""] for i, (_, t) in enumerate(rows)}
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(w for i, words in split.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    # One round of expectation-maximisation by enumeration of short words; the long one by the recursion.
    logs = np.log(np.where(pieces.prior > 0, pieces.prior, 1))
    total = subword_lattice.PRIOR * pieces.prior
    total[pieces.end] += counts[""]
    learnt = [w for w in counts if w]
    total = total + subword_lattice.expected_counts(pieces, logs, pa.array(learnt), np.array([float(counts[w]) for w in learnt]))
    logs = np.log(np.where(total > 0, total / total.sum(), 1))
    wanted = []
    for i, (doc, _) in enumerate(rows):
        words = split[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        score = (subword_lattice.log_probabilities(pieces, logs, pa.array(words[:-1], pa.string())).sum() + logs[pieces.end]) / math.log(10)
        wanted.append((doc, held[i], len(words), sum(counts[w] > 0 for w in words), n, round(base, 6), round(score, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(held) and not all(held)


def test_lattice_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert subword_lattice.scored(none, MODEL, rounds=1).isEmpty()


def test_learning_raises_the_likelihood(spark, pieces):
    words = spark.createDataFrame([("the", 50), ("erheit", 20), ("ción", 30)], "word string, c long")
    rounds = [subword_lattice.learnt(pieces, words, 10, rounds=r, prior=1.0) for r in (0, 1, 2, 4)]
    given = pa.array(["the", "erheit", "ción"])
    likely = [subword_lattice.log_probabilities(pieces, np.where(np.isfinite(l), l, -99), given) @ [50, 20, 30] for l in rounds]
    assert likely == sorted(likely) and likely[-1] > likely[0] + 10


# Conversation tries

def brute_trie(rows, family=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = own.get(c - int(math.fmod(c, family)), [])
        whole[c] = base[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def sums(node):
        below = [sums(child) for child in children[node]]
        own_saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        return (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))

    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        leaves, saved = sums(node)
        out.append((min(inside), len(node), parent, len(inside), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks():
    rng = np.random.default_rng(12)
    rows = []
    for conv in [*range(0, 40), 100, 105, 117, 250, 251, 333, -7, 999]:
        shared = int(rng.integers(0, 12))
        for turn in range(int(rng.integers(1, 16))):
            text = f"same {turn}" if turn < shared else rng.choice(["x", "yé", "", None, f"own {conv}"])
            rows.append((conv, turn, ("user", "assistant", None)[turn % 3], None if text is None else str(text)))
    # nulls, ties, repeated rows, copies of whole conversations, ids without turns of their own left
    rows += [(5, None, "system", "first"), (5, None, None, None), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, 2, "a", "tie")]
    rows += [(None, 1, "user", "nobody")] * 3
    rows += [(700 + i, t, "user", f"copy {t}") for i in range(30) for t in range(9)]
    rows += [(800 + i, 0, "user", "short") for i in range(12)]
    return rows


@pytest.mark.parametrize("width, span", [(4, 1024), (1, 2), (3, 1)])
def test_conversation_trie(spark, monkeypatch, width, span):
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rows = talks()
    schema = "conv_id long, turn long, role string, text string" + EXTRA
    frame = spark.createDataFrame([r + FILL for r in rows], schema).repartition(3)
    found = prefix_trie.trie(*prefix_trie.rebuilt(frame))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == brute_trie(rows)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    # of 100 families without a first conversation those that wish for more turns than they have are turnless
    rows = [(100 * i + 7, 0, "user", "hi") for i in range(30)]
    got = [tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame(rows, schema))).collect()]
    assert sorted(got, key=str) == brute_trie(rows) and any(r[1] == 0 and r[3] == 30 for r in got)
    assert prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame([], schema))).isEmpty()


def test_long_texts_and_one_long_conversation(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(700)] + [(2, 0, "user", "é" * 200_000), (3, 0, "user", "é" * 200_000)]
    got = [tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()]
    assert sorted(got, key=str) == brute_trie(rows)


# Spelling variants

def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(counts, times=2):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts), key=str)


@pytest.mark.parametrize("seed, longest, size", [(1, 4096, 7), (2, 8, 7), (3, 2, 5), (4, 4, 12)])
def test_variants(spark, monkeypatch, seed, longest, size):
    """Words of few letters, so that lists are long; runs of one letter; words one letter longer and shorter."""
    monkeypatch.setattr(spelling, "CHUNK", 64)
    monkeypatch.setattr(spelling, "ABREAST", 7)
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abé"), int(rng.integers(size - 2, size + 2)))) for _ in range(250)}
    words |= {"a" * n for n in range(1, 20)} | {"ab" * 6 + "a" * n for n in range(4)} | {"", "é", "z" * 400, "z" * 401, "z" * 200 + "y" + "z" * 199}
    counts = {w: int(rng.integers(1, 40)) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(frame, longest=longest).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got, key=str) == brute_variants(counts)


def test_thinned_words(spark):
    texts = ["The Quick quick Ünder under über UBER ÀÉÎ " * 3, None, "", "x" * 5000 + " naïve naïve", "colour color colour don't 1abcdef2abcdef×÷ÿ", "ÆTHER æther", "colours colour"]
    rows = [(None if i % 7 == 6 else i % 200, texts[i % len(texts)]) for i in range(900)]
    frame = spark.createDataFrame([r + FILL for r in rows], "doc_id long, text string" + EXTRA)
    counts, cut = Counter(), 0
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run, cut = run[:at] + run[at + 1:], cut + 1
            counts[run] += len(run) >= 5
    wanted = {w: n for w, n in counts.items() if n >= 3}
    assert {r.word: r.n for r in spelling.thinned_words(frame).collect()} == wanted and cut > 10
    found = spelling.variants(spelling.thinned_words(frame)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_variants(wanted)


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.thinned_words(none)).isEmpty()
