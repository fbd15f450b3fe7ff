"""Toxicity by a support vector machine on gapped subsequences.

The kernel of two strings sums, over all subsequences of ``LENGTH`` letters, the products
of their weights in both; an occurrence weighs ``DECAY`` to the power of the stretch it
covers, and at most ``GAP`` characters may stand between two of its letters. So an insult
with characters put between its letters still shares most subsequences with the plain one.

Landmarks are the words that set toxic texts apart, and windows of clean texts that are
most like them. A Nyström map
(inverse root of the landmarks' kernel) turns a window of text into a vector of landmark
kernels, on which a linear machine is trained: windows at landmark words of toxic texts
(and the worst window of a toxic text without any), plain and spread, against the worst
windows of clean texts, found anew in each of a few rounds. As the machine is
linear in the kernel, it folds into one weight per subsequence. Scoring adds these weights
over the whole text, sums them in a sliding window, and takes the worst window.

The model learns from at most ``TRAINING_ROWS`` labelled documents per class, the first by
a hash of the id among those outside the held-out fifth and of at most ``LONGEST``
characters. Null text counts as empty and has the score of an empty window. Labels that
name a document more than once count as toxic if any does; null labels count for nothing.
Where a class is missing, every score is the share of toxic labels.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.shared import give_back, held_out, lean

LENGTH = 4
GAP = 1
DECAY = 0.95
WINDOW = 20
COST = 20_000.0
PASSES = 30
USES = 12
# Toxic texts that a word must be in to count as an insult.
LEAST_USES = 4
WORST = 3
LANDMARKS = 400
INSULTS = 96
TRAINING_ROWS = 2_000
LONGEST = 20_000
ROUNDS = 3
CHUNK = 1 << 19

SYMBOLS = 32
STEPS = tuple(itertools.product(range(1, GAP + 2), repeat=LENGTH - 1))


def _folded() -> np.ndarray:
    """Class of each character of the basic plane: 1 to 26 for a to z with or without accent, 27 to 31 for other letters, else 0."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        char = unicodedata.normalize("NFD", chr(code))[0].lower()[0]
        if "a" <= char <= "z":
            out[code] = ord(char) - 96
        elif char.isalpha():
            out[code] = 27 + code % 5
    return out


FOLDED = _folded()


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts with a blank window after each, and where each starts.

    A mark between two letters is left out, so that marks put into a word leave it whole.
    """
    codes = np.frombuffer((" " * WINDOW).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.where(codes < 1 << 16, FOLDED[np.minimum(codes, (1 << 16) - 1)], 27 + codes % 5).astype(np.uint8)
    letter = classes > 0
    inner = np.zeros(len(codes), bool)
    inner[1:-1] = ~letter[1:-1] & letter[:-2] & letter[2:] & (codes[1:-1] > 32) & (codes[1:-1] != 0xA0)
    sizes = np.array([len(t) + WINDOW for t in texts])
    starts = np.cumsum(sizes) - sizes
    left = np.concatenate([[0], np.cumsum(~inner)])
    return classes[~inner], left[starts]


def occurrences(classes: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """For each way to step over gaps: its weight, and the subsequence that starts at each place."""
    wide = np.concatenate([classes, np.zeros((GAP + 1) * LENGTH, np.uint8)]).astype(np.int32)
    n = len(classes)
    pairs = {s: (wide[: n + (GAP + 1) * 2] << 5) | wide[s : s + n + (GAP + 1) * 2] for s in range(1, GAP + 2)}
    for a, b, c in STEPS:
        yield DECAY ** (a + b + c + 1), (pairs[a][:n] << 10) | pairs[c][a + b : a + b + n]


def _solid(keys: np.ndarray) -> np.ndarray:
    return ((keys & 31) > 0) & ((keys >> 5 & 31) > 0) & ((keys >> 10 & 31) > 0) & (keys >> 15 > 0)


def profile(classes: np.ndarray) -> Counter:
    """The subsequences of a string with their weights."""
    out: Counter = Counter()
    for weight, keys in occurrences(classes):
        for key in keys[_solid(keys)].tolist():
            out[key] += weight
    return out


def window_sums(classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The folded machine's value (without its bias) of the window that starts at each place."""
    values = np.zeros(len(classes), np.float32)
    for weight, keys in occurrences(classes):
        values += np.float32(weight) * weights[keys]
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.minimum(np.arange(len(classes)) + WINDOW, len(classes))
    return sums[ends] - sums[:-1]


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # by subsequence
    slope: float
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        sizes, out, at = np.cumsum([0] + [len(t) for t in texts]), np.zeros(len(texts)), 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK, "right")) - 1)
            classes, starts = folded(texts[at:end])
            worst = np.maximum.reduceat(window_sums(classes, self.weights), starts)
            out[at:end] = 1 / (1 + np.exp(-np.clip(self.slope * worst + self.bias, -30, 30)))
            at = end
        return out


def _words(classes: np.ndarray, starts: np.ndarray) -> list[set[bytes]]:
    cuts = [*starts.tolist(), len(classes)]
    texts = (classes[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))
    return [{w for w in text.split(b"\0") if len(w) >= LENGTH} for text in texts]


def _insults(words: list[set[bytes]], labels: np.ndarray) -> list[bytes]:
    """Words that set toxic texts apart, the surest first."""
    found = Counter(w for ws, y in zip(words, labels) if y for w in ws)
    clean = Counter(w for ws, y in zip(words, labels) if not y for w in ws)
    n, m = labels.sum(), len(labels) - labels.sum()

    def apart(word: bytes) -> float:
        p = (found[word] + clean[word] + 1) / (n + m + 2)
        return (found[word] / n - clean[word] / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))

    return sorted((w for w in found if found[w] >= LEAST_USES and apart(w) > 4), key=lambda w: (-apart(w), w))[:INSULTS]


def _worst(texts: list[str], weights: np.ndarray, places: int = 1) -> list[list[tuple[float, np.ndarray]]]:
    """Value and letters of each text's worst windows, apart from each other; the first is the worst."""
    out = []
    for i in range(0, len(texts), 128):
        classes, starts = folded(texts[i : i + 128])
        sums = window_sums(classes, weights)
        for a, b in zip(starts, np.append(starts[1:], len(classes))):
            here, found = sums[a:b].copy(), []
            for _ in range(places):
                at = int(np.argmax(here))
                found.append((float(here[at]), classes[a + at : min(a + at + WINDOW, b)].copy()))
                here[max(0, at - WINDOW) : at + WINDOW] = -np.inf
            out.append(found)
    return out


def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of the strings, and the strings' profiles on them, of length one."""
    profiles = [profile(np.frombuffer(w, np.uint8)) for w in strings]
    keys = np.array(sorted(set().union(*profiles)), np.int64)
    place = {k: i for i, k in enumerate(keys.tolist())}
    table = np.zeros((len(strings), len(keys)), np.float32)
    for row, p in enumerate(profiles):
        table[row, [place[k] for k in p]] = list(p.values())
    return keys, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def _uses(
    classes: np.ndarray, starts: np.ndarray, labels: np.ndarray, words: list[bytes]
) -> tuple[list[np.ndarray], set[int]]:
    """Windows of toxic texts that start with one of the words, ``USES`` of each, and the texts that have any."""
    text, windows, named = classes.tobytes(), [], set()
    for word in words:
        count = 0
        for use in re.finditer(b"(?<![\x01-\x1f])" + re.escape(word) + b"(?![\x01-\x1f])", text):
            of = int(np.searchsorted(starts, use.start(), "right")) - 1
            if labels[of]:
                named.add(of)
                count += 1
                if count <= USES:
                    windows.append(classes[use.start() : use.start() + max(WINDOW // 2, len(word))])
    return windows, named


def _spread(window: np.ndarray) -> list[np.ndarray]:
    """A window's letters as they are, with a letter put in, with a blank after each, and with a letter after each."""
    letters = window[window > 0][: WINDOW // 2]
    return [window, np.insert(letters, len(letters) // 2, 24)] + [np.stack([letters, np.full(len(letters), x)], 1).ravel()[:-1].astype(np.uint8) for x in (0, 24)]


def _machine(vectors: np.ndarray, labels: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Linear support vector machine by dual coordinate ascent, rows in a fixed shuffled order; the last weight is the bias."""
    rows = np.hstack([vectors, np.ones((len(vectors), 1))])
    signs, most = np.where(labels, 1.0, -1.0), COST * share
    squares = (rows * rows).sum(axis=1)
    order = np.random.default_rng(5)
    weights, pull = np.zeros(rows.shape[1]), np.zeros(len(rows))
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            old = pull[i]
            pull[i] = min(max(old + (1 - signs[i] * (rows[i] @ weights)) / squares[i], 0.0), most[i])
            if pull[i] != old:
                weights += (pull[i] - old) * signs[i] * rows[i]
    return weights


def _calibrated(worst: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve through the training texts' values (Platt)."""
    scale, centre = max(worst.std(), 1e-9), worst.mean()
    x, a, b = (worst - centre) / scale, 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = share * p * (1 - p) + 1e-9
        g = share * (p - labels)
        step = np.linalg.solve(
            [[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]],
            [(g * x).sum() + 1e-4 * a, g.sum()],
        )
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    a = max(a, 1e-3)
    return a / scale, b - a * centre / scale


def fit(texts: list[str], labels: list[int], prior: float | None = None) -> ToxicityModel:
    """The machine for labelled texts; ``prior`` is the share of toxic ones where they come from."""
    labels = np.array(labels, float)
    size = SYMBOLS**LENGTH
    if not 0 < labels.sum() < len(labels):
        rate = prior if prior is not None else labels.mean() if len(labels) else 0.0
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(size, np.float32), 0.0, float(np.log(rate / (1 - rate))))
    classes, starts = folded(texts)
    insults = _insults(_words(classes, starts), labels)
    uses, named = _uses(classes, starts, labels, insults)
    # What clean texts hold that is most like the insults makes the other landmarks.
    weights = np.zeros(size, np.float32)
    if insults:
        keys, table = _table(insults)
        weights[keys] = table.sum(axis=0)
    like = sorted(
        (-value, window.tobytes())
        for found, y in zip(_worst(texts, weights), labels) if not y
        for value, window in found
    )
    marks = list(dict.fromkeys(insults + [w for _, w in like]))[:LANDMARKS]
    keys, table = _table(marks)
    place = np.full(size, -1, np.int32)
    place[keys] = np.arange(len(keys))
    values, base = np.linalg.eigh((table @ table.T).astype(np.float64))
    root = base @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ base.T

    def vectors(windows: list[np.ndarray]) -> np.ndarray:
        """The Nystroem map of windows."""
        out = []
        for a in range(0, len(windows), 512):
            part = np.zeros((len(windows[a : a + 512]), len(keys)), np.float32)
            for row, window in zip(part, windows[a : a + 512]):
                for weight, found in occurrences(window):
                    at = place[found]
                    np.add.at(row, at[at >= 0], np.float32(weight))
            out.append(part @ table.T)
        return np.concatenate(out) @ root

    clean: dict[bytes, np.ndarray] = {}
    for _ in range(ROUNDS):
        good, worst = list(uses), _worst(texts, weights, WORST)
        # A toxic text without a known insult counts where it stands out from nearly all clean ones.
        high = np.quantile([found[0][0] for found, y in zip(worst, labels) if not y], 0.99)
        for i, found in enumerate(worst):
            if not labels[i]:
                clean.update((window.tobytes(), window) for _, window in found)
            elif i not in named and found[0][0] > max(high, 0):
                good.append(found[0][1])
        windows = [x for w in good for x in _spread(w)] + list(clean.values())
        is_bad = np.arange(len(windows)) < 4 * len(good)
        share = np.where(is_bad, 0.5 / max(1, is_bad.sum()), 0.5 / (~is_bad).sum())
        found = _machine(vectors(windows), is_bad, share)
        weights = np.zeros(size, np.float32)
        weights[keys] = (root @ found[:-1]) @ table
    # Single uses count beside whole texts: a text may hold one insult only.
    worst = np.array([found[0][0] for found in _worst(texts, weights)])
    single = np.array([min(window_sums(x, weights).max() for x in _spread(w)[:2]) for w in uses])
    known = np.concatenate([labels, np.ones(len(single))])
    sample = np.where(known == 1, 0.2 / labels.sum(), 0.7 / (len(labels) - labels.sum()))
    sample[len(labels) :] = 0.1 / max(1, len(single))
    return ToxicityModel(weights, *_calibrated(np.concatenate([worst, single]), known, sample))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """The machine for the labelled documents outside the held-out fifth."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    counts = {int(r.toxic > 0): r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.filter(F.length("text") <= LONGEST)
    ids, found = [], []
    for toxic in (0, 1):
        some = known.filter((F.col("toxic") > 0) == bool(toxic))
        # The bound on rows makes this side fit a broadcast.
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for row in texts.join(F.broadcast(some.select("doc_id")), "doc_id").collect():
            found.append((row.doc_id, row.text, toxic))
    found.sort()
    return fit([x[1] for x in found], [x[2] for x in found], prior)


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch["_text"].fill_null("").to_pylist())
            yield pa.record_batch({"_key": batch["_key"], "_score": pa.array(scores, pa.float64())})

    return run


def scored(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """A row per document: ``doc_id, held_out, score, predicted``."""
    model = model or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("_key"), F.col("text").alias("_text"))
    found = rows.mapInArrow(lean(_scored(model)), "_key long, _score double").select(
        F.col("_key").alias("doc_id"), F.col("_score").alias("score")
    )
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns."""
    model = model or train(docs, labels)

    def clean(text: pd.Series) -> pd.Series:
        clean = pd.Series(model.scores(text.fillna("").tolist()) < 0.5, dtype=bool)
        give_back(every=2.0)
        return clean

    return docs.filter(F.pandas_udf(clean, "boolean")("text"))
