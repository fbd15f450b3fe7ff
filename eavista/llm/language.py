"""Language shares of a document, by a mixture over its words.

Each language has a character trigram model, learned from labelled documents. A
document's words are drawn from a mixture of languages; expectation-maximisation
estimates the shares. Sets of languages grow in the order of the shares under all of
them, and the set with the best likelihood less a penalty per language counts. The
prediction is the language with the largest share in that set, the score its share.

The model is fitted on a sample: of each language about ``TRAINING_ROWS`` documents,
those whose hashed id falls below the rate that gives this number, with a null id
never in it. Counts are summed per language in Spark; the driver gets one table of
``2**BITS`` counts per language.

Null text, or text without a letter, gives ``und`` and score 0. Where nothing is
labelled, every text is ``und``. Equal shares go to the first language by name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.shared import held_out, mixed

TRAINING_ROWS = 2_000
BITS = 15
STEPS = 8
# Nats that a further language costs, times the logarithm of the number of words.
PENALTY = 2.0
CHUNK = 1 << 19


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    costs: np.ndarray  # log probabilities, trigram by language


def _letters() -> np.ndarray:
    """Lower-case form of each character of the basic plane; 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint16)
    for code in range(1 << 16):
        char = chr(code)
        if unicodedata.category(char)[0] in "LM":
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
    return out


LETTERS = _letters()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, edges included, then the place of each word's first and its text."""
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Letters beyond the basic plane share a few classes.
    high = codes >= 1 << 16
    chars = LETTERS[np.where(high, 0, codes)]
    if high.any():
        letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in codes[high]])
        chars[high] = np.where(letter, 0xE000 + codes[high] % 64, 0)
    inside = chars != 0
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(before & ~inside)
    # A word's trigrams are those centred on its letters; a non-letter beside it is its edge.
    wide = np.concatenate([[0], chars, [0]]).astype(np.uint64)
    key = (wide[:-2] << np.uint64(32)) | (wide[1:-1] << np.uint64(16)) | wide[2:]
    lengths = last - first
    keys = mixed(key[inside]) >> np.uint64(64 - BITS)
    starts = np.cumsum(lengths) - lengths
    sizes = np.array([len(t) + 1 for t in texts])
    text = np.searchsorted(np.cumsum(sizes), first, "right")
    return keys.astype(np.int64), starts, text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task, per language."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            keys, _, _ = trigrams([text])
            counts[lang] = counts.get(lang, 0) + np.bincount(keys, minlength=1 << BITS)
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "gram": at, "n": found[at]})


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> LanguageModel:
    """Trigram models of the languages that documents outside the held-out fifth name."""
    learn = docs.select("doc_id", "text", "lang").filter(
        ~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    per_lang = {r.lang: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not per_lang:
        return LanguageModel((), np.zeros((1 << BITS, 0)))
    rate = F.create_map(*[x for k, n in per_lang.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    share = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) / 1_000_003
    sample = learn.filter(share < rate[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    names = tuple(sorted(per_lang))
    table = np.zeros((1 << BITS, len(names)))
    for row in counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("all")).collect():
        pairs = np.array([(p.gram, p.n) for p in row["all"]], np.int64).reshape(-1, 2)
        table[pairs[:, 0], names.index(row.lang)] = pairs[:, 1]
    table += 0.5
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixtures(costs: np.ndarray, starts: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log likelihood per text: ``costs`` by word, ``starts`` the first word of each text, ``active`` languages."""
    peak = costs.max(axis=1, keepdims=True)
    words = np.exp(costs - peak)
    sizes = np.diff(np.append(starts, len(costs)))
    of = np.repeat(np.arange(len(starts)), sizes)
    shares = active / active.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        parts = words * shares[of]
        parts /= np.maximum(parts.sum(axis=1, keepdims=True), 1e-300)
        shares = np.add.reduceat(parts, starts, axis=0) / sizes[:, None]
    total = np.log(np.maximum((words * shares[of]).sum(axis=1), 1e-300)) + peak[:, 0]
    return shares, np.add.reduceat(total, starts)


def detect(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
    """Predicted language, its share and the chosen set (names in order, comma between) of each text."""
    languages, scores, sets = ["und"] * len(texts), np.zeros(len(texts)), [""] * len(texts)
    keys, starts, of = trigrams(texts)
    if not len(keys) or not model.names:
        return languages, scores, sets
    costs = np.add.reduceat(model.costs[keys], starts, axis=0).astype(np.float64)
    there, first = np.unique(of, return_index=True)
    n, k = len(there), len(model.names)
    words = np.diff(np.append(first, len(of)))
    shares, _ = mixtures(costs, first, np.ones((n, k)))
    order = np.argsort(-shares, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    best, chosen = np.full(n, -np.inf), np.zeros((n, k))
    for size in range(1, k + 1):
        fitted, likelihood = mixtures(costs, first, (rank < size).astype(float))
        value = likelihood - PENALTY * size * np.log(words + 1)
        better = value > best
        best[better], chosen[better] = value[better], fitted[better]
        if not better.any():
            break
    for row, share in zip(there, chosen):
        if not any(map(str.isalpha, texts[row])):
            # Marks go on with a word, but are no letters by themselves.
            continue
        top = int(np.argmax(share))
        languages[row], scores[row] = model.names[top], min(1.0, share[top])
        sets[row] = ",".join(model.names[i] for i in np.flatnonzero(share > 0))
    return languages, scores, sets


def _detected(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].fill_null("").to_pylist()
            sizes = np.cumsum([0] + [len(t) for t in texts])
            names, scores, sets, at = [], [], [], 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK, "right")) - 1)
                a, b, c = detect(model, texts[at:end])
                names, scores, sets, at = names + a, [*scores, *b], sets + c, end
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()), "languages": pa.array(sets, pa.string()),
            })

    return run


def identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """A row per document: ``doc_id, held_out, lang_pred, score, languages``."""
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(
        _detected(model), "doc_id long, held_out boolean, lang_pred string, score double, languages string"
    )
