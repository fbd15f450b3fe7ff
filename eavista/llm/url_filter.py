"""URL filter: rules by domain and path, and a linear model for the rest.

The model is a logistic regression on hashed character n-grams of host and path. It
is fitted on the driver, on a small labelled table of urls: those that a rule of the
list judges, at most ``LABELLED_ROWS`` distinct ones per verdict, the first by a hash
of the url. Scoring runs in the tasks on every url; only the url column is read.

A null url, or one without ``://``, has empty host and path; no rule fits it and the
model judges the empty string. Where no url is labelled, or only one way, the model
is constant: the labelled verdict, else allow. Repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.shared import mixed, slices, utf8

# The rules, as host, path and verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

LABELLED_ROWS = 10_000
NGRAMS = (3, 4, 5)
BITS = 16
EPOCHS = 12
RATE = 2.0
DECAY = 1e-6


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float


def address(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host, its A-Z in lower case, and path."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda rule: (len(rule[0] + rule[1]), rule)):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        name = F.when(fits, domain + start).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of rows of bytes, as (row, bucket); the edges of a row count as characters."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)
    starts = offsets[:-1] + 2 * np.arange(len(offsets) - 1)
    codes = np.full(len(rows), 256, np.uint64)
    inner = np.ones(len(rows), bool)
    inner[starts] = False
    inner[starts + np.diff(offsets) + 1] = False
    codes[inner] = data
    found, keys = [], []
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + codes[k : k + m]
        whole = rows[:m] == rows[n - 1 :]
        found.append(rows[:m][whole])
        keys.append(mixed(key[whole]) >> np.uint64(64 - bits))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(keys).astype(np.int64)


def _margins(weights: np.ndarray, bias: float, rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Linear scores; a row's grams weigh one together, in length."""
    sums = np.bincount(rows, weights[keys], n)
    return bias + sums / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))


def fit(texts: list[str], blocked: list[int]) -> UrlModel:
    """Logistic regression by gradient steps with a step size per weight (Adagrad), over all rows each."""
    labels = np.array(blocked, float)
    if len(set(blocked)) < 2:
        return UrlModel(np.zeros(1 << BITS), 10.0 if blocked and blocked[0] else -10.0)
    data, offsets = utf8(pa.array(texts, pa.string()))
    rows, keys = grams(data, offsets)
    n = len(texts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    weights, bias, seen, seen_bias = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(EPOCHS * 10):
        p = 1 / (1 + np.exp(-np.clip(_margins(weights, bias, rows, keys, n), -50, 50)))
        slope = (p - labels) * share
        step = np.bincount(keys, (slope * scale)[rows], 1 << BITS) + DECAY * weights
        seen += step * step
        seen_bias += slope.sum() ** 2
        weights -= RATE * 0.1 * step / np.sqrt(seen)
        bias -= RATE * 0.1 * slope.sum() / np.sqrt(seen_bias)
    return UrlModel(weights, float(bias))


def _text(host: F.Column, path: F.Column) -> F.Column:
    return F.concat(host, F.lit("\n"), path)


def train(pages: DataFrame, rules=RULES, rows: int = LABELLED_ROWS) -> UrlModel:
    """The model of the urls that ``rules`` judge."""
    host, path = address(F.col("url"))
    _, verdict = ruled(host, path, rules)
    labelled = pages.select(_text(host, path).alias("address"), verdict.alias("verdict"))
    texts, blocked = [], []
    for says in ("allow", "block"):
        some = (
            labelled.filter(F.col("verdict") == says).select("address").distinct()
            .orderBy(F.xxhash64("address"), "address").limit(rows).collect()
        )
        texts += [row.address for row in some]
        blocked += [int(says == "block")] * len(some)
    return fit(texts, blocked)


def _scores(model: UrlModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("_address"))
            out = np.zeros(len(batch))
            for i, j in slices(offsets, 1 << 20):
                at = offsets[i : j + 1]
                rows, keys = grams(data[at[0] : at[-1]], at - at[0])
                out[i:j] = 1 / (1 + np.exp(-np.clip(_margins(model.weights, model.bias, rows, keys, j - i), -50, 50)))
            yield batch.append_column("block_score", pa.array(out)).drop_columns(["_address"])

    return run


def judged(pages: DataFrame, rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """A row per page: ``page_id, host, path, rule, verdict, block_score``."""
    model = model or train(pages, rules)
    host, path = address(F.col("url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select("*", rule.alias("rule"), verdict.alias("ruled"), _text(F.col("host"), F.col("path")).alias("_address"))
    kinds = {f.name: f.dataType.simpleString() for f in urls.schema}
    kinds.pop("_address")
    scored = urls.mapInArrow(_scores(model), ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", block_score double")
    by_model = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "block_score"
    )
