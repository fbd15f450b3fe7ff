"""Near-duplicate vectors by product quantisation, with an exact check.

1. Coarse centroids and, on what is left of vectors after their centroid, a codebook for
   each subspace are fitted by k-means on at most ``TRAINING_ROWS`` of the vectors fit for
   comparison, the first by a hash of the id. There is one coarse list for each ``LIST_ROWS`` vectors, ``MOST_LISTS``
   at most: beyond that lists grow, and are cut into more blocks.
2. Every vector is kept in the list of its nearest centroid, as a code, with the length of
   its quantisation error; it probes all lists that a vector within reach could be in. Two
   unit vectors with the cosine in question are at most ``reach`` apart, so only lists
   whose border (the plane half way between the two centroids) is within reach count.
3. A list's vectors and those that probe it are cut into blocks, and each pair of blocks
   is a tile. A tile adds up the asymmetric distances from tables per query and subspace,
   keeps pairs whose distance less the error is within reach, and reranks them by the
   exact cosine in double precision. By the triangle inequality no link is lost.
4. A tile returns counts per query and, instead of links, one link from each vector to the
   least of its component within the tile.

Only vectors with equal labels meet. Null labels, null, empty or zero vectors, and vectors
with null or non-finite components link with nothing; vectors of different lengths do not
link. A null id links with nothing. Of rows that repeat an id the least by label and vector
that is fit counts, and each row gets its result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.components import components
from eavista.llm.shared import stored

TRAINING_ROWS = 20_000
LIST_ROWS = 400
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 256
STEPS = 8
BLOCK = 768
# For distances in single precision; the cosine itself is in double.
SLACK = 1e-3


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # list by dimension
    books: np.ndarray  # subspace by code by its dimensions

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors cut into subspaces, filled with zeros to equal widths."""
        m, width = self.books.shape[0], self.books.shape[2]
        wide = np.zeros((len(vectors), m * width), vectors.dtype)
        wide[:, : vectors.shape[1]] = vectors
        return wide.reshape(len(vectors), m, width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids after a few rounds from rows drawn at random; one without rows stays."""
    distinct = np.unique(rows, axis=0)
    k = min(k, len(distinct))
    found = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(STEPS):
        nearest = np.concatenate([squares(rows[i : i + 4096], found).argmin(1) for i in range(0, len(rows), 4096)])
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, rows)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def fit(rows: np.ndarray, lists: int) -> Index:
    centroids = k_means(rows, lists, 1)
    nearest = np.concatenate([squares(rows[i : i + 4096], centroids).argmin(1) for i in range(0, len(rows), 4096)])
    rest = rows - centroids[nearest]
    width = -(-rows.shape[1] // SUBSPACES)
    parts = Index(centroids, np.zeros((SUBSPACES, 1, width))).parts(rest)
    books = [k_means(parts[:, m], CODES, 2 + m) for m in range(SUBSPACES)]
    # Where fewer values than codes occur, the last code is repeated.
    books = [np.concatenate([b, np.repeat(b[-1:], CODES - len(b), axis=0)]) for b in books]
    return Index(centroids, np.stack(books))


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, filled with zeros to ``width``, and which of the rows are fit for comparison."""
    out, good = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for row, values in enumerate(column.to_pylist()):
        if values is not None and None not in values and len(values):
            vector = np.array(values, np.float64)
            with np.errstate(all="ignore"):
                largest = np.abs(vector).max()
                length = np.linalg.norm(vector / largest) if np.isfinite(largest) and largest > 0 else np.nan
            if np.isfinite(length):
                out[row, : len(vector)] = vector / largest / length
                good[row] = True
    return out, good


def _indexed(index: Index, width: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = np.sqrt(squares(index.centroids, index.centroids))
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                unit, good = _unit(part["vector"], width)
                part, unit = part.filter(pa.array(good)), unit[good]
                if not len(unit):
                    continue
                far = squares(unit, index.centroids)
                nearest = far.argmin(1)
                rest = index.parts(unit - index.centroids[nearest])
                codes = np.stack([squares(rest[:, m], index.books[m]).argmin(1) for m in range(SUBSPACES)], 1)
                error = np.sqrt(((rest - index.books[np.arange(SUBSPACES), codes]) ** 2).sum((1, 2)))
                own = far[np.arange(len(unit)), nearest][:, None]
                near = far - own <= 2 * gaps[nearest] * (reach + SLACK)
                near[np.arange(len(unit)), nearest] = True
                yield pa.record_batch({
                    "vec_id": part["vec_id"], "label": part["label"], "width": part["width"],
                    "list": pa.array(nearest.astype(np.int32)),
                    "probes": pa.array([np.flatnonzero(x).astype(np.int32) for x in near], pa.list_(pa.int32())),
                    "vector": pa.array([x.tobytes() for x in unit], pa.binary()),
                    "code": pa.array([x.tobytes() for x in codes.astype(np.uint8)], pa.binary()),
                    "error": pa.array(error),
                })

    return run


def _compared(index: Index, cosine: float, reach: float):
    """One tile: counts of links per query, and links to the least of each component."""

    def run(tile: pa.Table) -> pa.Table:
        asks = tile["asks"].to_numpy()
        ids = tile["vec_id"].to_numpy()
        query, held = np.flatnonzero(asks), np.flatnonzero(~asks)
        empty = np.zeros(0, np.int64)
        out = {"vec_id": [empty], "n": [empty], "least": [empty]}
        if len(query) and len(held):
            vectors = np.frombuffer(b"".join(tile["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
            codes = np.frombuffer(b"".join(tile["code"].take(pa.array(held)).to_pylist()), np.uint8).reshape(len(held), -1)
            error = tile["error"].to_numpy()[held]
            rest = index.parts(vectors[query] - index.centroids[tile["list"][0].as_py()])
            apart = np.zeros((len(query), len(held)), np.float32)
            for m in range(SUBSPACES):
                apart += squares(rest[:, m], index.books[m]).astype(np.float32)[:, codes[:, m]]
            x, y = np.nonzero(np.sqrt(apart) <= reach + SLACK + error)
            links = np.zeros(apart.shape, bool)
            for i in range(0, len(x), 1 << 16):
                a, b = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
                links[a, b] = np.einsum("ij,ij->i", vectors[query[a]], vectors[held[b]]) >= cosine
            links &= ids[query][:, None] != ids[held][None, :]
            left, right = ids[query].copy(), ids[held].copy()
            none = np.iinfo(np.int64).max
            while True:
                low = np.minimum(left, np.where(links, right, none).min(1))
                high = np.minimum(right, np.where(links, low[:, None], none).min(0))
                if (low == left).all() and (high == right).all():
                    break
                left, right = low, high
            some = links.any(1)
            out["vec_id"] += [ids[query][some], ids[held]]
            out["n"] += [links.sum(1)[some], np.zeros(len(held), np.int64)]
            out["least"] += [left[some], right]
        found = {k: np.concatenate(v) for k, v in out.items()}
        use = (found["n"] > 0) | (found["least"] != found["vec_id"])
        return pa.table({k: pa.array(v[use].astype(np.int64)) for k, v in found.items()})

    return run


def near_duplicates(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """A row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = table.sparkSession
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"), F.size("embedding").alias("width"),
    )
    use = rows.filter("vec_id is not null and label is not null and vector is not null and width > 0")
    repeated = not use.groupBy("vec_id").count().filter("count > 1").isEmpty()
    # Fit for comparison, as in ``_unit``: before counting and sampling, which decide for all rows.
    unfit = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    use = use.filter(~unfit & F.exists("vector", lambda x: x != 0))
    if repeated:
        use = use.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "width")).alias("row")).select("vec_id", "row.*")
    widest, n = use.agg(F.max("width"), F.count(F.lit(1))).first()
    ids = rows.select("vec_id")
    if not n:
        component = F.col("vec_id").alias("component_id")
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), component, F.lit(True).alias("kept"))
    sample = use.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAINING_ROWS).select("vector").toArrow()["vector"]
    sample, _ = _unit(sample.combine_chunks(), widest)
    index = fit(sample, min(MOST_LISTS, max(1, n // LIST_ROWS)))
    reach = float(np.sqrt(2 - 2 * cosine))
    kept = stored(
        use.mapInArrow(
            _indexed(index, widest, reach),
            "vec_id long, label string, width int, list int, probes array<int>, vector binary, code binary, error double",
        ),
        "index",
    )
    key = ["label", "width", "list"]
    asks = kept.select("vec_id", "label", "width", F.explode("probes").alias("list"), "vector")
    n_held = kept.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("held_blocks"))
    n_asks = asks.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ask_blocks"))
    blocks = stored(n_held.join(n_asks, key), "tiles")
    place = F.xxhash64("vec_id")
    held = kept.select(*key, "vec_id", "vector", "code", "error").join(blocks, key).select(
        *key, F.pmod(place, "held_blocks").cast("int").alias("held_block"),
        F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask_block"),
        F.lit(False).alias("asks"), "vec_id", "vector", "code", "error",
    )
    asks = asks.join(blocks, key).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("held_blocks") - 1)).alias("held_block"),
        F.pmod(place, "ask_blocks").cast("int").alias("ask_block"),
        F.lit(True).alias("asks"), "vec_id", "vector", F.lit(None).cast("binary").alias("code"),
        F.lit(0.0).alias("error"),
    )
    tiles = held.union(asks).groupBy(*key, "held_block", "ask_block")
    found = stored(tiles.applyInArrow(_compared(index, cosine, reach), "vec_id long, n long, least long"), "found")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    named = components(found.filter("vec_id <> least").select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    result = ids.join(stored(counts, "counts"), "vec_id", "left")
    result = result.join(named, F.col("vec_id") == F.col("vertex"), "left")
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
