"""Spelling variants: words one edit apart, by edit-matrix rows over sorted lists.

Lists. Two words of lengths L and L, or L and L + 1, that are one edit apart share their
first a = L // 2 characters, or else their last L - a. So each word goes to lists by its
first half and by its last, for L its length and its length less one. A list of more than
``LONGEST`` words is cut again by halves of what its words do not share, until one character
is left, which no list of that size survives; so no list is unbounded, and no pair is lost. A
list by last characters leaves out pairs that share the first ones, which its sister has:
every pair is found once.

Scan. A list holds the sorted rests of its words, so words that share a beginning are a
range, found by the common prefixes of neighbours. All words of a list run down its ranges at
once: the edit-matrix row of a range, a band of three cells, is reckoned once from that of
the range around it, whatever the number of words in it. A range whose row exceeds one edit
is skipped.

Words are counted whole: null text has none, null ids count as the text ``""`` in the
thinning hash. Rows that repeat count each. Ties go to the smallest word in code-point order.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eavista.llm.shared import partitions, stored

RUNS = "[A-Za-zÀ-ÿ]+"
# Words in a list at most; lists of words that differ in one or two characters are shorter.
LONGEST = 4096
# Rows that a task scans at a time, more only to end a list; words that run down at once.
CHUNK = 32_768
ABREAST = 4096

LEVEL = ["cls", "p", "s", "bound"]
ROWS = "list string, cls int, bound int, rest string, word string, n long"
FOUND = "word string, n_near long, best_n long, best string"


def thinned_words(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """``(word, n)``: runs of letters, A-Z lower-cased, one letter taken out where a hash says so."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUNS), F.lit(0))).alias("run"),
    )
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")))
    runs = runs.filter(F.length("run") >= shortest)
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least)


def _level(cls: Column, p: Column, s: Column, bound: Column) -> Column:
    return F.struct(*[x.cast("int").alias(name) for x, name in zip((cls, p, s, bound), LEVEL)])


def _halves(cls: Column, p: Column, s: Column, bound: Column) -> list[Column]:
    """The two finer levels: more of the beginning shared, or more of the end and less of the beginning than that."""
    rest = cls - p - s
    half = F.floor(rest / 2)
    return [
        _level(cls, p + half, s, bound),
        _level(cls, p, s + rest - half, F.when(bound < 0, p + half).otherwise(F.least(bound, p + half))),
    ]


def _listed(words: DataFrame, levels: list[Column]) -> DataFrame:
    """Each word in its list at each level; a bound below 0 is none."""
    rows = words.select("word", "n", F.explode(F.array(*levels)).alias("level")).select("word", "n", "level.*")
    rows = rows.filter("bound < 0 or p < bound")
    shared = F.concat(F.substr("word", F.lit(1), F.col("p")), F.right("word", F.col("s")))
    name = F.concat(F.concat_ws(",", *LEVEL), F.lit(":"), shared)
    rest = F.substr("word", F.col("p") + 1, F.length("word") - F.col("p") - F.col("s"))
    return rows.withColumns({"list": name, "rest": rest})


def _lists(words: DataFrame, longest: int) -> DataFrame:
    """Every word in lists of at most ``longest`` words."""
    none, start = F.lit(-1), F.lit(0)
    size = F.length("word")
    rows = _listed(words, [level for cls in (size, size - 1) for level in _halves(cls, start, start, none)])
    done = None
    while True:
        rows = stored(rows, "lists")
        sizes = rows.filter("cls - p - s > 1").groupBy("list").agg(F.count(F.lit(1)).alias("words"))
        long = stored(sizes.filter(F.col("words") > longest).select("list"), "long-lists")
        if long.isEmpty():
            return rows if done is None else done.unionByName(rows)
        short = rows.join(long, "list", "left_anti")
        done = short if done is None else done.unionByName(short)
        split = _halves(*[F.col(c) for c in LEVEL])
        rows = _listed(rows.join(long, "list", "left_semi").select("word", "n", *LEVEL), split)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows, and where each row starts; one more for the end."""
    texts = "".join(column.to_pylist())
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(texts.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _common(points: np.ndarray, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The length of the common beginning of stretches that start at ``x`` and ``y``."""
    out = np.zeros(len(x), np.int64)
    live, depth, most = np.arange(len(x)), 0, np.minimum(nx, ny)
    while len(live):
        live = live[most[live] > depth]
        live = live[points[x[live] + depth] == points[y[live] + depth]]
        depth += 1
        out[live] = depth
    return out


def pairs_one_edit_apart(rests: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, other row) for all pairs of a group whose rests are one edit apart, both ways.

    Rows are in order of group and rest; a group has no rest twice.
    """
    points, off = _code_points(rests)
    size, rows = np.diff(off), len(group)
    points = np.append(points, np.uint32(0))
    lcp = np.full(rows, -1)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[inner] = _common(points, off[inner - 1], size[inner - 1], off[inner], size[inner])
    edges = np.append(np.flatnonzero(lcp < 0), rows)
    found = [], []
    everyone = np.repeat(np.diff(edges) > 1, np.diff(edges))
    begin = np.repeat(edges[:-1], np.diff(edges))
    end = np.repeat(edges[1:], np.diff(edges))
    asked = np.flatnonzero(everyone)
    for at in range(0, len(asked), ABREAST):
        query = asked[at : at + ABREAST]
        _run_down(points, off, size, lcp, query, begin[query], end[query], found)
    return tuple(np.concatenate(side) if side else np.zeros(0, np.int64) for side in found)


def _run_down(points, off, size, lcp, query, lo, hi, found) -> None:
    """One edit-matrix row for each query and range: cells for query prefixes one shorter, alike and one longer."""
    far = np.int8(2)
    before = np.full(len(query), far)
    here = np.zeros(len(query), np.int8)
    after = np.where(size[query] > 0, np.int8(1), far)
    depth, limit = 0, int(lcp.max(initial=0))
    while len(query):
        # A word that ends here is the first of its range.
        ends = np.flatnonzero(size[lo] == depth)
        ahead = size[query[ends]] - depth
        cell = np.select([ahead == -1, ahead == 0, ahead == 1], [before[ends], here[ends], after[ends]], far)
        match = ends[cell == 1]
        found[0].append(query[match])
        found[1].append(lo[match])
        lo = lo.copy()
        lo[ends] += 1
        live = lo < hi
        query, lo, hi, before, here, after = (x[live] for x in (query, lo, hi, before, here, after))
        # The ranges within, by the next character.
        if depth <= limit:
            cuts = np.flatnonzero(lcp <= depth)
            first, last = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "left")
            count = last - first + 1
            of = np.repeat(np.arange(len(query)), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            bounds = np.append(cuts, len(lcp))
            begin = np.where(nth == 0, lo[of], bounds[np.maximum(first[of] + nth - 1, 0)])
            end = np.where(nth == count[of] - 1, hi[of], bounds[np.minimum(first[of] + nth, len(cuts))])
            query, lo, hi, before, here, after = query[of], begin, end, before[of], here[of], after[of]
        new = points[off[lo] + depth]
        length, start = size[query], off[query]

        def differs(j: int) -> np.ndarray:
            """Whether the query's j-th character is another; where it has none the cell is void anyway."""
            return points[start + np.minimum(max(j, 0), np.maximum(length - 1, 0))] != new

        shorter = np.minimum(before + differs(depth - 1), here + 1)
        alike = np.minimum(np.minimum(here + differs(depth), after + 1), shorter + 1)
        alike = np.where(length > depth, alike, far)
        longer = np.where(length > depth + 1, np.minimum(after + differs(depth + 1), alike + 1), far)
        shorter = np.where(length >= depth, shorter, far)
        before, here, after = (np.minimum(x, far).astype(np.int8) for x in (shorter, alike, longer))
        live = np.minimum(np.minimum(before, here), after) < far
        query, lo, hi, before, here, after = (x[live] for x in (query, lo, hi, before, here, after))
        depth += 1


def _scanned(rows: pa.Table) -> pa.RecordBatch | None:
    """Per row that has one: its number of near words in its list, and the best of them."""
    group = np.cumsum(np.concatenate([[True], pc.not_equal(rows["list"][1:], rows["list"][:-1]).to_numpy()]))
    many = np.bincount(group)[group] > 1
    if not many.any():
        return None
    rows, group = rows.filter(pa.array(many)).combine_chunks(), group[many]
    columns = {name: rows[name].chunk(0) if rows[name].num_chunks else rows[name] for name in rows.column_names}
    one, other = pairs_one_edit_apart(columns["rest"], group)
    points, off = _code_points(columns["word"])
    size = np.diff(off)
    cls, bound, n = (columns[c].to_numpy() for c in ("cls", "bound", "n"))
    # Longer words meet in the lists of their own length; pairs that share more belong to the sister list.
    keep = np.minimum(size[one], size[other]) == cls[one]
    one, other = one[keep], other[keep]
    checked = np.flatnonzero(bound[one] >= 0)
    a, b = one[checked], other[checked]
    shared = _common(points, off[a], size[a], off[b], size[b])
    keep = np.ones(len(one), bool)
    keep[checked] = shared < bound[a]
    one, other = one[keep], other[keep]
    if not len(one):
        return None
    words = columns["word"].to_pandas()
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words.to_numpy(object), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    return pa.record_batch({
        "word": columns["word"].take(pa.array(one[first])),
        "n_near": pa.array(np.diff(np.append(first, len(one))), pa.int64()),
        "best_n": pa.array(n[other[first]], pa.int64()),
        "best": columns["word"].take(pa.array(other[first])),
    })


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole lists at a time: the last of what is held may go on in the next batch."""
    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if len(held) < CHUNK:
            continue
        names = held["list"].combine_chunks()
        same = np.flatnonzero(pc.not_equal(names, names[-1]).to_numpy(zero_copy_only=False))
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut and (out := _scanned(held.slice(0, cut).combine_chunks())) is not None:
            yield out
        held = held.slice(cut)
    if held is not None and len(held) and (out := _scanned(held.combine_chunks())) is not None:
        yield out


def near_words(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``(word, n)`` that have a word one edit apart."""
    rows = _lists(words, longest).select("list", "cls", "bound", "rest", "word", "n")
    rows = rows.repartition(partitions(words.sparkSession), "list").sortWithinPartitions("list", "rest")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    parts = rows.mapInArrow(_scan, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return parts.select("word", "n_near", (-F.col("best.less")).alias("best_n"), "best.best")


def variants(words: DataFrame, times: int = 2, longest: int = LONGEST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``(word, n)``.

    ``form`` is the near word of largest n, if that is at least ``times`` the word's own. A
    form occurs more often than its word, so that forms end in a root: the way there is
    found by doubling it.
    """
    words = stored(words, "words")
    near = words.join(near_words(words, longest), "word", "left")
    formed = near.withColumn("taken", F.col("best_n") >= times * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("taken"), F.col("best")).alias("form"), F.when(F.col("taken"), F.col("best_n")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    ways = stored(formed.filter("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = ways.join(on, "root", "left")
        if moved.filter("beyond is not null").isEmpty():
            break
        ways = stored(moved.select("word", F.coalesce("beyond", "root").alias("root")), "ways")
    return formed.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
