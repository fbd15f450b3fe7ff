"""Exact duplicates, found by an exchange of compressed fingerprints.

1. Each task sorts the 64-bit fingerprints of its texts and cuts them by owner, an
   equal share of the fingerprint range. An owner gets the distinct ones as Golomb
   code; ids and digests stay behind, in the same order.
2. The owner decodes the codes of all tasks and answers each with a bitmap: which of
   its fingerprints another task has too.
3. Only rows that a bitmap (or the task itself) marks are suspects. Their texts are
   grouped byte by byte, so that equal fingerprints of different texts part again. A
   text reaches that shuffle if a small table of the suspects' fingerprints has its
   place (see ``marked``); a text let through in vain is a group of one.

A text that a third of all rows share travels once per task in every step: the code
holds distinct fingerprints, and the grouping of texts is pre-aggregated.

Null texts count as empty. A null id is below every other; a group with no other id
keeps all its rows. Of rows that repeat an id and a text, all have ``kept`` true;
``deduplicated`` returns one of them. An empty table gives an empty result. Other
columns are ignored by ``duplicate_groups`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.marked import bitmap, without
from eavista.llm.shared import blobs, free_names, lean, partitions, stored

# Rows that a task sorts at a time; more become further sources with codes of their own.
SOURCE_ROWS = 1_000_000

PACKED = "source long, owner int, n long, code binary, repeated binary, hashes binary, ids binary, id_known binary, digests binary"


def golomb_parameter(n: int, span: int) -> int:
    """Bits of the remainder: the power of two nearest below 0.69 times the mean gap."""
    return max(0, int(np.log2(max(1.0, 0.69 * span / max(n, 1)))))


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Golomb code of rising numbers below ``span``: the gaps' quotients in unary, then their remainders."""
    width = golomb_parameter(len(values), span)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    places = np.arange(width - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(code: bytes, n: int, span: int) -> np.ndarray:
    width = golomb_parameter(n, span)
    data = np.frombuffer(code, np.uint8)
    tail = (n * width + 7) // 8
    ends = np.flatnonzero(np.unpackbits(data[: len(data) - tail]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(data[len(data) - tail :])[: n * width].reshape(n, width)
    gaps = quotients.astype(np.uint64) << np.uint64(width)
    for place in range(width):
        gaps += rest[:, place].astype(np.uint64) << np.uint64(width - 1 - place)
    return np.cumsum(gaps, dtype=np.uint64)


def _share(owners: int) -> int:
    """Fingerprints of one owner: its part of the range."""
    return -(-(1 << 64) // owners)


def _packed(owners: int):
    def pack(source: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows)
        hashes = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        ids = rows["doc_id"].fill_null(0).to_numpy()[order]
        known = rows["doc_id"].is_valid().to_numpy()[order].astype(np.uint8)
        digests = np.frombuffer(b"".join(rows["digest"].to_pylist()), "V32")[order]
        share = np.uint64(_share(owners))
        owner = (hashes // share).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = {name: [] for name in ("source", "owner", "n", "code", "repeated", "hashes", "ids", "id_known", "digests")}
        for a, b in zip(cuts, [*cuts[1:], len(hashes)]):
            values, counts = np.unique(hashes[a:b], return_counts=True)
            out["source"].append(source)
            out["owner"].append(int(owner[a]))
            out["n"].append(len(values))
            out["code"].append(golomb_encode(values - np.uint64(owner[a]) * share, int(share)))
            out["repeated"].append(np.packbits(counts > 1))
            out["hashes"].append(hashes[a:b])
            out["ids"].append(ids[a:b])
            out["id_known"].append(known[a:b])
            out["digests"].append(digests[a:b])
        kinds = {"source": pa.int64(), "owner": pa.int32(), "n": pa.int64()}
        return pa.record_batch({k: pa.array(v, kinds[k]) if k in kinds else blobs(v) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held, count = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= SOURCE_ROWS:
                yield pack(source, held)
                source, held, count = source + 1, [], 0
        if count:
            yield pack(source, held)

    return run


def _answers(owners: int):
    """One owner's bitmaps for all sources."""

    def run(group: pa.Table) -> pa.Table:
        span, counts = _share(owners), group["n"].to_pylist()
        values = np.concatenate([golomb_decode(c, n, span) for c, n in zip(group["code"].to_pylist(), counts)])
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.split(times[at] > 1, np.cumsum(counts)[:-1])
        return pa.table({
            "source": group["source"], "owner": group["owner"], "shared": blobs([np.packbits(x) for x in shared]),
        })

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of the packed sources, each with the mark that it is a suspect."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes = np.frombuffer(row["hashes"], np.uint64)
            marks = np.unpackbits(np.frombuffer(row["repeated"], np.uint8) | np.frombuffer(row["shared"], np.uint8))
            place = np.cumsum(np.diff(hashes, prepend=hashes[0]) != 0)
            known = np.frombuffer(row["id_known"], np.uint8) == 0
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(hashes), [None, pa.py_buffer(row["digests"])])
            yield pa.record_batch({
                "doc_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=known),
                "h": pa.array(hashes.view(np.int64)),
                "digest": digests.cast(pa.binary()),
                "suspect": pa.array(marks[place] == 1),
            })


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id stays."""
    owners = partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    prints = texts.select(
        "doc_id", F.xxhash64("text").alias("h"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")
    )
    packed = stored(prints.mapInArrow(lean(_packed(owners)), PACKED), "fingerprints")
    answers = (
        packed.select("source", "owner", "n", "code")
        .groupBy("owner").applyInArrow(_answers(owners), "source long, owner int, shared binary")
    )
    rows = packed.drop("n", "code").join(answers, ["source", "owner"])
    rows = stored(rows.mapInArrow(lean(_rows), "doc_id long, h long, digest binary, suspect boolean"), "marked")

    maybe = bitmap(rows.filter("suspect"), "h")
    same = texts.filter(maybe(F.xxhash64("text")))
    groups = same.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(
        groups.select(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), "keep_id", "group_size"), "groups"
    )
    found = rows.join(groups, "digest", "left")
    return found.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    groups = stored(duplicate_groups(docs), "decisions")
    rows = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("kept").alias("kept"))
    if rows.filter("rows > 1").isEmpty():
        return without(docs, "doc_id", rows.filter("not kept").select(F.col("doc_id").alias("key")))
    # An id repeats: its rows stay by their texts, and equal rows become one.
    digest, stays, of = free_names(docs, "_sha256", "_stay", "_text")
    stay = groups.filter("kept").select(F.col("doc_id").alias(stays), F.col("text_sha256").alias(of))
    docs = docs.withColumn(digest, F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(stays)) & (F.col(digest) == F.col(of))
    return docs.join(stay, same, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
