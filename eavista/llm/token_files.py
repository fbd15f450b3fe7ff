"""Token files: flat unsigned ids with 64-bit document offsets, read back by mapping them.

A file set is a folder with, per shard, in ascending order of ``doc_id`` (null first):

* ``tokens-NNNNN.bin``: ids, little-endian, two bytes each if the vocabulary fits, else four;
* ``starts-NNNNN.bin``: 64-bit places of the shard's documents among all ids of the set, and its end;
* ``ids-NNNNN.bin``: 64-bit document ids, the least 64-bit number for null.

Shards are ranges of ids, so they are written side by side. A shard's place in the
set is the sum of the sizes before it, known once all are written; a second pass over
the shards (not the texts) writes the offsets. A file appears under its name only when
complete, and a repeated task writes the same bytes, so lost executors do no harm.

Null text counts as empty and holds the end id only. Repeated ids are ordered by a
hash of the text; equal rows are written each. An empty table makes no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eavista.llm.shared import new_folder, partitions, stored, utf8
from eavista.llm.tokens import worker_encoder

NO_ID = -(2**63)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _File:
    """A file of the set that gets its name when it is complete."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, base = _open(folder)
        self.files.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.draft = f"{self.path}.{TaskContext.get().taskAttemptId()}"
        self.stream = self.files.open_output_stream(self.draft)

    def write(self, values: np.ndarray) -> None:
        self.stream.write(np.ascontiguousarray(values).data)

    def close(self) -> None:
        self.stream.close()
        self.files.move(self.draft, self.path)


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file's numbers: mapped into memory where the store is a file system, else read."""
    files, base = _open(folder)
    path = f"{base}/{name}"
    if files.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    return np.frombuffer(files.open_input_file(path).read_buffer(), kind)


def _write_tokens(folder: str, vocabulary: str, words: bool, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder = TaskContext.get().partitionId(), worker_encoder(vocabulary, words, end)
        out, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                out = [_File(folder, f"{name}-{shard:05d}.bin") for name in ("tokens", "sizes", "ids")]
            for _, _, ids, at in encoder.encode(*utf8(batch["text"])):
                out[0].write(ids.astype(kind))
                out[1].write(np.diff(at).astype("<i8"))
                n_tokens += len(ids)
            out[2].write(batch["doc_id"].fill_null(NO_ID).to_numpy().astype("<i8"))
            n_docs += len(batch)
        if out:
            for file in out:
                file.close()
            yield pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()),
                "n_tokens": pa.array([n_tokens], pa.int64()),
            })

    return run


def _write_starts(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["base"].to_pylist()):
                sizes = mapped(folder, f"sizes-{shard:05d}.bin", "<i8")
                out = _File(folder, f"starts-{shard:05d}.bin")
                out.write((base + np.concatenate([[0], np.cumsum(sizes)])).astype("<i8"))
                out.close()
            yield batch

    return run


def write_files(
    docs: DataFrame, folder: str, vocabulary: str, end: int = 2, words: bool = False, kind: str = "<u2"
) -> DataFrame:
    """Writes the file set; returns a row per shard: ``shard, base, n_docs, n_tokens``."""
    spark = docs.sparkSession
    shards = partitions(spark)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ranged = texts.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    write = _write_tokens(folder, vocabulary, words, end, kind)
    sizes = stored(ranged.select("doc_id", "text").mapInArrow(write, "shard int, n_docs long, n_tokens long"), "shards")
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based = based.select("shard", "base", "n_docs", "n_tokens").repartition(shards, "shard")
    return stored(based.mapInArrow(_write_starts(folder), based.schema), "bases")


def _read(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["shard"].to_pylist():
                ids = mapped(folder, f"ids-{shard:05d}.bin", "<i8")
                starts = mapped(folder, f"starts-{shard:05d}.bin", "<i8")
                tokens = mapped(folder, f"tokens-{shard:05d}.bin", kind)
                inner = starts - starts[0]
                for a in range(0, len(ids), 4096):
                    b = min(a + 4096, len(ids))
                    crcs = [zlib.crc32(tokens[inner[i] : inner[i + 1]].astype("<u4").data) for i in range(a, b)]
                    yield pa.record_batch({
                        "doc_id": pa.array(ids[a:b], mask=ids[a:b] == NO_ID), "start": pa.array(starts[a:b]),
                        "n_tokens": pa.array(np.diff(starts[a : b + 1])), "ids_crc32": pa.array(crcs, pa.int64()),
                    })

    return run


def read_files(spark: SparkSession, folder: str, shards: DataFrame, kind: str = "<u2") -> DataFrame:
    """A row per document of the file set: ``doc_id, start, n_tokens, ids_crc32``."""
    rows = shards.select("shard").repartition(partitions(spark), "shard")
    return rows.mapInArrow(_read(folder, kind), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the documents as token files in the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_files(docs.sparkSession, folder, write_files(docs, folder, vocabulary))
