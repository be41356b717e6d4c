"""Token-id files: flat unsigned integers with 64-bit document offsets, read through memory maps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm.common import documents, slices
from itembank.llm.tokenizer_files import ByteLevelEncoder, load
from itembank.session import materialize, scratch_path

NULL_ID = -(2**63)
MANIFEST = "part int, name string, n_docs long, n_tokens long"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _flat(root: str, name: str, kind: str) -> np.ndarray:
    """The integers of a file: a memory map where the folder is a local path, else one read."""
    store, folder = _open(root)
    path = f"{folder}/{name}"
    if store.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(docs: DataFrame, tokenizer_path: str, root: str, end_id: int) -> DataFrame:
    """Write the token files of a corpus below root and return their manifest.

    Texts are sorted once by a range partitioning on doc_id (nulls first, ties by text), and
    each task streams its range into three flat files: ids (2 or 4 bytes wide, as the
    vocabulary needs), 64-bit lengths and 64-bit document ids. Names hold the task attempt, so
    a repeated task never writes over another's file; the manifest names the files that count.
    It has a row per file, and bases are prefix sums over it. A null text counts as empty, and
    every document ends with end_id. An empty table has an empty manifest.
    """
    width = 2 if max(load(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(tokenizer_path, width)
        end = np.array([end_id], encoder.kind).tobytes()
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        store, folder = _open(root)
        store.create_dir(folder, recursive=True)
        n_docs = n_tokens = 0
        with (
            store.open_output_stream(f"{folder}/{name}.ids") as ids,
            store.open_output_stream(f"{folder}/{name}.len") as lengths,
            store.open_output_stream(f"{folder}/{name}.doc") as keys,
        ):
            for batch in slices(batches):
                rows = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
                sizes = np.array([len(x) // width for x in rows], "<i8")
                ids.write(b"".join(rows))
                lengths.write(sizes.tobytes())
                keys.write(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_tokens = n_docs + len(rows), n_tokens + int(sizes.sum())
        if n_docs:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([task.partitionId()], pa.int32()), "name": [name],
                "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()),
            })

    ordered = documents(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return materialize(_write_offsets(bases, root).withColumn("width", F.lit(width)), "token-offsets")


def _spread(manifest: DataFrame) -> DataFrame:
    """A file each task, or a few: rows are as many as files, so their number bounds the partitions."""
    return manifest.repartition(max(1, manifest.count()))


def _write_offsets(bases: DataFrame, root: str) -> DataFrame:
    """Beside each file of ids, one of global 64-bit starts with the closing total as last entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                ends = row["base"] + np.cumsum(_flat(root, f"{row['name']}.len", "<i8"))
                with store.open_output_stream(f"{folder}/{row['name']}.off") as out:
                    out.write(np.concatenate([[row["base"]], ends]).astype("<i8").tobytes())
            yield batch

    return bases.mapInArrow(run, f"{MANIFEST}, base long")


def read_tokens(manifest: DataFrame, root: str) -> DataFrame:
    """Per document what the files hold: doc_id, start, n_tokens and ids_crc32.

    The checksum is over the ids as little-endian unsigned 32-bit integers, whatever width the
    file has. Documents come file by file; a task maps one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _flat(root, f"{row['name']}.ids", f"<u{row['width']}")
                offsets = np.asarray(_flat(root, f"{row['name']}.off", "<i8"))
                keys = np.asarray(_flat(root, f"{row['name']}.doc", "<i8"))
                at = offsets - row["base"]
                for k in range(0, len(keys), 20_000):
                    stop = min(k + 20_000, len(keys))
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(k, stop)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(keys[k:stop], mask=keys[k:stop] == NULL_ID),
                        "start": pa.array(offsets[k:stop], pa.int64()),
                        "n_tokens": pa.array(np.diff(offsets[k : stop + 1]), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return _spread(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_tokens(manifest: DataFrame, root: str, tokenizer_path: str) -> DataFrame:
    """The texts back from the files, without the closing id; the way back for tests and readers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _flat(root, f"{row['name']}.ids", f"<u{row['width']}")
                at = np.asarray(_flat(root, f"{row['name']}.off", "<i8")) - row["base"]
                keys = np.asarray(_flat(root, f"{row['name']}.doc", "<i8"))
                for k, key in enumerate(keys):
                    text = tokenizer.decode(ids[at[k] : at[k + 1] - 1].tolist(), skip_special_tokens=False)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None if key == NULL_ID else int(key)], pa.int64()), "text": [text]})

    return _spread(manifest).mapInArrow(run, "doc_id long, text string")


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, root: str | None = None) -> DataFrame:
    """Write the files of a corpus and read each document's digest back from them."""
    root = root or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer_path, root, end_id), root)
