"""Document fingerprints from locally consistent parsing.

Each level cuts a sequence of symbols into phrases at places that depend only on a few
neighbours, and a phrase becomes a symbol of the next level. Runs of one symbol are folded
first; deterministic coin tossing then gives each symbol a label below eight (the lowest bit
in which it differs from its left neighbour, and that bit, taken three times), and phrases
start where the label is a local maximum. Equal substrings so have the same interior phrases
at any offset. The fingerprint is the bottom-k sketch of a text's phrase names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm.common import documents, slices

SKETCH = 64
FIRST_LEVEL = 2
SLICES = 4096
BATCH_CHARS = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: odd multipliers by place in a phrase
_WEIGHTS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _changes(doc: np.ndarray) -> np.ndarray:
    first = np.ones(len(doc), bool)
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    return first


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest differing bit with the left neighbour) + that bit; 0 where a text begins."""
    one = label.dtype.type(1)
    differ = label[1:] ^ label[:-1]
    lowest = differ & (~differ + one)
    bit = np.bitwise_count(lowest - one)
    out = np.zeros(len(label), np.uint8)
    out[1:] = 2 * bit + ((label[1:] & lowest) != 0)
    out[first] = 0
    return out


def _level(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of every text's sequence, and the texts they are in."""
    same = np.zeros(len(sym), bool)
    same[1:] = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
    if same.any():
        starts = np.flatnonzero(~same)
        runs = np.diff(np.append(starts, len(sym))).astype(np.uint64)
        sym, doc = sym[starts], doc[starts]
        folded = runs > 1
        sym[folded] = _mix(sym[folded] + runs[folded] * np.uint64(0x9E3779B97F4A7C15))
    first = _changes(doc)
    label = _toss(_toss(_toss(sym, first), first), first)
    cut = first.copy()
    # never right after the first symbol, so that every phrase but a last one has two symbols or more
    cut[1:] |= (label[1:] > label[:-1]) & (label[1:] >= np.append(label[2:], np.uint8(0))) & ~first[:-1]
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(sym)))
    offset = np.arange(len(sym)) - np.repeat(starts, sizes)
    names = np.add.reduceat(sym * _WEIGHTS[offset & 63], starts)
    return _mix(names + sizes.astype(np.uint64)), doc[starts]


def sketches(texts: list[str], size: int = SKETCH) -> list[np.ndarray]:
    """The smallest `size` distinct 32-bit phrase names of each text; none for an empty text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(joined):
        return [np.empty(0, np.uint32) for _ in texts]
    sym = _mix(joined.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    keys, level = [], 0
    while len(sym):
        sym, doc = _level(sym, doc)
        level += 1
        if level >= FIRST_LEVEL:
            keys.append((doc.astype(np.uint64) << np.uint64(32)) | (sym >> np.uint64(32)))
            more = np.bincount(doc, minlength=len(texts))[doc] > 1  # a text of one phrase is done
            sym, doc = sym[more], doc[more]
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    owner = (keys >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    names = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [names[a : min(b, a + size)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common phrases: common names among the smallest of both; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = np.append(both[1:] == both[:-1], False)
    kept = np.append(True, both[1:] != both[:-1])
    smallest = min(size, int(kept.sum()))
    return float(twice[kept][:smallest].sum() / smallest)


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _by_size(texts: list[str]) -> list[np.ndarray]:
    """Sketches of a batch in groups of about BATCH_CHARS, so that the working arrays stay bounded."""
    out, group, chars = [], [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= BATCH_CHARS:
            out += sketches(group)
            group, chars = [], 0
    return out + (sketches(group) if group else [])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "fingerprint": [shown(s) for s in _by_size(texts)],
            })

    return documents(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _slices(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents() in n slices by descending doc_id, the last with the nulls.

    A slice ends with a copy of the row that follows it (`extra`), that of the next slice
    that has rows or, after the last, of the first. So every row meets its successor, and no
    slice grows with the table but in its own rows.
    """
    cuts = sorted({-c for c in docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)})

    @F.pandas_udf("int")
    def slice_of(ids):
        # nulls, the last of the order, are NaN and so beyond all cuts
        return pd.Series(np.searchsorted(np.array(cuts), -ids.to_numpy(np.float64), "left").astype(np.int32))

    rows = docs.withColumn("slice", slice_of(F.col("doc_id").cast("double")))
    order = W.orderBy("slice")
    tops = rows.groupBy("slice").agg(F.max("doc_id").alias("doc_id"))  # at most n + 1 rows
    into = F.coalesce(F.lag("slice").over(order), F.max("slice").over(W.partitionBy()))
    heads = tops.select(F.col("slice").alias("from"), F.col("doc_id").alias("top"), into.alias("slice"))
    extra = (
        rows.join(F.broadcast(heads.withColumnRenamed("slice", "into")), (F.col("slice") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("into").agg(F.min("text").alias("text"), F.max("doc_id").alias("doc_id"))
        .select("doc_id", "text", F.col("into").alias("slice"), F.lit(True).alias("extra"))
    )
    return rows.withColumn("extra", F.lit(False)).unionByName(extra)


def edited(text: str, following: str) -> str:
    """The text with its second half (rounded down) replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text.

    The next document is the one with the next smaller doc_id, after the last the first; rows
    with equal ids follow each other by text, null ids come last. A table of one row is its
    own next. Null texts count as empty, whose fingerprint is the empty string.

    Texts are shuffled once, by slices of doc_id that a task reads in order; the row after a
    slice travels with it.
    """
    spark = docs.sparkSession
    n = min(SLICES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far, without its successor
        for batch in slices(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("slice", "extra", "doc_id", "text")), strict=True))
            own = _by_size([r[3] for r in rows])
            rows = ([held] if held else []) + [(*r, s) for r, s in zip(rows, own, strict=True)]
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0] and not a[1]]
            if not pairs:
                continue
            texts = [edited(a[3], b[3]) for a, b in pairs]
            changed = _by_size(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                "fingerprint": [shown(a[4]) for a, _ in pairs],
                "edited_fingerprint": [shown(s) for s in changed],
                "near_edited": [likeness(a[4], s) for (a, _), s in zip(pairs, changed, strict=True)],
                "near_next": [likeness(a[4], b[4]) for a, b in pairs],
            })

    dealt = _slices(documents(docs), n).repartition("slice")
    return dealt.sortWithinPartitions("slice", "extra", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(run, schema)
