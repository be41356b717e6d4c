"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def exact(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever other columns are called, in other letter case too."""
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def documents(docs: DataFrame) -> DataFrame:
    """The two columns the operators read; whatever else the table has stays behind."""
    return exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


#: A key is hot with this share of all rows or more, so there are at most as many hot keys.
HOT_KEYS = 512


def join_back(rows: DataFrame, table: DataFrame, keys: list[str], count: str, n: int) -> DataFrame:
    """rows with the columns of table (one row a key, `count` of them in rows, n rows in all); left join.

    The hot keys' rows of table, HOT_KEYS at most, are broadcast, so that rows of a hot key stay
    where they are; all other keys have less than n / HOT_KEYS rows and are joined by shuffle.
    """
    hot = F.col(count) * HOT_KEYS >= max(n, 1)
    columns = [c for c in table.columns if c not in keys and c != count]
    known = F.broadcast(table.where(hot).select(*keys, *columns, F.lit(True).alias("hot_key")))
    first = rows.join(known, keys, "left")
    done = first.where("hot_key").select(*rows.columns, *columns)
    rest = first.where("hot_key is null").select(*rows.columns)
    return done.unionByName(rest.join(table.where(~hot).select(*keys, *columns), keys, "left").select(*rows.columns, *columns))


def worker_memo(name: str) -> dict:
    """A dictionary that outlives a task in its Python worker.

    Functions travel to workers by value, so their module globals are new in each task. The
    memo hangs on a module of its own; it holds what can be rebuilt at any time.
    """
    holder = sys.modules.setdefault("_itembank_worker_memo", types.ModuleType("_itembank_worker_memo"))
    return holder.__dict__.setdefault(name, {})


#: Texts of a slice come to this many bytes at most, and what its last text has beyond.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, bounded in rows and bytes, so that the Python copies of texts stay few."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        begin = (np.cumsum(lengths) - lengths) // size
        bounds = [*np.flatnonzero(np.append(True, begin[1:] != begin[:-1])[: batch.num_rows]).tolist(), batch.num_rows]
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            for start in range(first, last, rows):
                yield batch.slice(start, min(rows, last - start))
