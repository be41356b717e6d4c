"""Positioned page items to text lines in reading order, including two-column pages.

Items are (doc_id, page, item_no, x, y, w, h, str). A page is the natural bounded group: its items are
gathered in one row by one shuffle, and everything else works within that row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from itembank.functions.text import compact, ltrim_ws, trim_ws
from itembank.operators.pages import MIN_ITEMS, ROW_TOLERANCE, Block, page_reader, row_numbers
from itembank.operators.segment import staged

# --- fixed values: thresholds ---------------------------------------------------------------------
MIN_TEXT = 50
PAGE = ["doc_id", "page"]
ITEM = ["item_no", "x", "y", "w", "h", "str"]


def text_items(items: DataFrame) -> DataFrame:
    return items.filter(ltrim_ws(F.col("str")) != "").filter("abs(x) < double('infinity') AND abs(y) < double('infinity')")


def pages_of(items: DataFrame) -> DataFrame:
    """One row per page with its text items in their given order: the only shuffle of this module."""
    return text_items(items).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("its"))


def _rows_of(ys: list[float], tolerance: float, moving: bool) -> list[int]:
    """The row of each item of a page, numbered from the top."""
    return row_numbers(np.asarray(ys, dtype=float), np.array([0, len(ys)]), tolerance, moving).tolist()


def row_ids(ys: Column, columns: Column, tolerance: float = ROW_TOLERANCE, moving: bool = True) -> Column:
    """Rows of the items of a page, each text column by itself; both arguments are arrays in item order."""

    @F.pandas_udf("array<int>")
    def ids(pages: pd.Series, sides: pd.Series) -> pd.Series:
        sizes = [len(page) for page in pages]
        if not sum(sizes):
            return pd.Series([np.zeros(0, dtype="int32")] * len(sizes), dtype=object)
        y, side, page = np.concatenate(list(pages)), np.concatenate(list(sides)), np.repeat(np.arange(len(sizes)), sizes)
        o = np.lexsort((side, page))
        new = np.append(True, (page[o][1:] != page[o][:-1]) | (side[o][1:] != side[o][:-1]))
        rows = np.empty(len(o), dtype="int32")
        rows[o] = row_numbers(y[o], np.append(np.flatnonzero(new), len(o)), tolerance, moving)
        return pd.Series(np.split(rows, np.cumsum(sizes)[:-1]), dtype=object)

    return ids(ys, columns)


def _single(pages: DataFrame) -> DataFrame:
    return pages.withColumn("cols", F.expr("transform(its, s -> 0)"))


def cluster_rows(items: DataFrame) -> DataFrame:
    """Items with their row on the page, numbered from the top."""
    pages = _single(pages_of(items)).withColumn("rows", row_ids(F.col("its.y"), F.col("cols")))
    return pages.select(*PAGE, F.expr("inline(arrays_zip(its, rows))")).select(*PAGE, "its.*", F.col("rows").alias("row"))


def _read(items: DataFrame, split: bool) -> DataFrame:
    """The lines of every page in reading order: (doc_id, page, line, row, col, text), one pass over the pages."""
    pages = text_items(items).groupBy(*PAGE).agg(F.collect_list(F.struct(*ITEM)).alias("its"))
    whole = [StructField(c, IntegerType()) for c in ("line", "row", "col")]
    kind = StructType([items.schema[c] for c in PAGE] + whole + [StructField("text", StringType())])
    return pages.mapInArrow(page_reader(to_arrow_schema(kind), split), kind)


def page_lines(items: DataFrame) -> DataFrame:
    """Lines of every page from the top, without a search for text columns."""
    return _read(items, split=False).select(*PAGE, "row", "text")


def page_source(items: DataFrame) -> DataFrame:
    """Located lines of every page, as the other sources give them: trimmed and numbered; no line is blank, as no item is."""
    return _located(_read(items, split=False)).drop("col")


def _located(lines: DataFrame) -> DataFrame:
    return lines.select(*PAGE, "line", F.lit(0).alias("para"), trim_ws(F.col("text")).alias("text"), "col")


def framed(items: DataFrame) -> DataFrame:
    """Pages with their spans and extent; pages too small to have text columns have no width."""
    pages = pages_of(items).withColumn(
        "spans", F.expr("transform(its, s -> named_struct('x', s.x, 'right', s.x + if(s.w > 0, s.w, 0D)))")
    )
    pages = staged(pages, n=F.expr("size(its)"), min_x=F.expr("array_min(spans.x)"), extent=F.expr("array_max(spans.right) - array_min(spans.x)"))
    return pages.withColumn("width", F.expr(f"if(n >= {MIN_ITEMS} AND extent > 0, extent, null)")).drop("extent")


def _split(rule) -> Column:
    """A rule of ``Block`` over the items of pages, one page to a row."""

    @F.arrow_udf("double")
    def splits(numbers: pa.Array, xs: pa.Array, ys: pa.Array, ws: pa.Array) -> pa.Array:
        starts = np.append(0, np.cumsum(xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype("int64")
        found = rule(Block(starts, numbers.flatten(), xs.flatten(), ys.flatten(), ws.flatten()))
        return pa.array(found, mask=np.isnan(found))

    return splits(*[F.col(f"its.{c}") for c in ("item_no", "x", "y", "w")])


def two_means(pages: DataFrame, name: str = "split_x") -> DataFrame:
    """Add a column split by two means of the item centres, at most twelve rounds, with its guards, or null."""
    return pages.withColumn(name, _split(Block.two_means))


def blank_band(pages: DataFrame, name: str = "split_x") -> DataFrame:
    """Add a column split at the widest empty band of the middle of the page, of a hundred bins, or null."""
    return pages.withColumn(name, _split(Block.blank_band))


def gap_vote(pages: DataFrame, name: str = "split_x") -> DataFrame:
    """Add a column split where the widest gaps of most rows agree, of twenty bins, or null.

    A row keeps the baseline of its first item here.
    """
    return pages.withColumn(name, _split(Block.gap_vote))


def column_splits(pages: DataFrame) -> DataFrame:
    """Add the split of each two-column page: two means, else the blank band, else the vote.

    A split counts only with ten items on each side.
    """
    return pages.withColumn("split_x", _split(Block.splits)).drop("spans")


def reading_order(items: DataFrame) -> DataFrame:
    """Lines of every page in reading order: left column before right, numbered through the page."""
    return _located(_read(items, split=True))


def text_layer(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document: pages, pages without text, two-column pages, characters, and whether text is usable."""
    per_page = lines.groupBy(*PAGE).agg(
        F.sum(F.length(compact(F.col("text")))).alias("chars"), (F.max("col") + 1).alias("columns")
    )
    return pages.select(*PAGE).distinct().join(per_page, PAGE, "left").groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("chars").isNull()).alias("empty_pages"),
        F.count_if(F.col("columns") > 1).alias("column_pages"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
    ).withColumn("usable", F.col("chars") >= MIN_TEXT)
