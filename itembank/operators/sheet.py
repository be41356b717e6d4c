"""Practice sheets: the questions of a bank as ordered HTML fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions.questions import item_html
from itembank.functions.review import type_rank
from itembank.functions.text import html_escape
from itembank.operators.ordering import ordinal


def practice_sheet(items: DataFrame, review: Column | None = None) -> DataFrame:
    """The sheet of each bank as ordered HTML fragments: title, counts per type, one row per question.

    A bank is never gathered into one cell; ``write_sheet`` writes the fragments sorted.
    """
    numbered = ordinal(items, ["bank"], ["ord"], "n")
    title = items.groupBy("bank").agg(F.count("*").alias("n")).select(
        "bank", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(
            F.lit('<h1 class="sheet-title">'), html_escape(F.col("bank")), F.lit('</h1><p class="sheet-meta">总题数：'),
            F.col("n").cast("string"), F.lit(" 题</p>"),
        ).alias("html"),
    )
    counts = items.groupBy("bank", "qtype").agg(F.count("*").alias("n")).select(
        "bank", F.lit(1).alias("section"), type_rank(F.col("qtype")).cast("bigint").alias("ord"),
        F.concat(F.lit("<li>"), "qtype", F.lit("题 "), F.col("n").cast("string"), F.lit(" 题</li>")).alias("html"),
    )
    rows = numbered.select(
        "bank", F.lit(2).alias("section"), F.col("n").alias("ord"),
        item_html(F.col("n"), F.col("qtype"), F.col("stem"), F.col("options"), F.col("answer"), F.col("explanation"), review).alias("html"),
    )
    return title.unionByName(counts).unionByName(rows)


def write_sheet(sheet: DataFrame, path: str) -> None:
    """Write fragments as text, range-partitioned so that files read in order give each sheet."""
    (
        sheet.repartitionByRange("bank", "section", "ord").sortWithinPartitions("bank", "section", "ord")
        .select("bank", F.col("html").alias("value")).write.mode("overwrite").partitionBy("bank").text(path)
    )
