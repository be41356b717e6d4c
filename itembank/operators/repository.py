"""Bank tables: import, keyed writes, cascading deletes, favourites, manual questions, overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.constants import WARNINGS_KEPT
from itembank.functions.text import normalize_stem
from itembank.operators.ordering import first_rows, keep_last, ordinal


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def import_banks(old: DataFrame, parsed: DataFrame, warnings: DataFrame, now: Column) -> DataFrame:
    """Upsert banks by name.

    The first import time survives, a blank file name or type keeps the old one, counts are
    taken from the new parse, and at most the first twenty warnings are kept.
    """
    kept = (
        first_rows(warnings, ["name"], ["ord"], WARNINGS_KEPT, "_rank")
        .groupBy("name").agg(F.array_sort(F.collect_list(F.struct("_rank", "warning"))).alias("_w"))
        .select("name", F.array_join(F.transform("_w", lambda w: w["warning"]), "\n").alias("warnings"))
    )
    new = parsed.join(kept, "name", "left").alias("n")
    o = old.alias("o")
    j = o.join(new, F.col("o.name") == F.col("n.name"), "full_outer")
    is_new = F.col("n.name").isNotNull()
    pick = lambda c: F.when(is_new & ~_blank(f"n.{c}"), F.col(f"n.{c}")).otherwise(F.coalesce(F.col(f"o.{c}"), F.lit("")))
    return j.select(
        F.coalesce("n.name", "o.name").alias("name"),
        pick("file_name").alias("file_name"),
        pick("file_type").alias("file_type"),
        F.coalesce(F.col("o.imported_at"), now).alias("imported_at"),
        F.when(is_new, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(is_new, now).otherwise(F.col("o.last_used")).alias("last_used"),
        F.when(is_new, F.col("n.question_count")).otherwise(F.col("o.question_count")).alias("question_count"),
        F.when(is_new, F.col("n.total_units")).otherwise(F.col("o.total_units")).alias("total_units"),
        F.when(is_new, F.coalesce("n.warnings", F.lit(""))).otherwise(F.col("o.warnings")).alias("warnings"),
    )


def replace_questions(current: DataFrame, parsed: DataFrame, keep_manual: bool = False) -> DataFrame:
    """Replace the questions of every bank that was parsed anew; optionally keep manual ones."""
    banks = parsed.select("bank").distinct()
    rest = current.join(banks, "bank", "left_anti")
    if keep_manual:
        manual = current.filter(F.col("source") == "manual").join(banks, "bank", "left_semi")
        rest = rest.unionByName(manual.join(parsed.select("bank", "qid"), ["bank", "qid"], "left_anti"))
    return rest.unionByName(parsed)


def keyed_put(table: DataFrame, puts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins per key."""
    return keep_last(table.unionByName(puts), keys, order)


def for_bank(table: DataFrame, bank: str) -> DataFrame:
    return table.filter(F.col("bank") == bank)


def cascade_delete(tables: dict[str, DataFrame], banks: DataFrame) -> dict[str, DataFrame]:
    """Drop every row of the listed banks from every table."""
    return {name: t.join(banks.select("bank"), "bank", "left_anti") for name, t in tables.items()}


def replace_bank_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Overwrite all rows of the banks present in ``rows``."""
    return table.join(rows.select("bank").distinct(), "bank", "left_anti").unionByName(rows)


def write_bank_rows(rows: DataFrame, path: str) -> None:
    """Overwrite only the bank partitions present in ``rows``.

    Rows are spread by (bank, qid) before the write so that a large bank is written by many tasks.
    """
    (
        rows.repartition("bank", "qid").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bank").parquet(path)
    )


def touch(banks: DataFrame, uses: DataFrame) -> DataFrame:
    """Move ``last_used`` forward to the latest use of each bank."""
    latest = uses.groupBy(F.col("bank").alias("name")).agg(F.max("used_at").alias("_used"))
    return (
        banks.join(latest, "name", "left")
        .withColumn("last_used", F.greatest(F.col("last_used"), F.col("_used"))).drop("_used")
    )


def last_used(banks: DataFrame) -> DataFrame:
    return banks.agg(F.max_by("name", F.struct("last_used", "name")).alias("name"))


def toggle_state(clicks: DataFrame, keys: Sequence[str] = ("bank", "qid")) -> DataFrame:
    """Favourites after a click log: an odd number of clicks leaves the question marked."""
    return (
        clicks.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("answered_at").alias("added_at"))
        .filter(F.col("_n") % 2 == 1).drop("_n")
    )


def bank_overview(banks: DataFrame, questions: DataFrame, book: DataFrame, favorites: DataFrame) -> DataFrame:
    """Counts per bank; each table is reduced to one row per bank before the joins."""
    q = questions.groupBy("bank").agg(
        F.count("*").alias("question_count"), F.count_if(F.col("source") == "manual").alias("manual_count")
    )
    w = book.groupBy("bank").agg(F.count("*").alias("wrong_count"))
    f = favorites.groupBy("bank").agg(F.count("*").alias("favorite_count"))
    out = banks.withColumnRenamed("name", "bank")
    for t in (q, w, f):
        out = out.join(t, "bank", "left")
    zero = ["question_count", "manual_count", "wrong_count", "favorite_count"]
    return out.fillna(0, zero).select("bank", *zero, "last_used")


def flag_favorites(book: DataFrame, favorites: DataFrame) -> DataFrame:
    marks = favorites.select("bank", "qid").distinct().withColumn("_f", F.lit(True))
    return book.join(marks, ["bank", "qid"], "left").withColumn("is_favorite", F.coalesce("_f", F.lit(False))).drop("_f")


def upsert_manual(questions: DataFrame, manual: DataFrame) -> DataFrame:
    """Replace the first question of the bank with the same normalised stem, else append.

    Several manual rows with one stem act in order, so the last one stays.
    """
    cols = ["bank", "ord", "stem", "answer"]
    incoming = keep_last(
        manual.select(*cols).withColumn("key", normalize_stem(F.col("stem"))), ["bank", "key"], ["ord"]
    )
    keyed = questions.select(*cols).withColumn("key", normalize_stem(F.col("stem")))
    first = keyed.groupBy("bank", "key").agg(F.min("ord").alias("first_ord"))
    hit = incoming.join(first, ["bank", "key"], "left")
    replaced = hit.filter("first_ord is not null").select(
        "bank", F.col("first_ord").alias("ord"), "stem", "answer", F.lit("replaced").alias("action")
    )
    kept = keyed.join(replaced.select("bank", "ord"), ["bank", "ord"], "left_anti").select(
        *cols, F.lit("kept").alias("action")
    )
    ends = questions.groupBy("bank").agg(F.max("ord").alias("_end"))
    added = (
        ordinal(hit.filter("first_ord is null"), ["bank"], ["ord", "key"], "_n")
        .join(ends, "bank", "left")
        .select("bank", (F.coalesce("_end", F.lit(0)) + F.col("_n")).alias("ord"), "stem", "answer", F.lit("added").alias("action"))
    )
    return kept.unionByName(replaced).unionByName(added)


def manual_positions(questions: DataFrame) -> DataFrame:
    """Manual questions with their 0-based place among the manual questions of their bank."""
    manual = questions.filter(F.col("source") == "manual")
    return ordinal(manual, ["bank"], ["ord"], "_n").withColumn(
        "manual_index", F.col("_n") - 1
    ).drop("_n")


def delete_manual(questions: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete the n-th manual question of a bank; ``requests`` holds (bank, manual_index)."""
    doomed = manual_positions(questions).join(requests, ["bank", "manual_index"], "left_semi")
    return questions.join(doomed.select("bank", "qid"), ["bank", "qid"], "left_anti")


def fill_explanations(table: DataFrame, texts: DataFrame) -> DataFrame:
    """Write explanations by (bank, qid); blank texts change nothing."""
    t = texts.filter(F.trim("text") != "").select("bank", "qid", F.trim("text").alias("_text"))
    return (
        table.join(t, ["bank", "qid"], "left")
        .withColumn("explanation", F.coalesce("_text", "explanation")).drop("_text").select(*table.columns)
    )


def book_sets(book: DataFrame, favorites: DataFrame) -> DataFrame:
    """Keys in both books, only in the mistakes, only in the favourites."""
    w = book.select("bank", "qid", F.lit(True).alias("in_book")).distinct()
    f = favorites.select("bank", "qid", F.lit(True).alias("is_favorite")).distinct()
    side = F.when(F.col("in_book").isNull(), "favorite_only").when(F.col("is_favorite").isNull(), "wrong_only").otherwise("both")
    return w.join(f, ["bank", "qid"], "full_outer").select("bank", "qid", side.alias("side"))
