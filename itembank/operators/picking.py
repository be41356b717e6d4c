"""Orderings and question picking.

Every mode yields the chosen questions of each bank with their position. With a limit the rows are
trimmed per task before any shuffle; without one the positions come from ranges of the order,
so that a very large bank is not sorted by a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions.review import is_due
from itembank.operators.ordering import first_rows, ordinal


def shuffle_key(seed: int | str, *cols: str) -> Column:
    """A reproducible pseudo-random sort key that does not depend on the partitioning."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _overdue(today: Column) -> Column:
    """Days until review, most overdue first; a missing date is the most overdue of all."""
    return F.coalesce(F.datediff(F.col("next_review"), today), F.lit(-2147483648))


def _due_order(today: Column) -> list[Column]:
    return [F.asc("stage"), _overdue(today).asc(), F.desc("wrong_count"), F.asc("qid")]


def _retry_order() -> list[Column]:
    return [F.desc("wrong_count"), F.asc("stage"), F.asc("added_at"), F.asc("qid")]


def _random_order(seed: int | str) -> list[Column]:
    return [shuffle_key(seed, "bank", "qid").asc(), F.asc("qid")]


def due_rank(book: DataFrame, today: Column) -> DataFrame:
    return ordinal(book, ["bank"], _due_order(today))


def retry_rank(book: DataFrame) -> DataFrame:
    return ordinal(book, ["bank"], _retry_order())


def due_records(book: DataFrame, today: Column) -> DataFrame:
    return book.filter(is_due(F.col("next_review"), today))


def shuffled(questions: DataFrame, seed: int | str) -> DataFrame:
    return ordinal(questions, ["bank"], _random_order(seed))


def pick_questions(
    questions: DataFrame,
    mode: str,
    *,
    wrong: DataFrame | None = None,
    favorites: DataFrame | None = None,
    today: Column | None = None,
    qtype: str = "",
    seed: int | str = 1,
    limit: int = 0,
) -> DataFrame:
    """Questions of each bank for a practice mode, with their 1-based position.

    ``wrong`` and ``favorites`` are keyed by (bank, qid); only question columns come out.
    """
    columns = questions.columns
    if mode in ("typeOrder", "typeRandom", "typeYear") and qtype:
        questions = questions.filter(F.col("qtype") == qtype)
    if mode in ("wrong", "due"):
        records = due_records(wrong, today) if mode == "due" else wrong
        # records stay when their question is gone after a re-import
        rows = records.select("bank", "qid", "stage", "next_review", "wrong_count", "added_at").join(questions, ["bank", "qid"], "left")
        order = _due_order(today) if mode == "due" else _retry_order()
    elif mode == "favorite":
        # a favourite stays in its place when its question is gone
        rows = favorites.select("bank", "qid").distinct().join(questions, ["bank", "qid"], "left")
        order = [F.asc("qid")]
    elif mode in ("random", "typeRandom"):
        rows, order = questions, _random_order(seed)
    elif mode == "typeYear":
        rows, order = questions, [F.asc_nulls_last("year"), F.asc("ord")]
    elif mode in ("order", "typeOrder"):
        rows, order = questions, [F.asc("ord")]
    else:
        raise ValueError(f"unknown practice mode {mode!r}")
    if limit > 0:
        picked = first_rows(rows, ["bank"], order, limit, "position")
    else:
        picked = ordinal(rows, ["bank"], order, "position")
    return picked.select(*columns, "position")
