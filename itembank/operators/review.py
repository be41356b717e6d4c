"""Spaced-repetition state of every (bank, question) computed from its answer history.

A wrong answer opens or resets a record; each right answer moves it one stage on; the seventh
right answer in a row graduates it out of the book, and the next wrong answer starts afresh.

The fold is written as set operations. Within a chunk of a key's history (a month by default)
running sums locate the last wrong answer and the last graduation; a chunk is then summed up in
one row, and chunk rows are stitched per key. A key holding a large share of all answers is thus
spread over its chunks, and no task ever sees its whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.operators.ordering import join_null_safe

from itembank.constants import GRADUATE_STREAK, INTERVALS
from itembank.functions.review import next_review

KEYS = ("bank", "qid")
ORDER = ("answered_at", "seq")


def _month() -> Column:
    return F.date_trunc("month", F.col("answered_at"))


def _with_runs(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Per row, inside its chunk: wrong answers so far, right answers since the last wrong."""
    rows = attempts.withColumn("chunk", chunk)
    w = (
        Window.partitionBy(*keys, "chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    right = F.when(F.col("correct"), 1).otherwise(0).cast("bigint")
    return (
        rows.withColumn("isl", F.sum(1 - right).over(w))
        .withColumn("run", F.sum(right).over(w))
        .withColumn("run", F.col("run") - F.coalesce(F.max(F.when(~F.col("correct"), F.col("run"))).over(w), F.lit(0)))
    )


def _chunk_rows(runs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per (key, chunk) with everything later chunks need to know."""
    w = (
        Window.partitionBy(*keys, "chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    grad = F.col("correct") & (F.col("isl") > 0) & (F.col("run") == GRADUATE_STREAK)
    at = F.struct(*order)
    return (
        runs.withColumn("wrongs", F.col("isl") - F.coalesce(F.max(F.when(grad, F.col("isl"))).over(w), F.lit(0)))
        .groupBy(*keys, "chunk")
        .agg(
            F.count("*").alias("n"),
            F.max("isl").alias("n_wrong"),
            F.sum(F.when(F.col("isl") == 0, 1).otherwise(0)).alias("lead"),
            F.max_by("run", at).alias("tail"),
            F.max(grad).alias("has_grad"),
            F.max_by("wrongs", at).alias("live_wrongs"),
            F.max(F.when(~F.col("correct") & (F.col("wrongs") == 1), F.col("answered_at"))).alias("opened_at"),
            F.max(F.when(~F.col("correct"), F.col("answered_at"))).alias("last_wrong_at"),
            F.max("answered_at").alias("last_answer_at"),
        )
    )


def _stitch(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Carry the streak across the chunks of a key and mark chunks that start a new record."""
    w = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = Window.partitionBy(*keys).orderBy("chunk")
    adds = F.when(F.col("n_wrong") > 0, F.col("tail")).otherwise(F.col("n"))
    return (
        chunks.withColumn("_total", F.sum(adds).over(w))
        .withColumn("_base", F.max(F.when(F.col("n_wrong") > 0, F.col("_total") - F.col("tail"))).over(w))
        .withColumn("streak", F.col("_total") - F.coalesce("_base", F.lit(0)))
        .withColumn("wrong_before", F.sum("n_wrong").over(w) - F.col("n_wrong"))
        .withColumn("streak_in", F.coalesce(F.lag("streak").over(prev), F.lit(0)))
        .withColumn(
            "fresh",
            F.col("has_grad")
            | (
                (F.col("n_wrong") > 0)
                & ~((F.col("wrong_before") > 0) & (F.col("streak_in") + F.col("lead") < GRADUATE_STREAK))
            ),
        )
        .drop("_total", "_base")
    )


def wrong_book(
    attempts: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    chunk: Column | None = None,
) -> DataFrame:
    """The mistake book: the live record of every key that has one."""
    runs = _with_runs(attempts, keys, order, _month() if chunk is None else chunk)
    chunks = _stitch(_chunk_rows(runs, keys, order), keys)
    w = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = chunks.withColumn("_sum", F.sum("live_wrongs").over(w)).withColumn(
        "_wrong_count",
        F.col("_sum") - F.coalesce(F.max(F.when(F.col("fresh"), F.col("_sum") - F.col("live_wrongs"))).over(w), F.lit(0)),
    )
    stage = F.least(F.col("correct_streak"), F.lit(len(INTERVALS) - 1)).cast("bigint")
    return (
        live.groupBy(*keys)
        .agg(
            F.max_by("_wrong_count", "chunk").alias("wrong_count"),
            F.max_by("streak", "chunk").alias("correct_streak"),
            F.sum("n_wrong").alias("_n_wrong"),
            F.max(F.when(F.col("fresh"), F.col("opened_at"))).alias("added_at"),
            F.max("last_wrong_at").alias("last_wrong_at"),
            F.max("last_answer_at").alias("last_answer_at"),
        )
        .filter((F.col("_n_wrong") > 0) & (F.col("correct_streak") < GRADUATE_STREAK))
        .withColumn("stage", stage)
        .withColumn("next_review", next_review(F.col("last_answer_at"), F.col("stage")))
        .select(
            *keys, "wrong_count", "correct_streak", "stage", "next_review",
            "added_at", "last_wrong_at", "last_answer_at",
        )
    )


def attempt_status(
    attempts: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    chunk: Column | None = None,
) -> DataFrame:
    """Every answer with its running streak and its effect on the book.

    Effects: ``added``, ``updated``, ``graduated`` or ``none``.
    """
    runs = _with_runs(attempts, keys, order, _month() if chunk is None else chunk)
    carry = _stitch(_chunk_rows(runs, keys, order), keys).select(*keys, "chunk", "wrong_before", "streak_in")
    w = Window.partitionBy(*keys, "chunk").orderBy(*order)
    joined = join_null_safe(runs, carry, [*keys, "chunk"])
    streak = F.col("run") + F.when(F.col("isl") == 0, F.col("streak_in")).otherwise(0)
    seen = F.col("wrong_before") + F.col("isl") > 0
    out = joined.withColumn("streak", streak).withColumn("_prev", F.lag("streak").over(w))
    before = F.coalesce(F.col("_prev"), F.col("streak_in"))
    wrong_earlier = F.col("wrong_before") + F.col("isl") - F.when(F.col("correct"), 0).otherwise(1) > 0
    live_before = wrong_earlier & (before < GRADUATE_STREAK)
    status = (
        F.when(~F.col("correct"), F.when(live_before, "updated").otherwise("added"))
        .when(~seen | (F.col("streak") > GRADUATE_STREAK), "none")
        .when(F.col("streak") == GRADUATE_STREAK, "graduated")
        .otherwise("updated")
    )
    return out.withColumn("status", status).select(*attempts.columns, "streak", "status")


def apply_results(book: DataFrame, results: DataFrame, today: Column) -> DataFrame:
    """Merge one answer per key into an existing book and say what happens to each record."""
    known = F.col("b.qid").isNotNull()
    wrong = ~F.col("r.correct")
    streak = F.when(wrong, 0).otherwise(F.col("b.correct_streak") + 1)
    action = (
        F.when(F.col("r.qid").isNull(), "kept")
        .when(wrong & ~known, "added")
        .when(~wrong & ~known, "none")
        .when(~wrong & (streak >= GRADUATE_STREAK), "graduated")
        .otherwise("updated")
    )
    joined = book.alias("b").join(
        results.alias("r"), (F.col("b.bank") == F.col("r.bank")) & (F.col("b.qid") == F.col("r.qid")), "full_outer"
    )
    cap = len(INTERVALS) - 1
    out = joined.select(
        F.coalesce("b.bank", "r.bank").alias("bank"),
        F.coalesce("b.qid", "r.qid").alias("qid"),
        action.alias("action"),
        F.col("b.wrong_count").alias("_wc"), F.col("b.correct_streak").alias("_cs"), F.col("b.stage").alias("_st"),
        F.col("b.next_review").alias("_nr"),
        F.coalesce(wrong, F.lit(False)).alias("_wrong"),
    )
    touched = F.col("action").isin("added", "updated", "graduated")
    stage = (
        F.when(~touched, F.col("_st")).when(F.col("_wrong"), 0)
        .otherwise(F.least(F.col("_st") + 1, F.lit(cap)))
    )
    return out.select(
        "bank", "qid", "action",
        (F.coalesce("_wc", F.lit(0)) + F.when(F.col("_wrong"), 1).otherwise(0)).alias("wrong_count"),
        F.when(~touched, F.coalesce("_cs", F.lit(0))).when(F.col("_wrong"), 0).otherwise(F.col("_cs") + 1).alias("correct_streak"),
        F.coalesce(stage, F.lit(0)).cast("bigint").alias("stage"),
        F.when(~touched, F.col("_nr")).otherwise(next_review(today, F.coalesce(stage, F.lit(0)))).alias("next_review"),
    )
