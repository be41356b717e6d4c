"""Session, library and bank reports over the answer facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.constants import QUESTION_TYPES, RECENT_KEPT, SINGLE, WEAK_MERGE_TOP, WEAK_TOP
from itembank.functions.review import accuracy, number_text, type_rank
from itembank.operators.ordering import first_rows, ordinal

SESSION = ("bank", "session_id")


def right() -> Column:
    return F.when(F.col("correct"), 1).otherwise(0).cast("bigint")


def measures(facts: DataFrame) -> tuple[Column, Column]:
    """Sums of answers and right answers: of single answers, or of rows that already hold counts."""
    if "answered" in facts.columns:
        return F.sum("answered"), F.sum("correct")
    return F.count("*"), F.sum(right())


def knowledge_point() -> Column:
    return F.when(F.coalesce(F.col("topic"), F.lit("")) != "", F.col("topic")).otherwise(F.col("qtype"))


def session_summary(attempts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Totals of each session; distinct questions are counted in two partially aggregated steps."""
    per_question = attempts.groupBy(*SESSION, *extra, "qid").agg(
        F.count("*").alias("answered"), F.sum(right()).alias("correct"),
        F.min("answered_at").alias("started_at"), F.max("answered_at").alias("finished_at"),
    )
    return (
        per_question.groupBy(*SESSION, *extra)
        .agg(
            F.sum("answered").alias("answered"), F.sum("correct").alias("correct"),
            F.count("*").alias("questions"),
            F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
        )
        .withColumn("accuracy", accuracy(F.col("correct"), F.col("answered")))
    )


def session_totals(attempts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    answered, correct = measures(attempts)
    return (
        attempts.groupBy(*SESSION, *extra)
        .agg(answered.alias("answered"), correct.alias("correct"), F.max("answered_at").alias("finished_at"))
        .withColumn("accuracy", accuracy(F.col("correct"), F.col("answered")))
    )


def session_types(attempts: DataFrame) -> DataFrame:
    return (
        attempts.groupBy(*SESSION, "qtype")
        .agg(F.count("*").alias("answered"), F.sum(right()).alias("correct"))
    )


def wrong_items(attempts: DataFrame) -> DataFrame:
    """Wrong answers of each session, numbered in answering order (one row each, no arrays)."""
    return ordinal(attempts.filter(~F.col("correct")), SESSION, ["answered_at", "seq", "qid"], "item_no")


def topic_counts(attempts: DataFrame) -> DataFrame:
    """Answered, right and wrong per (session, knowledge point)."""
    answered, correct = measures(attempts)
    return (
        attempts.withColumn("topic", knowledge_point())
        .groupBy(*SESSION, "topic")
        .agg(answered.alias("answered"), correct.alias("right"))
        .withColumn("wrong", F.col("answered") - F.col("right"))
    )


def weak_points(attempts: DataFrame, top: int = WEAK_TOP) -> DataFrame:
    """The weakest knowledge points of each session."""
    ranked = first_rows(
        topic_counts(attempts).filter("wrong > 0"), SESSION,
        [F.desc("wrong"), F.desc("answered"), F.asc("topic")], top, "rank",
    )
    return ranked.withColumn("accuracy", accuracy(F.col("right"), F.col("answered")))


def library_totals(attempts: DataFrame) -> DataFrame:
    return (
        session_totals(attempts).groupBy("bank")
        .agg(
            F.count("*").alias("sessions"), F.sum("answered").alias("answered"),
            F.sum("correct").alias("correct"), F.max("accuracy").alias("best_accuracy"),
        )
        .withColumn("accuracy", accuracy(F.col("correct"), F.col("answered")))
    )


def by_type(attempts: DataFrame) -> DataFrame:
    answered, correct = measures(attempts)
    return (
        attempts.groupBy("bank", "qtype")
        .agg(answered.alias("answered"), correct.alias("correct"))
        .withColumn("accuracy", accuracy(F.col("correct"), F.col("answered")))
        .withColumn("type_rank", type_rank(F.col("qtype")))
    )


def by_mode(attempts: DataFrame) -> DataFrame:
    return (
        session_totals(attempts, ("mode",)).groupBy("bank", "mode")
        .agg(F.count("*").alias("sessions"), F.sum("answered").alias("answered"), F.sum("correct").alias("correct"))
        .withColumn("accuracy", accuracy(F.col("correct"), F.col("answered")))
    )


def library_weak(attempts: DataFrame, top: int = WEAK_TOP, unbiased: bool = False) -> DataFrame:
    """Weakest knowledge points of a bank.

    By default a session contributes only the points it got wrong, at most fifty of them, as
    the per-session merge does; ``unbiased`` counts every answer instead.
    """
    per_session = topic_counts(attempts) if unbiased else weak_points(attempts, WEAK_MERGE_TOP)
    totals = per_session.groupBy("bank", "topic").agg(F.sum("wrong").alias("wrong"), F.sum("answered").alias("answered"))
    return first_rows(totals.filter("wrong > 0"), ["bank"], [F.desc("wrong"), F.asc("topic")], top, "rank")


def recent_sessions(attempts: DataFrame, kept: int = RECENT_KEPT) -> DataFrame:
    return first_rows(
        session_totals(attempts, ("mode",)), ["bank"],
        [F.desc("finished_at"), F.desc("session_id")], kept, "rank",
    )


def type_rollup(questions: DataFrame) -> DataFrame:
    """Question counts per type and, as the empty type, for the whole bank."""
    return (
        questions.rollup("bank", "qtype").agg(F.count("*").alias("count"), F.grouping("qtype").alias("all_types"))
        .filter("bank is not null")
        .withColumn("qtype", F.when(F.col("all_types") == 1, "").otherwise(F.col("qtype")))
        .withColumn(
            "label",
            F.when(F.col("all_types") == 1, F.concat(F.lit("全部题型（"), F.col("count").cast("string"), F.lit(" 题）")))
            .otherwise(F.concat("qtype", F.lit("题（"), F.col("count").cast("string"), F.lit(" 题）"))),
        )
        .drop("all_types")
    )


def group_by_type(records: DataFrame) -> DataFrame:
    """Record counts per type; a type outside the five counts as single choice."""
    kind = F.when(F.col("qtype").isin(*QUESTION_TYPES), F.col("qtype")).otherwise(F.lit(SINGLE))
    return records.withColumn("qtype", kind).groupBy("bank", "qtype").agg(F.count("*").alias("records"))


def year_summary(questions: DataFrame) -> DataFrame:
    per_year = questions.groupBy("bank", "year").agg(F.count("*").alias("n"))
    dated = F.col("year").isNotNull()
    out = per_year.groupBy("bank").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(~dated, F.col("n")).otherwise(0)).alias("undated"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count("year").alias("years"),
    )
    s = lambda c: F.col(c).cast("string")
    return out.withColumn(
        "text",
        F.when(F.col("years") == 0, F.concat(F.lit("共 "), s("total"), F.lit(" 题（均未识别到年份）"))).otherwise(
            F.concat(
                F.lit("共 "), s("total"), F.lit(" 题，年份 "), s("first_year"), F.lit("~"), s("last_year"), F.lit("（"),
                s("years"), F.lit(" 个年份），无年份 "), s("undated"), F.lit(" 题"),
            )
        ),
    )


def session_text(attempts: DataFrame, book_totals: DataFrame) -> DataFrame:
    """The session report as numbered text lines, one row per line.

    Lines of one session are never gathered into a single cell; a writer that wants files sorts
    by (bank, session_id, part, line_no).
    """
    s = lambda c: F.col(c).cast("string")
    head = (
        session_totals(attempts, ("mode",)).join(book_totals, "bank", "left")
        .withColumn("book", F.coalesce("book", F.lit(0)))
    )
    all_right = F.col("answered") == F.col("correct")
    head_lines = head.select(
        *SESSION,
        F.posexplode(
            F.array_compact(
                F.array(
                    F.struct(F.lit(1).alias("part"), F.concat(F.lit("【"), "bank", F.lit("】"), "mode").alias("text")),
                    F.struct(
                        F.lit(1).alias("part"),
                        F.concat(
                            F.lit("本次答题 "), s("answered"), F.lit(" 题，正确 "), s("correct"), F.lit(" 题，正确率 "),
                            number_text(F.col("accuracy")), F.lit("%"),
                        ).alias("text"),
                    ),
                    F.struct(F.lit(1).alias("part"), F.concat(F.lit("当前错题本共 "), s("book"), F.lit(" 道")).alias("text")),
                    F.struct(
                        F.lit(1).alias("part"),
                        F.when(all_right, "本次全部答对，很棒！").otherwise("答错题目：").alias("text"),
                    ),
                    F.when(
                        ~all_right, F.struct(F.lit(3).alias("part"), F.lit("薄弱知识点：").alias("text"))
                    ),
                )
            )
        ).alias("pos", "row"),
    ).select(
        *SESSION, F.col("row.part").alias("part"),
        F.when(F.col("row.part") == 3, 0).otherwise(F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.col("row.text").alias("text"),
    )
    dash = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "—").otherwise(F.col(c))
    item_lines = wrong_items(attempts).select(
        *SESSION, F.lit(2).alias("part"), F.col("item_no").alias("line_no"),
        F.concat(
            F.lit("  "), s("item_no"), F.lit(". ["), "qtype", F.lit("] "), F.substring("stem", 1, 40),
            F.lit("（你的答案："), dash("user_answer"), F.lit("，正确答案："), dash("answer"), F.lit("）"),
        ).alias("text"),
    )
    weak_lines = weak_points(attempts).select(
        *SESSION, F.lit(3).alias("part"), F.col("rank").cast("bigint").alias("line_no"),
        F.concat(
            F.lit("  "), "topic", F.lit("：错 "), s("wrong"), F.lit(" 题 / 共 "), s("answered"), F.lit(" 题（正确率 "),
            number_text(F.col("accuracy")), F.lit("%）"),
        ).alias("text"),
    )
    return head_lines.unionByName(item_lines).unionByName(weak_lines)
