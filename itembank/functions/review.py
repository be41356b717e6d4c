"""Accuracy, dates and review labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itembank.constants import GRADUATE_STREAK, INTERVALS, LOW_ACCURACY, MODES, QUESTION_TYPES


def accuracy(correct: Column, answered: Column) -> Column:
    """Percent with one decimal, half up; 0 when nothing was answered."""
    share = correct.cast("double") / answered.cast("double")
    return F.when(answered == 0, F.lit(0.0)).otherwise(F.floor(share * 1000 + 0.5) / 10)


def interval_days(stage: Column) -> Column:
    days = F.array(*[F.lit(d) for d in INTERVALS])
    return F.element_at(days, (F.least(stage, F.lit(len(INTERVALS) - 1)) + 1).cast("int"))


def next_review(answered_on: Column, stage: Column) -> Column:
    return F.date_add(answered_on.cast("date"), interval_days(stage))


def is_due(next_review_on: Column, today: Column) -> Column:
    return next_review_on.isNull() | (next_review_on <= today)


def due_label(day: Column, today: Column) -> Column:
    diff = F.datediff(day, today)
    text = F.date_format(day, "yyyy-MM-dd")
    return (
        F.when(day.isNull(), "未安排")
        .when(diff == 0, "今天")
        .when(diff == 1, "明天")
        .when(diff == -1, "昨天（逾期 1 天）")
        .when(diff < 0, F.concat(text, F.lit("（逾期 "), (-diff).cast("string"), F.lit(" 天）")))
        .otherwise(text)
    )


def stage_text(stage: Column, streak: Column) -> Column:
    return F.concat(
        F.lit("阶段 "), stage.cast("string"), F.lit(f"/{len(INTERVALS) - 1} · 连续答对 "),
        streak.cast("string"), F.lit(f"/{GRADUATE_STREAK}"),
    )


def next_review_hint(stage: Column) -> Column:
    return F.concat(F.lit("答对后 +"), interval_days(stage + 1).cast("string"), F.lit(" 天"))


def type_rank(qtype: Column) -> Column:
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(QUESTION_TYPES))):
        rank = F.when(qtype == name, i).otherwise(rank)
    return rank


def mode_name(mode: Column, qtype: Column | None = None) -> Column:
    label = mode
    for key, name in MODES.items():
        label = F.when(mode == key, name).otherwise(label)
    if qtype is None:
        return label
    return F.when(qtype != "", F.concat(label, F.lit("·"), qtype)).otherwise(label)


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value, F.lit(0.0))))


def is_low(value: Column) -> Column:
    return clamp_percent(value) < LOW_ACCURACY


def number_text(value: Column) -> Column:
    """A number as text with no trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def percent_text(value: Column) -> Column:
    return F.concat(number_text(F.floor(value * 10 + 0.5) / 10), F.lit("%"))
