"""Streaming queries (T1-T5) over the event table read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from itembank.operators import reports as R
from itembank.plans.registry import ORACLES, query
from itembank.plans.review import BOOK_COLS, _text
from itembank.plans.sqlviews import BOOK_BODY, EVENTS
from itembank.sources.tables import attempts, event_attempts, table
from itembank.streaming import attempts as S
from itembank.streaming.library import drain_cells

TS = "yyyy-MM-dd HH:mm:ss"


def _attempts(spark, sf):
    return event_attempts(S.event_stream(spark, sf))


@query("t1_stream_wrong_book", f"WITH {EVENTS}, {BOOK_BODY.format(src='v_events')} SELECT {BOOK_COLS} FROM v_book")
def t1(spark, sf):
    S.use_rocksdb(spark)
    return _text(S.latest_book(S.drain(S.review_updates(_attempts(spark, sf)), "update", label="review")))


@query("t2_stream_totals", f"""WITH {EVENTS} SELECT bank, qtype, count(*) AS answered, count(*) FILTER (WHERE correct) AS correct FROM v_events GROUP BY 1, 2""")
def t2(spark, sf):
    return S.drain(S.running_totals(_attempts(spark, sf)), "update", ["bank", "qtype"], "totals")


def _cells(spark, sf):
    """All answers as a stream, joined to the question and session tables batch by batch, reduced to cells."""
    return drain_cells(attempts(spark, sf, session_columns=True, lines=S.table_stream(spark, sf, "lineitem")))


@query("t2_stream_library", ORACLES["a5_library_totals"])
def t2_library(spark, sf):
    return R.library_totals(_cells(spark, sf))


@query("t2_stream_types", ORACLES["a6_by_type"])
def t2_types(spark, sf):
    return R.by_type(_cells(spark, sf))


@query("t2_stream_modes", ORACLES["a7_by_mode"])
def t2_modes(spark, sf):
    return R.by_mode(_cells(spark, sf))


@query("t2_stream_weak", ORACLES["a8_library_weak"])
def t2_weak(spark, sf):
    return R.library_weak(_cells(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("t2_stream_recent", ORACLES["a9_recent"])
def t2_recent(spark, sf):
    return R.recent_sessions(_cells(spark, sf)).select(
        "bank", "session_id", "mode", "answered", "correct", "accuracy", F.date_format("finished_at", TS).alias("finished_at"),
        F.col("rank").cast("bigint").alias("rank"), (F.col("rank") <= 10).alias("shown"),
    )


@query("t3_stream_dedupe", f"WITH {EVENTS} SELECT DISTINCT seq, bank, qid, qtype, correct FROM v_events")
def t3(spark, sf):
    twice = _attempts(spark, sf)
    twice = twice.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return S.drain(S.deduplicated(twice), "append", label="dedupe").select("seq", "bank", "qid", "qtype", "correct")


@query("t4_sessionize", f"""WITH {EVENTS},
g AS (SELECT *, CASE WHEN answered_at - lag(answered_at) OVER (PARTITION BY bank ORDER BY answered_at, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM v_events),
s AS (SELECT *, sum(o) OVER (PARTITION BY bank ORDER BY answered_at, seq ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT bank, strftime(min(answered_at), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(answered_at) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS ended_at,
  count(*) AS answered, count(*) FILTER (WHERE correct) AS correct FROM s GROUP BY bank, n""")
def t4(spark, sf):
    # the open sessions at the end of a stream never leave it, so the whole table is read as a batch
    rows = S.sessions(event_attempts(table(spark, sf, "events")))
    return rows.withColumn("started_at", F.date_format("started_at", TS)).withColumn("ended_at", F.date_format("ended_at", TS))


@query("t5_daily", f"""WITH {EVENTS} SELECT bank, strftime(answered_at, '%Y-%m-%d') AS day, count(*) AS answered, count(*) FILTER (WHERE correct) AS correct FROM v_events GROUP BY 1, 2""")
def t5(spark, sf):
    return S.drain(S.daily(_attempts(spark, sf)), "update", ["bank", "day"], "daily").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
