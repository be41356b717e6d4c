"""Schedule, book, ordering and grading against row-by-row readings of the rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from itembank.constants import INTERVALS
from itembank.functions import questions as X
from itembank.functions import text as T
from itembank.operators import picking as P
from itembank.operators.ordering import ordinal, running_totals
from itembank.operators.review import attempt_status, wrong_book

SCHEMA = "bank string, qid string, answered_at timestamp, seq bigint, correct boolean"


def fold(rows):
    """The rules, one answer at a time."""
    book, effects = {}, {}
    for bank, qid, at, seq, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        k = (bank, qid)
        rec = book.get(k)
        if not ok:
            effects[(k, seq)] = "updated" if rec else "added"
            book[k] = [rec[0] + 1 if rec else 1, 0, rec[2] if rec else at, at, at]
        elif rec:
            rec[1] += 1
            rec[4] = at
            effects[(k, seq)] = "graduated" if rec[1] >= 7 else "updated"
            if rec[1] >= 7:
                del book[k]
        else:
            effects[(k, seq)] = "none"
    return book, effects


def history(seed=5, keys=6, n=3000):
    """Random answers; the first key holds a third of them, runs of right answers are common."""
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < 0.34 else rnd.randrange(keys)
        rows.append(("b", str(k), start + dt.timedelta(hours=rnd.randrange(9000)), i, rnd.random() < 0.8))
    return rows


def test_book_and_effects_match_the_rules_for_any_chunk(spark):
    rows = history()
    want, effects = fold(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for chunk in ("month", "day", "year"):
        c = F.date_trunc(chunk, F.col("answered_at"))
        got = {(r["bank"], r["qid"]): r for r in wrong_book(df, chunk=c).collect()}
        assert set(got) == set(want)
        for k, (wc, streak, added, last_wrong, last) in want.items():
            r = got[k]
            assert (r["wrong_count"], r["correct_streak"], r["added_at"], r["last_wrong_at"], r["last_answer_at"]) == (wc, streak, added, last_wrong, last)
            assert r["next_review"] == (last + dt.timedelta(days=INTERVALS[min(streak, 6)])).date()
        status = {((r["bank"], r["qid"]), r["seq"]): r["status"] for r in attempt_status(df, chunk=c).collect()}
        assert status == effects


def test_stage_intervals(spark):
    at = dt.datetime(2026, 3, 1)
    for n, due in enumerate(["2026-03-02", "2026-03-03", "2026-03-05", "2026-03-08", "2026-03-16", "2026-03-31"], 1):
        rows = [("b", "q", at, 0, False)] + [("b", "q", at, i, True) for i in range(1, n + 1)]
        r = wrong_book(spark.createDataFrame(rows, SCHEMA)).collect()[0]
        assert (r["stage"], str(r["next_review"])) == (n, due)
    rows = [("b", "q", at, 0, False)] + [("b", "q", at, i, True) for i in range(1, 8)]
    assert wrong_book(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_due_and_retry_order(spark):
    rows = [("b", "A", 0, "2026-03-10", 1), ("b", "B", 0, "2026-03-07", 1), ("b", "C", 2, "2026-03-07", 9), ("b", "D", 1, "2026-03-20", 5), ("b", "E", 0, None, 1)]
    df = spark.createDataFrame(rows, "bank string, qid string, stage bigint, d string, wrong_count bigint").withColumn(
        "next_review", F.to_date("d")).withColumn("added_at", F.lit("2026-01-01").cast("timestamp"))
    today = F.lit("2026-03-10").cast("date")
    due = P.due_rank(P.due_records(df, today), today).orderBy("rank").collect()
    assert [r["qid"] for r in due] == ["E", "B", "A", "C"]
    assert [r["qid"] for r in P.retry_rank(df).orderBy("rank").collect()] == ["C", "D", "A", "B", "E"]


def test_ranged_numbering_equals_a_plain_window(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 11)) AS k", "id", "id % 7 AS v").repartition(9)
    out = ordinal(df, ["k"], ["id"], "n")
    check = out.selectExpr("n", "row_number() OVER (PARTITION BY k ORDER BY id) AS m").filter("n <> m").count()
    assert check == 0
    run = running_totals(df, ["k"], ["id"], {"s": F.col("v")}, {"t": F.col("v")})
    assert run.selectExpr("s", "sum(v) OVER (PARTITION BY k ORDER BY id) AS m").filter("s <> m").count() == 0


def _one(spark, *cols):
    return tuple(spark.range(1).select(*cols).collect()[0])


def test_normalising(spark):
    lit = F.lit
    assert _one(spark, *[X.normalize_choice(lit(x)) for x in ("ba", "D、A、C", "正确")]) == ("AB", "ACD", "")
    assert _one(spark, *[X.normalize_judge(lit(x)) for x in ("√", "错", "T", "maybe")]) == ("正确", "错误", "正确", "")
    assert _one(spark, T.normalize_stem(lit("中国的 首都，是（ ）")), T.extract_year(lit("2019年与2021年")), T.extract_year(lit("无"))) == ("中国的首都是", 2019, None)
    assert _one(spark, T.extract_topic(lit("【第一章 计算机】题")), T.extract_topic(lit("（经济法）题"))) == ("第一章 计算机", "经济法")
    assert _one(spark, F.sha1(lit("abc")))[0].startswith("a9993e36")


def test_grading(spark):
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    ab = F.create_map(F.lit("A"), F.lit("正确"), F.lit("B"), F.lit("错误"))
    g = lambda t, a, o, u: X.grade(F.lit(t), F.lit(a), o, F.lit(u))
    assert _one(spark, g("单选", "B", none, "b"), g("单选", "B", none, "A"), g("多选", "AB", none, "BA"), g("多选", "AB", none, "A")) == (True, False, True, False)
    assert _one(spark, g("判断", "√", none, "对"), g("判断", "√", none, "T"), g("判断", "√", none, "错误"), g("判断", "错误", ab, "B")) == (True, True, False, True)
    v = lambda t, o, u: X.validated(F.lit(t), o, F.lit(u))["ok"]
    assert _one(spark, v("单选", ab, "AB"), v("单选", ab, "你"), v("单选", ab, ""), v("多选", ab, "ab")) == (False, False, False, True)
