"""Session and library reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions.questions import grade
from itembank.functions.review import is_low, percent_text
from itembank.operators import reports as R
from itembank.operators.ordering import running_totals
from itembank.operators.review import wrong_book
from itembank.plans.registry import query
from itembank.plans.sqlviews import A, BOOK, Q, acc, ts
from itembank.sources.tables import attempts, questions

TS = "yyyy-MM-dd HH:mm:ss"
SESSION_SQL = A + f""",
v_sessions AS (
  SELECT bank, session_id, mode, count(*) AS answered, count(*) FILTER (WHERE correct) AS correct,
         count(DISTINCT qid) AS questions, min(answered_at) AS started_at, max(answered_at) AS finished_at,
         {acc('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy
  FROM v_attempts GROUP BY bank, session_id, mode
),
v_topics AS (
  SELECT bank, session_id, CASE WHEN topic <> '' THEN topic ELSE qtype END AS topic, count(*) AS answered,
         count(*) FILTER (WHERE correct) AS right_n, count(*) FILTER (WHERE NOT correct) AS wrong
  FROM v_attempts GROUP BY 1, 2, 3
),
v_weak AS (
  SELECT *, row_number() OVER (PARTITION BY bank, session_id ORDER BY wrong DESC, answered DESC, topic) AS rank
  FROM v_topics WHERE wrong > 0
)"""


@query("a1_session_summary", f"""WITH {SESSION_SQL}
SELECT bank, session_id, answered, correct, questions, accuracy, {ts('started_at')} AS started_at,
       {ts('finished_at')} AS finished_at FROM v_sessions""")
def a1(spark, sf):
    return R.session_summary(attempts(spark, sf)).withColumn("started_at", F.date_format("started_at", TS)).withColumn(
        "finished_at", F.date_format("finished_at", TS)
    )


@query("a2_session_types", f"""WITH {A}
SELECT bank, session_id, qtype, count(*) AS answered, count(*) FILTER (WHERE correct) AS correct
FROM v_attempts GROUP BY 1, 2, 3""")
def a2(spark, sf):
    return R.session_types(attempts(spark, sf))


@query("a3_wrong_items", f"""WITH {A}
SELECT bank, session_id, row_number() OVER (PARTITION BY bank, session_id ORDER BY answered_at, seq, qid) AS item_no,
       qid, stem, qtype, answer, user_answer FROM v_attempts WHERE NOT correct""")
def a3(spark, sf):
    return R.wrong_items(attempts(spark, sf)).select(
        "bank", "session_id", "item_no", "qid", "stem", "qtype", "answer", "user_answer"
    )


@query("a4_weak_points", f"""WITH {SESSION_SQL}
SELECT bank, session_id, rank, topic, wrong, answered, right_n AS "right", {acc('right_n', 'answered')} AS accuracy
FROM v_weak WHERE rank <= 5""")
def a4(spark, sf):
    return R.weak_points(attempts(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("a5_library_totals", f"""WITH {SESSION_SQL}
SELECT bank, count(*) AS sessions, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(correct) AS BIGINT) AS correct,
       max(accuracy) AS best_accuracy, {acc('sum(correct)', 'sum(answered)')} AS accuracy
FROM v_sessions GROUP BY bank""")
def a5(spark, sf):
    return R.library_totals(attempts(spark, sf))


@query("a6_by_type", f"""WITH {A}
SELECT bank, qtype, count(*) AS answered, count(*) FILTER (WHERE correct) AS correct,
       {acc('count(*) FILTER (WHERE correct)', 'count(*)')} AS accuracy,
       CASE qtype WHEN '单选' THEN 0 WHEN '多选' THEN 1 WHEN '判断' THEN 2 WHEN '简答' THEN 3 WHEN '论述' THEN 4 ELSE 99 END AS type_rank
FROM v_attempts GROUP BY bank, qtype""")
def a6(spark, sf):
    return R.by_type(attempts(spark, sf))


@query("a7_by_mode", f"""WITH {SESSION_SQL}
SELECT bank, mode, count(*) AS sessions, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(correct) AS BIGINT) AS correct,
       {acc('sum(correct)', 'sum(answered)')} AS accuracy
FROM v_sessions GROUP BY bank, mode""")
def a7(spark, sf):
    return R.by_mode(attempts(spark, sf, session_columns=True))


@query("a8_library_weak", f"""WITH {SESSION_SQL},
t AS (SELECT bank, topic, CAST(sum(wrong) AS BIGINT) AS wrong, CAST(sum(answered) AS BIGINT) AS answered
      FROM v_weak WHERE rank <= 50 GROUP BY bank, topic),
r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY wrong DESC, topic) AS rank FROM t)
SELECT * FROM r WHERE rank <= 5""")
def a8(spark, sf):
    return R.library_weak(attempts(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("a8_library_weak_unbiased", f"""WITH {SESSION_SQL},
t AS (SELECT bank, topic, CAST(sum(wrong) AS BIGINT) AS wrong, CAST(sum(answered) AS BIGINT) AS answered
      FROM v_topics GROUP BY bank, topic),
r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY wrong DESC, topic) AS rank FROM t WHERE wrong > 0)
SELECT * FROM r WHERE rank <= 5""")
def a8_unbiased(spark, sf):
    return R.library_weak(attempts(spark, sf), unbiased=True).withColumn("rank", F.col("rank").cast("bigint"))


@query("a9_recent", f"""WITH {SESSION_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY finished_at DESC, session_id DESC) AS rank FROM v_sessions)
SELECT bank, session_id, mode, answered, correct, accuracy, {ts('finished_at')} AS finished_at, rank, rank <= 10 AS shown
FROM r WHERE rank <= 20""")
def a9(spark, sf):
    return R.recent_sessions(attempts(spark, sf, session_columns=True)).select(
        "bank", "session_id", "mode", "answered", "correct", "accuracy",
        F.date_format("finished_at", TS).alias("finished_at"),
        F.col("rank").cast("bigint").alias("rank"), (F.col("rank") <= 10).alias("shown"),
    )


@query("a11_type_rollup", f"""WITH {Q}
SELECT bank, coalesce(qtype, '') AS qtype, count(*) AS "count",
       CASE WHEN qtype IS NULL THEN '全部题型（' || count(*) || ' 题）' ELSE qtype || '题（' || count(*) || ' 题）' END AS label
FROM v_questions GROUP BY GROUPING SETS ((bank), (bank, qtype))""")
def a11(spark, sf):
    return R.type_rollup(questions(spark, sf))


@query("a13_year_summary", f"""WITH {Q}
SELECT bank, count(*) AS total, count(*) FILTER (WHERE year IS NULL) AS undated, min(year) AS first_year,
       max(year) AS last_year, count(DISTINCT year) AS years,
       CASE WHEN count(year) = 0 THEN '共 ' || count(*) || ' 题（均未识别到年份）'
            ELSE '共 ' || count(*) || ' 题，年份 ' || min(year) || '~' || max(year) || '（' || count(DISTINCT year)
                 || ' 个年份），无年份 ' || count(*) FILTER (WHERE year IS NULL) || ' 题' END AS text
FROM v_questions GROUP BY bank""")
def a13(spark, sf):
    return R.year_summary(questions(spark, sf))


@query("a15_overview", f"""WITH {Q}
SELECT count(DISTINCT bank) AS bank_count, count(*) AS question_count FROM v_questions""")
def a15(spark, sf):
    per_bank = questions(spark, sf).groupBy("bank").agg(F.count("*").alias("n"))
    return per_bank.agg(F.count("*").alias("bank_count"), F.sum("n").alias("question_count"))


@query("p28_low_accuracy", f"""WITH {SESSION_SQL}
SELECT bank, session_id, accuracy < 60 AS low,
       CASE WHEN accuracy = floor(accuracy) THEN CAST(CAST(accuracy AS BIGINT) AS VARCHAR) ELSE CAST(accuracy AS VARCHAR) END || '%' AS text
FROM v_sessions""")
def p28(spark, sf):
    return R.session_totals(attempts(spark, sf)).select(
        "bank", "session_id", is_low(F.col("accuracy")).alias("low"), percent_text(F.col("accuracy")).alias("text")
    )


@query("j7_star_grade", f"""WITH {A}
SELECT bank, session_id, seq, tie, qid, user_answer, correct, CASE WHEN topic <> '' THEN topic ELSE qtype END AS topic
FROM v_attempts""")
def j7(spark, sf):
    facts = attempts(spark, sf).select("bank", "qid", "session_id", "seq", "tie", "user_answer")
    dim = questions(spark, sf).select("bank", "qid", "qtype", "options", "answer", "topic")
    graded = facts.join(dim, ["bank", "qid"])
    return graded.select(
        "bank", "session_id", "seq", "tie", "qid", "user_answer",
        grade(F.col("qtype"), F.col("answer"), F.col("options"), F.col("user_answer")).alias("correct"),
        R.knowledge_point().alias("topic"),
    )


@query("j8_option_lookup", f"""WITH {Q}
SELECT bank, qid, CASE WHEN qtype = '判断' THEN answer
       WHEN answer IN ('A', 'B', 'C', 'D') THEN answer || '．' || CASE answer WHEN 'A' THEN opt_a WHEN 'B' THEN opt_b WHEN 'C' THEN opt_c ELSE opt_d END
       WHEN answer = '' THEN '（无参考答案）' ELSE answer END AS text
FROM v_questions""")
def j8(spark, sf):
    option = F.try_element_at("options", F.col("answer"))
    text = (
        F.when(F.col("qtype") == "判断", F.col("answer"))
        .when(F.coalesce(option, F.lit("")) != "", F.concat("answer", F.lit("．"), option))
        .when(F.col("answer") == "", "（无参考答案）").otherwise(F.col("answer"))
    )
    return questions(spark, sf).select("bank", "qid", text.alias("text"))


@query("w1_progress", f"""WITH {A},
r AS (SELECT bank, session_id, seq, qid,
        row_number() OVER w AS answered,
        CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct,
        count(*) OVER (PARTITION BY bank, session_id) AS total FROM v_attempts
      WINDOW w AS (PARTITION BY bank, session_id ORDER BY answered_at, seq, qid ROWS UNBOUNDED PRECEDING))
SELECT *, answered || '/' || total || '　已答 ' || answered || ' · 正确 ' || correct AS text FROM r""")
def w1(spark, sf):
    one = F.lit(1).cast("bigint")
    rows = running_totals(
        attempts(spark, sf).select("bank", "session_id", "seq", "qid", "answered_at", F.col("correct").alias("ok")),
        ["bank", "session_id"], ["answered_at", "seq", "qid"],
        {"answered": one, "correct": F.when(F.col("ok"), 1).otherwise(0).cast("bigint")}, {"total": one},
    )
    s = lambda c: F.col(c).cast("string")
    text = F.concat(s("answered"), F.lit("/"), s("total"), F.lit("　已答 "), s("answered"), F.lit(" · 正确 "), s("correct"))
    return rows.select("bank", "session_id", "seq", "qid", "answered", "correct", "total", text.alias("text"))


@query("s13_session_text", f"""WITH {SESSION_SQL}, {BOOK[len(A) + 1:]},
k AS (SELECT bank, count(*) AS n FROM v_book GROUP BY bank),
h AS (SELECT s.*, coalesce(k.n, 0) AS book,
        CASE WHEN accuracy = floor(accuracy) THEN CAST(CAST(accuracy AS BIGINT) AS VARCHAR) ELSE CAST(accuracy AS VARCHAR) END AS acc
      FROM v_sessions s LEFT JOIN k USING (bank)),
i AS (SELECT *, row_number() OVER (PARTITION BY bank, session_id ORDER BY answered_at, seq, qid) AS n FROM v_attempts WHERE NOT correct),
w AS (SELECT *, {acc('right_n', 'answered')} AS a FROM v_weak WHERE rank <= 5)
SELECT bank, session_id, 1 AS part, 1 AS line_no, '【' || bank || '】' || mode AS text FROM h
UNION ALL SELECT bank, session_id, 1, 2, '本次答题 ' || answered || ' 题，正确 ' || correct || ' 题，正确率 ' || acc || '%' FROM h
UNION ALL SELECT bank, session_id, 1, 3, '当前错题本共 ' || book || ' 道' FROM h
UNION ALL SELECT bank, session_id, 1, 4, CASE WHEN answered = correct THEN '本次全部答对，很棒！' ELSE '答错题目：' END FROM h
UNION ALL SELECT bank, session_id, 2, n, '  ' || n || '. [' || qtype || '] ' || stem[:40] || '（你的答案：' || user_answer || '，正确答案：' || answer || '）' FROM i
UNION ALL SELECT bank, session_id, 3, 0, '薄弱知识点：' FROM h WHERE answered <> correct
UNION ALL SELECT bank, session_id, 3, rank, '  ' || topic || '：错 ' || wrong || ' 题 / 共 ' || answered || ' 题（正确率 ' ||
   CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE CAST(a AS VARCHAR) END || '%）' FROM w""")
def s13(spark, sf):
    facts = attempts(spark, sf, session_columns=True)
    totals = wrong_book(facts, order=("answered_at", "seq", "tie")).groupBy("bank").agg(F.count("*").alias("book"))
    return R.session_text(facts, totals)
