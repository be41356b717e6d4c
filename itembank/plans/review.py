"""Mistake book, due lists, orderings and picking (A10, A12, A14, O*, W2, J2-J4, P23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions.review import due_label, is_due, mode_name, next_review_hint, stage_text
from itembank.operators import picking as P
from itembank.operators import reports as R
from itembank.operators.repository import flag_favorites, toggle_state
from itembank.operators.review import apply_results, attempt_status, wrong_book
from itembank.operators.ordering import keep_first
from itembank.plans.registry import query
from itembank.plans.sqlviews import A, BOOK, BOOK_BODY, FAV, Q, day, ts
from itembank.sources.tables import attempts, favorite_clicks, questions

TS = "yyyy-MM-dd HH:mm:ss"
ORDER = ("answered_at", "seq", "tie")
TODAY = "2001-11-05"
TODAY_SQL = f"DATE '{TODAY}'"
SEED = 20240101


def today():
    return F.lit(TODAY).cast("date")


def book(spark, sf):
    return wrong_book(attempts(spark, sf), order=ORDER)


def favorites(spark, sf):
    return toggle_state(favorite_clicks(spark, sf))


def _text(df):
    out = df
    for c in ("added_at", "last_wrong_at", "last_answer_at"):
        if c in df.columns:
            out = out.withColumn(c, F.date_format(c, TS))
    if "next_review" in df.columns:
        out = out.withColumn("next_review", F.date_format("next_review", "yyyy-MM-dd"))
    return out


BOOK_COLS = (
    f"bank, qid, wrong_count, correct_streak, stage, {day('next_review')} AS next_review, {ts('added_at')} AS added_at, "
    f"{ts('last_wrong_at')} AS last_wrong_at, {ts('last_answer_at')} AS last_answer_at"
)


@query("a10_wrong_book", f"WITH {BOOK} SELECT {BOOK_COLS} FROM v_book")
def a10(spark, sf):
    return _text(book(spark, sf))


@query("w2_streak", f"""WITH {BOOK},
s AS (SELECT b2.*, coalesce(e.epoch, 0) AS epoch, coalesce(p.nc, 0) AS prev_nc
      FROM b2 LEFT JOIN be e ON b2.bank = e.bank AND b2.qid = e.qid AND b2.isl = e.isl
      LEFT JOIN be p ON b2.bank = p.bank AND b2.qid = p.qid AND b2.isl = p.isl + 1)
SELECT bank, qid, seq, tie, {ts('answered_at')} AS answered_at, CAST(nc AS BIGINT) AS streak,
       CASE WHEN NOT correct THEN CASE WHEN isl = 1 OR prev_nc >= 7 THEN 'added' ELSE 'updated' END
            WHEN isl = 0 OR nc > 7 THEN 'none' WHEN nc = 7 THEN 'graduated' ELSE 'updated' END AS status
FROM s""")
def w2(spark, sf):
    rows = attempt_status(attempts(spark, sf), order=ORDER)
    return rows.select("bank", "qid", "seq", "tie", F.date_format("answered_at", TS).alias("answered_at"), "streak", "status")


@query("a12_group_by_type", f"""WITH {BOOK}
SELECT bank, coalesce(qtype, '单选') AS qtype, count(*) AS records FROM v_book LEFT JOIN v_questions USING (bank, qid) GROUP BY 1, 2""")
def a12(spark, sf):
    return R.group_by_type(book(spark, sf).join(questions(spark, sf).select("bank", "qid", "qtype"), ["bank", "qid"], "left"))


@query("a14_book_totals", f"""WITH {BOOK} {FAV},
w AS (SELECT bank, count(*) AS wrong_total, count(*) FILTER (WHERE next_review <= {TODAY_SQL}) AS due_total FROM v_book GROUP BY bank),
f AS (SELECT bank, count(*) AS favorite_total FROM v_fav GROUP BY bank)
SELECT coalesce(w.bank, f.bank) AS bank, coalesce(wrong_total, 0) AS wrong_total, coalesce(due_total, 0) AS due_total,
       coalesce(favorite_total, 0) AS favorite_total FROM w FULL JOIN f ON w.bank = f.bank""")
def a14(spark, sf):
    w = book(spark, sf).groupBy("bank").agg(
        F.count("*").alias("wrong_total"), F.count_if(is_due(F.col("next_review"), today())).alias("due_total")
    )
    f = favorites(spark, sf).groupBy("bank").agg(F.count("*").alias("favorite_total"))
    return w.join(f, "bank", "full_outer").fillna(0)


@query("j2_due_overview", f"""WITH {BOOK}, n AS (SELECT bank, count(*) AS questions FROM v_questions GROUP BY bank),
d AS (SELECT bank, count(*) AS due FROM v_book WHERE next_review IS NULL OR next_review <= {TODAY_SQL} GROUP BY bank)
SELECT bank, questions, coalesce(due, 0) AS due FROM n LEFT JOIN d USING (bank)""")
def j2(spark, sf):
    due = P.due_records(book(spark, sf), today()).groupBy("bank").agg(F.count("*").alias("due"))
    banks = questions(spark, sf).groupBy("bank").agg(F.count("*").alias("questions"))
    return banks.join(due, "bank", "left").fillna(0, ["due"])


@query("j3_fav_flag", f"""WITH {BOOK} {FAV}
SELECT b.bank, b.qid, b.wrong_count, f.qid IS NOT NULL AS is_favorite
FROM v_book b LEFT JOIN v_fav f ON b.bank = f.bank AND b.qid = f.qid""")
def j3(spark, sf):
    return flag_favorites(book(spark, sf).select("bank", "qid", "wrong_count"), favorites(spark, sf))


CUT = "2000-01-01"
J4_BODY = BOOK_BODY.format(src="v_before")


@query("j4_merge_action", f"""WITH {A},
v_before AS (SELECT * FROM v_attempts WHERE answered_at < DATE '{CUT}'),
{J4_BODY},
v_res AS (SELECT bank, qid, correct FROM (SELECT *, row_number() OVER (PARTITION BY bank, qid ORDER BY answered_at, seq, tie) AS rn
          FROM v_attempts WHERE answered_at >= DATE '{CUT}') WHERE rn = 1),
j AS (SELECT coalesce(b.bank, r.bank) AS bank, coalesce(b.qid, r.qid) AS qid, b.qid IS NOT NULL AS known, r.qid IS NOT NULL AS answered,
        coalesce(NOT r.correct, false) AS wrong, coalesce(wrong_count, 0) AS wc, coalesce(correct_streak, 0) AS cs, coalesce(stage, 0) AS st, next_review AS nr
      FROM v_book b FULL JOIN v_res r ON b.bank = r.bank AND b.qid = r.qid),
k AS (SELECT *, CASE WHEN NOT answered THEN 'kept' WHEN wrong AND NOT known THEN 'added' WHEN NOT known THEN 'none'
        WHEN NOT wrong AND cs + 1 >= 7 THEN 'graduated' ELSE 'updated' END AS action FROM j),
l AS (SELECT *, CAST(CASE WHEN action IN ('kept', 'none') THEN st WHEN wrong THEN 0 ELSE least(st + 1, 6) END AS BIGINT) AS stage FROM k)
SELECT bank, qid, action, CAST(wc + CASE WHEN wrong THEN 1 ELSE 0 END AS BIGINT) AS wrong_count,
  CAST(CASE WHEN action IN ('kept', 'none') THEN cs WHEN wrong THEN 0 ELSE cs + 1 END AS BIGINT) AS correct_streak, stage,
  coalesce(strftime(CASE WHEN action IN ('kept', 'none') THEN nr ELSE {TODAY_SQL} + CAST(CASE stage WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2
    WHEN 3 THEN 4 WHEN 4 THEN 7 WHEN 5 THEN 15 ELSE 30 END AS INT) END, '%Y-%m-%d'), '') AS next_review
FROM l""")
def j4(spark, sf):
    facts = attempts(spark, sf).select("bank", "qid", "answered_at", "seq", "tie", "correct")
    before = wrong_book(facts.filter(F.col("answered_at") < CUT), order=ORDER)
    results = keep_first(facts.filter(F.col("answered_at") >= CUT), ["bank", "qid"], ORDER)
    return _text(apply_results(before, results, today())).fillna("", ["next_review"])


@query("o1_due_rank", f"""WITH {BOOK}
SELECT bank, qid, row_number() OVER (PARTITION BY bank ORDER BY stage, next_review NULLS FIRST, wrong_count DESC, qid) AS rank FROM v_book""")
def o1(spark, sf):
    return P.due_rank(book(spark, sf), today()).select("bank", "qid", "rank")


@query("o2_retry_rank", f"""WITH {BOOK}
SELECT bank, qid, row_number() OVER (PARTITION BY bank ORDER BY wrong_count DESC, stage, added_at, qid) AS rank FROM v_book""")
def o2(spark, sf):
    return P.retry_rank(book(spark, sf)).select("bank", "qid", "rank")


@query("o3_due_filter", f"WITH {BOOK} SELECT {BOOK_COLS} FROM v_book WHERE next_review IS NULL OR next_review <= {TODAY_SQL}")
def o3(spark, sf):
    return _text(P.due_records(book(spark, sf), today()))


@query("o5_shuffle", f"""WITH {Q}
SELECT bank, qid, row_number() OVER (PARTITION BY bank ORDER BY sha1('{SEED}|' || bank || '|' || qid), qid) AS rank FROM v_questions""")
def o5(spark, sf):
    return P.shuffled(questions(spark, sf), SEED).select("bank", "qid", "rank")


PICK = "SELECT bank, qid, stem, qtype, answer, position FROM p"


def _pick(spark, sf, mode, **kw):
    q = questions(spark, sf).select("bank", "qid", "ord", "stem", "qtype", "answer", "year")
    return P.pick_questions(q, mode, **kw).select(
        "bank", "qid", "stem", "qtype", "answer", F.col("position").cast("bigint").alias("position")
    )


def _pick_sql(order: str, where: str = "true", src: str = "v_questions", with_: str = Q, limit: int = 0) -> str:
    cut = f" WHERE position <= {limit}" if limit else ""
    return f"""WITH {with_},
p AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY {order}) AS position FROM {src} WHERE {where}) {PICK}{cut}"""


@query("o4_pick_order", _pick_sql("ord"))
def o4_order(spark, sf):
    return _pick(spark, sf, "order")


@query("o4_pick_random", _pick_sql(f"sha1('{SEED}|' || bank || '|' || qid), qid", limit=30))
def o4_random(spark, sf):
    return _pick(spark, sf, "random", seed=SEED, limit=30)


WQ = "(SELECT q.*, stage, next_review, wrong_count, added_at FROM v_book JOIN v_questions q USING (bank, qid))"


@query("o4_pick_wrong", _pick_sql("wrong_count DESC, stage, added_at, qid", src=WQ, with_=BOOK, limit=20))
def o4_wrong(spark, sf):
    return _pick(spark, sf, "wrong", wrong=book(spark, sf), limit=20)


@query("o4_pick_favorite", _pick_sql("qid", src="(SELECT q.* FROM v_questions q JOIN v_fav USING (bank, qid))", with_=A + FAV))
def o4_favorite(spark, sf):
    return _pick(spark, sf, "favorite", favorites=favorites(spark, sf))


@query("o4_pick_due", _pick_sql(
    "stage, next_review NULLS FIRST, wrong_count DESC, qid", f"next_review IS NULL OR next_review <= {TODAY_SQL}", WQ, BOOK))
def o4_due(spark, sf):
    return _pick(spark, sf, "due", wrong=book(spark, sf), today=today())


@query("o4_pick_typeorder", _pick_sql("ord", "qtype = '多选'"))
def o4_typeorder(spark, sf):
    return _pick(spark, sf, "typeOrder", qtype="多选")


@query("o4_pick_typerandom", _pick_sql(f"sha1('{SEED}|' || bank || '|' || qid), qid", "qtype = '判断'"))
def o4_typerandom(spark, sf):
    return _pick(spark, sf, "typeRandom", qtype="判断", seed=SEED)


@query("o4_pick_typeyear", _pick_sql("year ASC NULLS LAST, ord", "qtype = '单选'"))
def o4_typeyear(spark, sf):
    return _pick(spark, sf, "typeYear", qtype="单选")


@query("p23_due_label", f"""WITH {BOOK}
SELECT bank, qid, CAST(date_diff('day', {TODAY_SQL}, next_review) AS BIGINT) AS days,
  CASE date_diff('day', {TODAY_SQL}, next_review) WHEN 0 THEN '今天' WHEN 1 THEN '明天' WHEN -1 THEN '昨天（逾期 1 天）'
  ELSE CASE WHEN next_review < {TODAY_SQL} THEN strftime(next_review, '%Y-%m-%d') || '（逾期 ' || date_diff('day', next_review, {TODAY_SQL}) || ' 天）'
       ELSE strftime(next_review, '%Y-%m-%d') END END AS label
FROM v_book""")
def p23(spark, sf):
    return book(spark, sf).select(
        "bank", "qid", F.datediff("next_review", today()).cast("bigint").alias("days"),
        due_label(F.col("next_review"), today()).alias("label"),
    )


MODE_CASE = (
    "CASE mode WHEN '1-URGENT' THEN 'order' WHEN '2-HIGH' THEN 'random' WHEN '3-MEDIUM' THEN 'typeOrder' WHEN '5-LOW' THEN 'due' ELSE mode END"
)


@query("p21_labels", f"""WITH {BOOK},
m AS (SELECT DISTINCT bank, qid, {MODE_CASE} AS mode FROM v_attempts)
SELECT bank, qid, m.mode || ':' || CASE m.mode WHEN 'order' THEN '顺序练习' WHEN 'random' THEN '随机练习'
         WHEN 'typeOrder' THEN '题型专项·顺序练习' WHEN 'due' THEN '今日艾宾浩斯复习' ELSE m.mode END
         || CASE WHEN m.mode = 'typeOrder' THEN '·' || qtype ELSE '' END AS mode_label,
       '阶段 ' || stage || '/6 · 连续答对 ' || correct_streak || '/7' AS stage_label,
       '答对后 +' || CASE stage WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 15 ELSE 30 END || ' 天' AS hint,
       CASE WHEN answer <> '' THEN answer WHEN explanation <> '' THEN explanation ELSE '（无参考答案）' END AS answer_text,
       qtype IN ('简答', '论述') AS subjective,
       CASE qtype WHEN '判断' THEN '答案须为正确或错误' WHEN '多选' THEN '可选多项'
            WHEN '单选' THEN '只选一项' ELSE '对照参考答案后自评' END AS input_hint
FROM v_book JOIN v_questions USING (bank, qid) JOIN m USING (bank, qid)""")
def p21(spark, sf):
    from itembank.functions.questions import answer_text, input_hint, is_subjective

    facts = attempts(spark, sf, session_columns=True)
    mode = F.col("mode")
    for raw, name in (("1-URGENT", "order"), ("2-HIGH", "random"), ("3-MEDIUM", "typeOrder"), ("5-LOW", "due")):
        mode = F.when(F.col("mode") == raw, name).otherwise(mode)
    modes = facts.select("bank", "qid", mode.alias("mode")).distinct()
    rows = book(spark, sf).join(questions(spark, sf), ["bank", "qid"]).join(modes, ["bank", "qid"])
    typed = F.when(F.col("mode") == "typeOrder", F.col("qtype")).otherwise("")
    return rows.select(
        "bank", "qid", F.concat("mode", F.lit(":"), mode_name(F.col("mode"), typed)).alias("mode_label"),
        stage_text(F.col("stage"), F.col("correct_streak")).alias("stage_label"),
        next_review_hint(F.col("stage")).alias("hint"),
        answer_text(F.col("answer"), F.col("explanation")).alias("answer_text"),
        is_subjective(F.col("qtype")).alias("subjective"),
        input_hint(F.col("qtype")).alias("input_hint"),
    )
