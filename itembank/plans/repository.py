"""Bank repository queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions.questions import review_line
from itembank.functions.text import bank_name
from itembank.operators import repository as B
from itembank.operators.sheet import practice_sheet
from itembank.plans.registry import query
from itembank.plans.review import ORDER, book, favorites
from itembank.plans.sqlviews import A, BOOK, FAV, Q, day, ts
from itembank.sources.tables import attempts, questions, table

TS = "yyyy-MM-dd HH:mm:ss"
NOW = "2026-01-01 00:00:00"


@query("s6_import_upsert", f"""
WITH o AS (SELECT source AS name, source || '.txt' AS file_name, 'txt' AS file_type, '2024-05-05 08:00:00' AS imported_at,
            count(*) AS question_count, CAST(sum(n_chars) AS BIGINT) AS total_units, '' AS warnings
           FROM documents WHERE lang = 'en' GROUP BY source),
n AS (SELECT source || CASE WHEN lang = 'es' THEN '_es' ELSE '' END AS name, CASE WHEN min(lang) = 'de' THEN '' ELSE min(lang) || '.md' END AS file_name,
        CASE WHEN min(lang) = 'de' THEN '' ELSE 'md' END AS file_type, count(*) AS question_count, CAST(sum(n_chars) AS BIGINT) AS total_units
      FROM documents WHERE lang <> 'en' GROUP BY 1, source),
w AS (SELECT name, string_agg(warning, chr(10) ORDER BY doc_id) AS warnings FROM (
        SELECT source || CASE WHEN lang = 'es' THEN '_es' ELSE '' END AS name, doc_id, 'short text ' || doc_id AS warning,
          row_number() OVER (PARTITION BY source || CASE WHEN lang = 'es' THEN '_es' ELSE '' END ORDER BY doc_id) AS rn
        FROM documents WHERE lang <> 'en' AND n_chars < 2000) WHERE rn <= 20 GROUP BY name)
SELECT coalesce(n.name, o.name) AS name,
  CASE WHEN n.file_name <> '' THEN n.file_name ELSE coalesce(o.file_name, '') END AS file_name,
  CASE WHEN n.file_type <> '' THEN n.file_type ELSE coalesce(o.file_type, '') END AS file_type,
  coalesce(o.imported_at, '{NOW}') AS imported_at,
  CASE WHEN n.name IS NOT NULL THEN '{NOW}' ELSE o.imported_at END AS updated_at,
  CASE WHEN n.name IS NOT NULL THEN '{NOW}' ELSE o.imported_at END AS last_used,
  coalesce(n.question_count, o.question_count) AS question_count, coalesce(n.total_units, o.total_units) AS total_units,
  CASE WHEN n.name IS NOT NULL THEN coalesce(w.warnings, '') ELSE o.warnings END AS warnings
FROM o FULL JOIN n ON o.name = n.name LEFT JOIN w ON n.name = w.name""")
def s6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    old = docs.filter("lang = 'en'").groupBy(F.col("source").alias("name")).agg(
        F.count("*").alias("question_count"), F.sum("n_chars").alias("total_units")
    ).select(
        "name", F.concat("name", F.lit(".txt")).alias("file_name"), F.lit("txt").alias("file_type"),
        F.lit("2024-05-05 08:00:00").alias("imported_at"), F.lit("2024-05-05 08:00:00").alias("updated_at"),
        F.lit("2024-05-05 08:00:00").alias("last_used"), "question_count", "total_units", F.lit("").alias("warnings"),
    )
    other = docs.filter("lang <> 'en'").withColumn(
        "name", F.concat("source", F.when(F.col("lang") == "es", "_es").otherwise(""))
    )
    parsed = other.groupBy("name").agg(
        F.min("lang").alias("lang"), F.count("*").alias("question_count"), F.sum("n_chars").alias("total_units")
    ).select(
        "name", F.when(F.col("lang") == "de", "").otherwise(F.concat("lang", F.lit(".md"))).alias("file_name"),
        F.when(F.col("lang") == "de", "").otherwise("md").alias("file_type"), "question_count", "total_units",
    )
    warnings = other.filter("n_chars < 2000").select(
        "name", F.col("doc_id").alias("ord"), F.concat(F.lit("short text "), F.col("doc_id").cast("string")).alias("warning")
    )
    return B.import_banks(old, parsed, warnings, F.lit(NOW))


@query("s6_replace_questions", f"""WITH {Q},
n AS (SELECT bank, 'new' || qid AS qid, stem, 'auto' AS source FROM v_questions WHERE bank < 'Brand#2' AND year IS NULL)
SELECT bank, qid, stem, source FROM n
UNION ALL SELECT bank, qid, stem, source FROM v_questions WHERE bank NOT IN (SELECT bank FROM n) OR source = 'manual'""")
def s6_questions(spark, sf):
    q = questions(spark, sf).select("bank", "qid", "stem", "source", "year")
    parsed = q.filter("bank < 'Brand#2' and year is null").select(
        "bank", F.concat(F.lit("new"), "qid").alias("qid"), "stem", F.lit("auto").alias("source")
    )
    return B.replace_questions(q.drop("year"), parsed, keep_manual=True)


@query("s7_keyed_upsert", f"""WITH {A},
u AS (SELECT bank, qid, answer AS value, TIMESTAMP '1990-01-01' AS put_at, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS tie FROM v_questions
      UNION ALL SELECT bank, qid, user_answer, answered_at, seq, tie FROM v_attempts),
r AS (SELECT *, row_number() OVER (PARTITION BY bank, qid ORDER BY put_at DESC, seq DESC, tie DESC) AS rn FROM u)
SELECT bank, qid, value, {ts('put_at')} AS put_at, seq FROM r WHERE rn = 1""")
def s7(spark, sf):
    zero = F.lit(0).cast("bigint")
    base = questions(spark, sf).select(
        "bank", "qid", F.col("answer").alias("value"), F.lit("1990-01-01").cast("timestamp").alias("put_at"),
        zero.alias("seq"), zero.alias("tie"),
    )
    puts = attempts(spark, sf).select("bank", "qid", F.col("user_answer").alias("value"), F.col("answered_at").alias("put_at"), "seq", "tie")
    out = B.keyed_put(base, puts, ["bank", "qid"], ["put_at", "seq", "tie"])
    return out.select("bank", "qid", "value", F.date_format("put_at", TS).alias("put_at"), "seq")


@query("s8_bank_lookup", f"""WITH {Q} SELECT bank, qid, stem, qtype, answer FROM v_questions WHERE bank = 'Brand#7'""")
def s8(spark, sf):
    return B.for_bank(questions(spark, sf), "Brand#7").select("bank", "qid", "stem", "qtype", "answer")


@query("s9_cascade_delete", f"""WITH {BOOK} {FAV},
d AS (SELECT bank FROM v_questions GROUP BY bank HAVING count(*) FILTER (WHERE source = 'manual') > count(*) * 0.17)
SELECT 'questions' AS tbl, bank, qid FROM v_questions WHERE bank NOT IN (SELECT bank FROM d)
UNION ALL SELECT 'wrong', bank, qid FROM v_book WHERE bank NOT IN (SELECT bank FROM d)
UNION ALL SELECT 'favorites', bank, qid FROM v_fav WHERE bank NOT IN (SELECT bank FROM d)""")
def s9(spark, sf):
    q = questions(spark, sf).select("bank", "qid", "source")
    doomed = q.groupBy("bank").agg(F.count_if(F.col("source") == "manual").alias("m"), F.count("*").alias("n")).filter("m > n * 0.17")
    left = B.cascade_delete(
        {"questions": q, "wrong": book(spark, sf), "favorites": favorites(spark, sf)}, doomed
    )
    parts = [t.select(F.lit(name).alias("tbl"), "bank", "qid") for name, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s10_replace_partition", f"""WITH {A} {FAV},
n AS (SELECT bank, qid, TIMESTAMP '{NOW}' AS added_at FROM v_questions WHERE source = 'manual' AND bank > 'Brand#2')
SELECT bank, qid, {ts('added_at')} AS added_at FROM n
UNION ALL SELECT bank, qid, {ts('fav_at')} FROM v_fav WHERE bank NOT IN (SELECT bank FROM n)""")
def s10(spark, sf):
    new = questions(spark, sf).filter("source = 'manual' and bank > 'Brand#2'").select(
        "bank", "qid", F.lit(NOW).cast("timestamp").alias("added_at")
    )
    out = B.replace_bank_rows(favorites(spark, sf), new)
    return out.select("bank", "qid", F.date_format("added_at", TS).alias("added_at"))


@query("s11_last_used", f"""WITH {A}, u AS (SELECT bank AS name, max(answered_at) AS last_used FROM v_attempts GROUP BY bank)
SELECT name FROM u ORDER BY last_used DESC, name DESC LIMIT 1""")
def s11(spark, sf):
    facts = attempts(spark, sf).select("bank", F.col("answered_at").alias("used_at"))
    banks = questions(spark, sf).select(F.col("bank").alias("name")).distinct().withColumn(
        "last_used", F.lit("1990-01-01").cast("timestamp")
    )
    return B.last_used(B.touch(banks, facts))


@query("s16_bank_name", """
WITH f AS (SELECT page_id, regexp_replace(url, '^.*/', '') AS name FROM pages)
SELECT page_id, name, CASE WHEN b = '' THEN '未命名题库' ELSE b END AS bank, CASE WHEN b = '' THEN '粘贴知识点' ELSE b END || '_自动出题' AS generated_bank,
       CASE WHEN b = '' THEN '未命名题库' ELSE b END || '_AI' AS recognised_bank
FROM (SELECT *, trim(regexp_replace(name, '\\.[^.]+$', '')) AS b FROM f)""")
def s16(spark, sf):
    name = F.regexp_replace("url", r"^.*/", "")
    return table(spark, sf, "pages").select(
        "page_id", name.alias("name"), bank_name(name).alias("bank"),
        bank_name(name, "粘贴知识点", "_自动出题").alias("generated_bank"), bank_name(name, suffix="_AI").alias("recognised_bank"),
    )


def _esc_sql(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("s12_practice_sheet", f"""WITH {BOOK},
s AS (SELECT q.*, wrong_count, correct_streak, stage, {day('next_review')} AS nr, row_number() OVER (PARTITION BY bank ORDER BY q.ord) AS n
      FROM v_questions q JOIN v_book USING (bank, qid)),
c AS (SELECT bank, qtype, count(*) AS n, CASE qtype WHEN '单选' THEN 0 WHEN '多选' THEN 1 WHEN '判断' THEN 2 WHEN '简答' THEN 3 ELSE 4 END AS r FROM s GROUP BY bank, qtype)
SELECT bank, 0 AS section, CAST(0 AS BIGINT) AS ord, '<h1 class="sheet-title">' || {_esc_sql('bank')} || '</h1><p class="sheet-meta">总题数：' || count(*) || ' 题</p>' AS html FROM s GROUP BY bank
UNION ALL SELECT bank, 1, r, '<li>' || qtype || '题 ' || n || ' 题</li>' FROM c
UNION ALL SELECT bank, 2, n, '<li class="sheet-item">' || CASE WHEN n > 1 THEN '<div class="sheet-sep"></div>' ELSE '' END ||
  '<p class="sheet-stem">' || n || '.【' || qtype || '题】' || {_esc_sql('stem')} || '</p><p class="sheet-opt">A. ' || {_esc_sql('opt_a')} ||
  '</p><p class="sheet-opt">B. ' || opt_b || '</p><p class="sheet-opt">C. ' || opt_c || '</p><p class="sheet-opt">D. ' || opt_d ||
  '</p><p class="sheet-answer">答案：' || answer || '</p><p class="sheet-expl">解析：' || CASE WHEN explanation = '' THEN '（无）' ELSE explanation END ||
  '</p><p class="sheet-review">错误次数：' || wrong_count || '　连续答对：' || correct_streak || '　复习阶段：' || stage || '　下次复习：' || nr || '</p></li>' FROM s""")
def s12(spark, sf):
    return practice_sheet(
        questions(spark, sf).join(book(spark, sf), ["bank", "qid"]),
        review_line(F.col("wrong_count"), F.col("correct_streak"), F.col("stage"), F.date_format("next_review", "yyyy-MM-dd")),
    )


@query("j1_bank_overview", f"""WITH {BOOK} {FAV},
u AS (SELECT bank, max(answered_at) AS last_used FROM v_attempts GROUP BY bank),
q AS (SELECT bank, count(*) AS question_count, count(*) FILTER (WHERE source = 'manual') AS manual_count FROM v_questions GROUP BY bank),
w AS (SELECT bank, count(*) AS n FROM v_book GROUP BY bank), f AS (SELECT bank, count(*) AS n FROM v_fav GROUP BY bank)
SELECT bank, question_count, manual_count, coalesce(w.n, 0) AS wrong_count, coalesce(f.n, 0) AS favorite_count,
  {ts('last_used')} AS last_used FROM q LEFT JOIN u USING (bank) LEFT JOIN w USING (bank) LEFT JOIN f USING (bank)""")
def j1(spark, sf):
    facts = attempts(spark, sf)
    banks = facts.groupBy(F.col("bank").alias("name")).agg(F.max("answered_at").alias("last_used"))
    out = B.bank_overview(banks, questions(spark, sf), book(spark, sf), favorites(spark, sf))
    return out.withColumn("last_used", F.date_format("last_used", TS)).orderBy(F.desc("last_used"), "bank")


@query("j5_manual_upsert", f"""WITH {Q},
i0 AS (SELECT bank, ord, CASE WHEN year IS NULL THEN replace(stem, ' ', ' - ') || '？' ELSE stem || ' extra' END AS stem, answer || '!' AS answer
       FROM v_questions WHERE source = 'manual'),
i1 AS (SELECT *, regexp_replace(stem, '[\\s，。、,.;；:：（）()\\[\\]？?！!\\-_]+', '', 'g') AS key FROM i0),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, key ORDER BY ord DESC) AS rn FROM i1) WHERE rn = 1),
k AS (SELECT bank, ord, stem, answer, replace(stem, ' ', '') AS key FROM v_questions),
f AS (SELECT bank, key, min(ord) AS first_ord FROM k GROUP BY bank, key),
h AS (SELECT i.bank, i.ord, i.stem, i.answer, i.key, f.first_ord FROM i LEFT JOIN f ON i.bank = f.bank AND i.key = f.key),
e AS (SELECT bank, max(ord) AS last_ord FROM v_questions GROUP BY bank)
SELECT bank, ord, stem, answer, 'kept' AS action FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.bank = k.bank AND h.first_ord = k.ord)
UNION ALL SELECT bank, first_ord, stem, answer, 'replaced' FROM h WHERE first_ord IS NOT NULL
UNION ALL SELECT bank, last_ord + row_number() OVER (PARTITION BY bank ORDER BY ord, key), stem, answer, 'added' FROM h JOIN e USING (bank) WHERE first_ord IS NULL""")
def j5(spark, sf):
    q = questions(spark, sf)
    manual = q.filter("source = 'manual'").select(
        "bank", "ord",
        F.when(F.col("year").isNull(), F.concat(F.replace("stem", F.lit(" "), F.lit(" - ")), F.lit("？")))
        .otherwise(F.concat("stem", F.lit(" extra"))).alias("stem"),
        F.concat("answer", F.lit("!")).alias("answer"),
    )
    return B.upsert_manual(q, manual)


@query("j6_backfill", f"""WITH {BOOK},
t AS (SELECT bank, qid, CASE WHEN year IS NULL THEN ' ' ELSE ' because ' || stem || ' ' END AS text FROM v_questions WHERE explanation = '')
SELECT 'questions' AS tbl, q.bank, q.qid, coalesce(nullif(trim(t.text), ''), q.explanation) AS explanation FROM v_questions q LEFT JOIN t USING (bank, qid)
UNION ALL SELECT 'wrong', b.bank, b.qid, coalesce(nullif(trim(t.text), ''), q.explanation) FROM v_book b JOIN v_questions q USING (bank, qid) LEFT JOIN t USING (bank, qid)""")
def j6(spark, sf):
    q = questions(spark, sf)
    texts = q.filter("explanation = ''").select(
        "bank", "qid", F.when(F.col("year").isNull(), " ").otherwise(F.concat(F.lit(" because "), "stem", F.lit(" "))).alias("text")
    )
    rows = q.select("bank", "qid", "explanation")
    wrong = book(spark, sf).select("bank", "qid").join(rows, ["bank", "qid"])
    return B.fill_explanations(rows, texts).withColumn("tbl", F.lit("questions")).unionByName(
        B.fill_explanations(wrong, texts).withColumn("tbl", F.lit("wrong"))
    )


@query("j11_untouched", f"""WITH {BOOK}
SELECT bank, qid, stem FROM v_questions q WHERE NOT EXISTS (SELECT 1 FROM v_book b WHERE b.bank = q.bank AND b.qid = q.qid)""")
def j11(spark, sf):
    return questions(spark, sf).select("bank", "qid", "stem").join(book(spark, sf), ["bank", "qid"], "left_anti")


@query("u2_toggle", f"WITH {A} {FAV} SELECT bank, qid, {ts('fav_at')} AS added_at FROM v_fav")
def u2(spark, sf):
    return favorites(spark, sf).withColumn("added_at", F.date_format("added_at", TS))


@query("u4_book_sets", f"""WITH {BOOK} {FAV}
SELECT coalesce(b.bank, f.bank) AS bank, coalesce(b.qid, f.qid) AS qid,
  CASE WHEN b.qid IS NULL THEN 'favorite_only' WHEN f.qid IS NULL THEN 'wrong_only' ELSE 'both' END AS side
FROM v_book b FULL JOIN v_fav f ON b.bank = f.bank AND b.qid = f.qid""")
def u4(spark, sf):
    return B.book_sets(book(spark, sf), favorites(spark, sf))


@query("w4_nth_manual", f"""WITH {Q},
m AS (SELECT bank, qid, row_number() OVER (PARTITION BY bank ORDER BY ord) - 1 AS manual_index FROM v_questions WHERE source = 'manual')
SELECT q.bank, q.qid, q.source FROM v_questions q WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.bank = q.bank AND m.qid = q.qid AND manual_index = 2)""")
def w4(spark, sf):
    q = questions(spark, sf)
    requests = q.select("bank").distinct().withColumn("manual_index", F.lit(2).cast("bigint"))
    return B.delete_manual(q, requests).select("bank", "qid", "source")
