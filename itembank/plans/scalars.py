"""Scalar projections checked over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import questions as X
from itembank.functions import text as T
from itembank.plans.registry import query
from itembank.plans.sqltext import (
    q as lit, rep, rep1, sbullets, schoice, sclean, scollapse, scompact, sjudge, snormws, sqid, sstem, stoken, stopic, strim,
    strim_answer, syear, SWS,
)
from itembank.plans.sqlviews import QTYPE
from itembank.sources.tables import _pick, spread, table
from itembank.constants import QUESTION_TYPES


def pattern_col(templates: list[str]) -> Column:
    """A text per part: one of the templates, with ``{n}`` standing for the part's name."""
    return F.replace(_pick(F.col("p_partkey") % len(templates), templates), F.lit("{n}"), F.col("p_name"))


def pattern_sql(templates: list[str]) -> str:
    items = ", ".join(lit(t) for t in templates)
    return f"replace(list_extract([{items}], CAST(p_partkey % {len(templates)} + 1 AS INT)), '{{n}}', p_name)"


def _parts(spark, sf, templates: list[str]) -> DataFrame:
    return table(spark, sf, "part").withColumn("raw", pattern_col(templates))


def _parts_sql(templates: list[str]) -> str:
    return f"(SELECT *, {pattern_sql(templates)} AS raw FROM part)"


def _docs(spark, sf) -> DataFrame:
    """Document texts with the odd spaces and marks that real files carry."""
    t = F.replace(F.replace("text", F.lit(", "), F.lit(",　")), F.lit(". "), F.lit(". ​ "))
    return spread(table(spark, sf, "documents")).select("doc_id", F.concat(F.lit("﻿"), t, F.lit(" \r\n")).alias("text"))


DOCS = (
    "(SELECT doc_id, chr(65279) || replace(replace(text, ', ', ',' || chr(12288)), '. ', '.' || chr(160) || chr(8203) || ' ') "
    "|| chr(8195) || chr(13) || chr(10) AS text FROM documents)"
)


@query("p1_normalize_stem", f"SELECT doc_id, {sstem('text')} AS stem FROM {DOCS}")
def p1(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_stem(F.col("text")).alias("stem"))


STEMS = ["{n}的 首都，是（ ）", "，。？", "【{n}】 - 🙂", "{n}"]


@query("p2_qid", f"""SELECT p_partkey, CASE WHEN {sstem('raw')} <> '' THEN {sqid('raw')} ELSE {sqid("p_brand || p_type")} END AS qid
FROM {_parts_sql(STEMS)} UNION ALL SELECT -1 - doc_id, {sqid('text')} FROM {DOCS}""")
def p2(spark, sf):
    options = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"))
    parts = _parts(spark, sf, STEMS).select("p_partkey", X.question_id(F.col("raw"), options).alias("qid"))
    docs = _docs(spark, sf).select((-1 - F.col("doc_id")).alias("p_partkey"), X.question_id(F.col("text")).alias("qid"))
    return parts.unionByName(docs)


CHOICES = ["ba", "D、A、C", "正确", "{n}", "（b）", "AJK", "a a B", ""]


@query("p3_choice_norm", f"SELECT p_partkey, raw, {schoice('raw')} AS letters FROM {_parts_sql(CHOICES)}")
def p3(spark, sf):
    return _parts(spark, sf, CHOICES).select("p_partkey", "raw", X.normalize_choice(F.col("raw")).alias("letters"))


JUDGES = ["√", "错", " t ", "maybe", "对的", "Y e s", "no", "{n}", "✗", "1", "0", "　正确　", "否", ""]


@query("p4_judge_norm", f"SELECT p_partkey, raw, {sjudge('raw')} AS verdict FROM {_parts_sql(JUDGES)}")
def p4(spark, sf):
    return _parts(spark, sf, JUDGES).select("p_partkey", "raw", X.normalize_judge(F.col("raw")).alias("verdict"))


ORDER_TEXT = "'no ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y年%m月') || ' until ' || (year(o_orderdate) - o_custkey % 7) || ', 12019, 1850'"


@query("p5_year", f"SELECT key, coalesce({syear('text')}, 0) AS year FROM (SELECT o_orderkey AS key, {ORDER_TEXT} AS text FROM orders UNION ALL SELECT -1 - doc_id, text FROM documents)")
def p5(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(
        F.lit("no "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy年MM月"), F.lit(" until "),
        (F.year("o_orderdate") - F.col("o_custkey") % 7).cast("string"), F.lit(", 12019, 1850"),
    )
    rows = o.select(F.col("o_orderkey").alias("key"), text.alias("text")).unionByName(
        table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("key"), "text")
    )
    return rows.select("key", F.coalesce(T.extract_year(F.col("text")), F.lit(0)).alias("year"))


TOPICS = ["【第一章 {n}】题干（甲）", "（{n}）[x]", "{n}[ 乙 ]", "（太长的主题词不会被识别出来）{n}", "{n}", "【】（{n}）"]


@query("p6_topic", f"SELECT p_partkey, raw, {stopic('raw')} AS topic FROM {_parts_sql(TOPICS)}")
def p6(spark, sf):
    return _parts(spark, sf, TOPICS).select("p_partkey", "raw", T.extract_topic(F.col("raw")).alias("topic"))


P7_STEMS = ["  {n} 2019年与2021年 ", "【{n}】 x", "{n}"]
P7_ANSWERS = ["b a", "√", "A", "{n}", ""]
P7_SQL = f"""
WITH r AS (SELECT p_partkey, p_size, p_brand, p_type, {pattern_sql(P7_STEMS)} AS stem0, {QTYPE} AS qtype, {pattern_sql(P7_ANSWERS)} AS ans, p_type AS t FROM part),
c AS (SELECT p_partkey, qtype, {strim('stem0')} AS stem, {strim('ans')} AS a, CASE WHEN p_size % 2 = 0 THEN '正确' ELSE p_brand END AS oa, p_type AS ob FROM r)
SELECT p_partkey, stem, qtype, 'A. ' || oa || chr(10) || 'B. ' || ob AS options,
  CASE WHEN qtype = '判断' THEN coalesce(nullif({sjudge('a')}, ''), nullif(CASE WHEN a = 'A' THEN {sjudge('oa')} WHEN a = 'B' THEN {sjudge('ob')} ELSE '' END, ''), a)
       WHEN qtype IN ('单选', '多选') THEN coalesce(nullif({schoice('a')}, ''), a) ELSE a END AS answer,
  coalesce({syear('stem')}, 0) AS year, {stopic('stem')} AS topic, {sqid('stem')} AS qid, stem AS raw
FROM c"""


@query("p7_make_question", P7_SQL)
def p7(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(
        "p_partkey", pattern_col(P7_STEMS).alias("stem"), _pick(F.col("p_size") % 5, QUESTION_TYPES).alias("qtype"),
        F.create_map(
            F.lit("a"), F.when(F.col("p_size") % 2 == 0, " 正确 ").otherwise(F.col("p_brand")),
            F.lit("B"), F.col("p_type"), F.lit("C"), F.lit("  "), F.lit("Z"), F.col("p_name"),
        ).alias("options"),
        pattern_col(P7_ANSWERS).alias("answer"), F.lit("").alias("explanation"), F.lit("x").alias("source"),
        F.lit(None).cast("int").alias("year"), F.lit("").alias("topic"), F.lit("").alias("raw"),
    )
    out = X.canonical_question(rows)
    return out.select(
        "p_partkey", "stem", "qtype", X.options_text(F.col("options")).alias("options"), "answer",
        F.coalesce("year", F.lit(0)).alias("year"), "topic", "qid", "raw",
    )


@query("p8_sorted_options", "SELECT p_partkey, 'A. ' || p_brand || '|B. ' || p_type || '|D. ' || p_name AS options FROM part")
def p8(spark, sf):
    m = F.create_map(F.lit("D"), F.col("p_name"), F.lit("B"), F.col("p_type"), F.lit("A"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", X.options_text(m, "|").alias("options"))


@query("p9_location", """
WITH r AS (SELECT p_partkey, p_size % 3 AS page, p_size % 4 AS line, p_size % 2 AS para, CASE WHEN p_type = 'PROMO' THEN 'manual' ELSE 'auto' END AS source FROM part)
SELECT p_partkey,
  CASE WHEN page <> 0 AND line <> 0 THEN '第 ' || page || ' 页第 ' || line || ' 行' WHEN page <> 0 THEN '第 ' || page || ' 页'
       WHEN para <> 0 THEN '第 ' || para || ' 段' WHEN line <> 0 THEN '第 ' || line || ' 行' WHEN source = 'manual' THEN '手动补录' ELSE '位置未记录' END AS location,
  CASE WHEN page <> 0 THEN '第' || page || '页第' || line || '行' WHEN para <> 0 THEN '第' || para || '段' WHEN line <> 0 THEN '第' || line || '行' ELSE '未知位置' END AS parse_position,
  CASE WHEN page <> 0 AND line <> 0 THEN '第' || page || '页第' || line || '行' WHEN page <> 0 THEN '第' || page || '页' WHEN line <> 0 THEN '第' || line || '行' ELSE '位置未记录' END AS log_position,
  CASE WHEN page <> 0 OR line <> 0 OR para <> 0 THEN '第 ' || CASE WHEN page <> 0 THEN page ELSE 1 END || ' 页第 ' || CASE WHEN line <> 0 THEN line ELSE para END || ' 行' ELSE '位置未记录' END AS session_location
FROM r""")
def p9(spark, sf):
    size = F.col("p_size")
    page, line, para = size % 3, size % 4, size % 2
    source = F.when(F.col("p_type") == "PROMO", "manual").otherwise("auto")
    return table(spark, sf, "part").select(
        "p_partkey", X.location_text(page, line, para, source).alias("location"),
        X.position_label(page, line, para).alias("parse_position"), X.log_position(page, line).alias("log_position"),
        X.session_location(page, line, para).alias("session_location"),
    )


@query("p11_clean_text", f"""SELECT doc_id, {sclean('text')} AS cleaned, {snormws('text')} AS spaced,
length({scompact('text')}) AS compact_length FROM {DOCS}""")
def p11(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", T.clean_text(t).alias("cleaned"), T.normalize_whitespace(t).alias("spaced"),
        T.compact_len(t).cast("bigint").alias("compact_length"),
    )


BULLETED = ["• 1. {n}", "3.14 {n}", "（2） ① {n}", "一、{n}", "- * > {n}", "十二、中{n}", "1）2）3）4） {n}", "{n}"]


@query("p12_strip_bullets", f"SELECT p_partkey, raw, {sbullets('raw')} AS text FROM {_parts_sql(BULLETED)} UNION ALL SELECT -1 - doc_id, '', {sbullets('text')} FROM {DOCS}")
def p12(spark, sf):
    parts = _parts(spark, sf, BULLETED).select("p_partkey", "raw", T.strip_bullets(F.col("raw")).alias("text"))
    docs = _docs(spark, sf).select((-1 - F.col("doc_id")).alias("p_partkey"), F.lit("").alias("raw"), T.strip_bullets(F.col("text")).alias("text"))
    return parts.unionByName(docs)


SCORED = ["[2分] {n}", "（共计 10 分）{n}", "【总 5分】{n}", "{n} [2分]", " ( 3 分 ) {n}", "{n}"]
SCORE_SQL = rf"^[{SWS}]*[\[【（(][{SWS}]*(?:共[{SWS}]*计?|总计?)?[{SWS}]*\d{{1,3}}[{SWS}]*分[{SWS}]*[\]】）)][{SWS}]*"


@query("p13_strip_score", f"SELECT p_partkey, raw, {strim(rep1('raw', SCORE_SQL))} AS text FROM {_parts_sql(SCORED)}")
def p13(spark, sf):
    return _parts(spark, sf, SCORED).select("p_partkey", "raw", T.strip_score(F.col("raw")).alias("text"))


PREFIXED = ["A. {n}", "（b）“{n}”", "AA {n}", "C，{n}", "答案：{n}", "参考 答 案 是 b", "选项：A", "h:{n}", "j、{n}", "'{n}'", "{n}"]
_OPT = strim(rep1(rep1(rep1(rep1(
    "raw", rf"^[（(][{SWS}]*[A-Ha-h][{SWS}]*[)）][{SWS}]*"), rf"^[A-Ha-h][{SWS}]*[.、．)）:：,，][{SWS}]*"),
    rf"^[\"'“”‘’「」『』][{SWS}]*"), rf"[\"'“”‘’「」『』][{SWS}]*$"))
_ANS = strim(rep1(rep1(
    "raw", rf"^[{SWS}]*(?:参考|正确|标准|参考正确)?[{SWS}]*答[{SWS}]*案[{SWS}]*[:：是为]*[{SWS}]*"), rf"^[{SWS}]*(?:选项|选择)[{SWS}]*[:：]?[{SWS}]*"))
_FORM = strim(rep1("raw", rf"^[{SWS}]*[（(]?[{SWS}]*[A-Ja-j][{SWS}]*[）).、．,，:：][{SWS}]*"))


@query("p14_strip_prefix", f"SELECT p_partkey, raw, {_OPT} AS option_text, {_ANS} AS answer_text, {_FORM} AS form_text FROM {_parts_sql(PREFIXED)}")
def p14(spark, sf):
    raw = F.col("raw")
    return _parts(spark, sf, PREFIXED).select(
        "p_partkey", "raw", X.strip_option_prefix(raw).alias("option_text"), X.strip_answer_prefix(raw).alias("answer_text"),
        X.strip_form_option_prefix(raw).alias("form_text"),
    )


TOKENS = ["A", "（B）", "A、C", "D。故选D", "对", "√", "maybe", "ACD", "b , a", "A B C D E F G", "{n}", "abcdefgh", "错误的", "。；A）", "a/b", "F", "bad {n}", "对错是否对", ""]


@query("p15_answer_token", f"SELECT p_partkey, raw, {stoken('v')} AS token FROM (SELECT *, {strim_answer('raw')} AS v FROM {_parts_sql(TOKENS)})")
def p15(spark, sf):
    return _parts(spark, sf, TOKENS).select("p_partkey", "raw", X.answer_token(F.col("raw")).alias("token"))


P16 = """
WITH r AS (SELECT p_partkey, p_size, p_name,
    CASE p_partkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['正确', '错误'] WHEN 2 THEN [p_brand] WHEN 3 THEN [p_brand, p_type, p_name] WHEN 4 THEN ['对', '正确'] ELSE ['是', ''] END AS opts,
    list_extract(['A', 'AB', '√', '', 'x', 'ACD', '对的'], CAST(p_partkey % 7 + 1 AS INT)) AS token,
    CASE WHEN p_size % 9 = 0 THEN '论述' ELSE '' END AS explicit,
    CASE WHEN p_size % 2 = 0 THEN '试述 ' || p_name ELSE p_name END AS stem FROM part),
w AS (SELECT *, list_transform(opts, lambda o: {j}) AS words, {c} AS letters FROM r)
SELECT p_partkey, CASE WHEN explicit <> '' THEN explicit
  WHEN len(opts) BETWEEN 1 AND 4 AND NOT list_contains(words, '') AND len(list_distinct(words)) = len(words) THEN '判断'
  WHEN token <> '' AND letters = '' AND token IN {lits} THEN '判断'
  WHEN len(opts) >= 2 OR (len(opts) = 0 AND letters <> '') THEN CASE WHEN length(letters) >= 2 THEN '多选' ELSE '单选' END
  WHEN len(opts) = 1 THEN '单选' WHEN stem LIKE '%试述%' THEN '论述' ELSE '简答' END AS qtype FROM w"""
from itembank.plans.sqltext import LITERAL_SQL  # noqa: E402


@query("p16_decide_type", P16.replace("{j}", sjudge("o")).replace("{c}", schoice("token")).replace("{lits}", LITERAL_SQL))
def p16(spark, sf):
    key = F.col("p_partkey")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    m = lambda *v: F.map_from_arrays(F.array(*[F.lit(x) for x in "ABC"[: len(v)]]), F.array(*v))
    options = (
        F.when(key % 6 == 0, empty).when(key % 6 == 1, m(F.lit("正确"), F.lit("错误"))).when(key % 6 == 2, m(F.col("p_brand")))
        .when(key % 6 == 3, m(F.col("p_brand"), F.col("p_type"), F.col("p_name"))).when(key % 6 == 4, m(F.lit("对"), F.lit("正确")))
        .otherwise(m(F.lit("是"), F.lit("")))
    )
    token = _pick(key % 7, ["A", "AB", "√", "", "x", "ACD", "对的"])
    explicit = F.when(F.col("p_size") % 9 == 0, "论述").otherwise("")
    stem = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("试述 "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.decide_type(stem, options, token, explicit).alias("qtype"))


KINDS = ["单选题", "Multi Choice", "true_false", "填 空", "essay", "multiple", "判断", "choice", "", "{n}", "不定项"]


@query("p17_llm_type", f"""
WITH r AS (SELECT p_partkey, p_size, raw, {scompact('lower(raw)')} AS s, CASE WHEN p_size % 3 = 0 THEN 'AB' WHEN p_size % 3 = 1 THEN 'A' ELSE '对' END AS ans,
  p_size % 2 * 2 AS n FROM {_parts_sql(KINDS)})
SELECT p_partkey, raw, CASE WHEN trim(raw) IN ('单选','多选','判断','简答','论述') THEN trim(raw)
  WHEN regexp_matches(s, '多选|多项选择|不定项|multichoice|multi_choice|multiple') THEN '多选' WHEN regexp_matches(s, '判断|对错|正误|truefalse|true_false|boolean') THEN '判断'
  WHEN regexp_matches(s, '简答|简述|填空|shortanswer|short_answer|blank|fill') THEN '简答' WHEN regexp_matches(s, '论述|问答|essay|discuss') THEN '论述'
  WHEN regexp_matches(s, '单选|单项选择|选择|choice') THEN '单选'
  WHEN n >= 2 THEN CASE WHEN length({schoice('ans')}) > 1 THEN '多选' ELSE '单选' END WHEN {sjudge('ans')} <> '' THEN '判断' ELSE '简答' END AS qtype FROM r""")
def p17(spark, sf):
    size = F.col("p_size")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    options = F.when(size % 2 == 1, F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y"))).otherwise(empty)
    answer = F.when(size % 3 == 0, "AB").when(size % 3 == 1, "A").otherwise("对")
    return _parts(spark, sf, KINDS).select("p_partkey", "raw", X.normalize_type(F.col("raw"), options, answer).alias("qtype"))


INPUTS = ["b", "AB", "BA", "对", "T", "错误", " ", "A、C", "{n}", "Z", "E", "✓", "a"]
GRADE_SQL = f"""
WITH r AS (SELECT p_partkey, {QTYPE} AS qtype, p_type, p_brand, p_name, {pattern_sql(INPUTS)} AS raw,
  CASE p_size % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'AB' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '正确' ELSE '√' END ELSE p_name END AS answer FROM part),
s AS (SELECT *, {strim('raw')} AS u, {schoice(strim('raw'))} AS letters, {sjudge(strim('raw'))} AS jn FROM r)"""


def _graded(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    answer = (
        F.when(size % 5 == 0, "B").when(size % 5 == 1, "AB")
        .when(size % 5 == 2, F.when(key % 2 == 0, "正确").otherwise("√")).otherwise(F.col("p_name"))
    )
    return _parts(spark, sf, INPUTS).select(
        "p_partkey", "raw", _pick(size % 5, QUESTION_TYPES).alias("qtype"), answer.alias("answer"),
        F.create_map(F.lit("A"), F.lit("对"), F.lit("B"), F.lit("错"), F.lit("C"), F.col("p_brand"), F.lit("D"), F.col("p_type")).alias("options"),
    )


@query("p18_grade", GRADE_SQL + """
SELECT p_partkey, raw, CASE WHEN u = '' THEN false
  WHEN qtype = '判断' THEN CASE WHEN jn <> '' THEN jn = '正确' WHEN letters = 'A' THEN true ELSE false END
  WHEN qtype IN ('单选', '多选') THEN letters <> '' AND letters = answer ELSE u = answer END AS correct FROM s""")
def p18(spark, sf):
    return _graded(spark, sf).select(
        "p_partkey", "raw", X.grade(F.col("qtype"), F.col("answer"), F.col("options"), F.col("raw")).alias("correct")
    )


@query("p19_validate", GRADE_SQL + """,
v AS (SELECT *, CASE WHEN u = '' THEN NULL
  WHEN qtype = '判断' THEN CASE WHEN jn <> '' THEN jn WHEN letters IN ('A', 'B', 'C', 'D') THEN letters END
  WHEN qtype IN ('单选', '多选') THEN CASE WHEN letters <> '' AND NOT regexp_matches(letters, '[E-J]') AND NOT (qtype = '单选' AND length(letters) > 1) THEN letters END
  ELSE u END AS val FROM s)
SELECT p_partkey, raw, val IS NOT NULL AS ok, coalesce(val, '') AS value FROM v""")
def p19(spark, sf):
    v = X.validated(F.col("qtype"), F.col("options"), F.col("raw"))
    return _graded(spark, sf).select("p_partkey", "raw", v.alias("v")).select("p_partkey", "raw", "v.ok", "v.value")


@query("p20_manual_validate", GRADE_SQL + f""",
m AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS stem, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'ABCD' END AS keys FROM s),
n AS (SELECT *, regexp_extract_all({schoice('raw')}, '.') AS ls, {schoice('raw')} AS lraw FROM m),
o AS (SELECT *, list_filter(ls, lambda l: NOT contains(keys, l)) AS missing FROM n)
SELECT p_partkey, CASE WHEN stem = ' ' THEN '缺题干'
  WHEN qtype IN ('单选', '多选') AND keys = 'A' THEN '选择题的选项不足两个'
  WHEN qtype IN ('单选', '多选') AND lraw = '' THEN '缺答案字母'
  WHEN qtype IN ('单选', '多选') AND len(missing) > 0 THEN '答案 ' || missing[1] || ' 没有对应的选项'
  WHEN qtype = '单选' AND length(lraw) > 1 THEN '单选题只可有一个答案'
  WHEN qtype = '判断' AND jn = '' THEN '答案须为正确或错误' ELSE '' END AS reason FROM o""")
def p20(spark, sf):
    key = F.col("p_partkey")
    keep = F.when(key % 3 == 0, F.map_filter("options", lambda k, v: k == "A")).otherwise(F.col("options"))
    stem = F.when(key % 11 == 0, " ").otherwise("x")
    return _graded(spark, sf).select(
        "p_partkey", X.manual_reject_reason(stem, F.col("qtype"), keep, F.col("raw")).alias("reason")
    )


@query("p24_truncate", f"""SELECT doc_id, CASE WHEN length(c) > 60 THEN c[:60] || '…' ELSE c END AS cut,
  CASE WHEN length(text) > 60 THEN text[:60] || '…' ELSE text END AS short FROM (SELECT doc_id, text, {scollapse('text')} AS c FROM {DOCS})""")
def p24(spark, sf):
    return _docs(spark, sf).select("doc_id", T.cut(F.col("text"), 60).alias("cut"), T.truncate(F.col("text"), 60).alias("short"))


@query("p26_mask", """SELECT o_orderkey, CASE WHEN length(k) <= 8 THEN repeat('*', length(k)) ELSE k[:4] || '********' || right(k, 4) END AS masked
FROM (SELECT o_orderkey, trim(' ' || repeat('sk', CAST(o_custkey % 4 AS INT)) || CAST(o_orderkey AS VARCHAR) || ' ') AS k FROM orders)""")
def p26(spark, sf):
    k = F.concat(F.lit(" "), F.repeat(F.lit("sk"), (F.col("o_custkey") % 4).cast("int")), F.col("o_orderkey").cast("string"), F.lit(" "))
    return table(spark, sf, "orders").select("o_orderkey", T.mask_secret(k).alias("masked"))


_EXPL = rep1(strim(rep(rep("t", rf"[{SWS}]*\n[{SWS}]*", " "), rf"[{SWS}]{{2,}}", " ")), rf"^(解析|讲解|答案解析)[{SWS}]*[:：][{SWS}]*")


@query("p27_clean_explanation", f"""
WITH r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '解析： ' || text WHEN 1 THEN text ELSE ' 讲解:' || text || chr(10) || chr(10) || '  ' END AS t FROM conversations),
c AS (SELECT conv_id, turn, {_EXPL} AS s FROM r)
SELECT conv_id, turn, CASE WHEN length(s) > 300 THEN s[:300] || '…' ELSE s END AS explanation FROM c""")
def p27(spark, sf):
    mode = F.col("conv_id") % 4
    clean = F.when(mode == 0, F.concat(F.lit("解析： "), "text")).when(mode == 1, F.col("text")).otherwise(
        F.concat(F.lit(" 讲解:"), "text", F.lit("\n\n  "))
    )
    payload = F.to_json(F.struct(clean.alias("explanation")))
    fenced = F.concat(F.lit("```json\n"), payload, F.lit("\n```"))
    answer = F.when(mode == 2, payload).when(mode == 0, fenced).otherwise(clean)
    return table(spark, sf, "conversations").select("conv_id", "turn", X.pick_explanation(answer).alias("explanation"))


@query("p29_alias_fields", """
WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE 'n/a' END AS a, p_size * 2 AS b, p_brand, p_name FROM part)
SELECT p_partkey, CASE WHEN a = '' THEN CAST(b AS DOUBLE) ELSE coalesce(TRY_CAST(a AS DOUBLE), 0.0) END AS wrong_count,
  'A. ' || p_brand || '|B. —|C. ' || p_name AS options FROM r""")
def p29(spark, sf):
    size = F.col("p_size")
    a = F.when(size % 3 == 0, "").when(size % 3 == 1, size.cast("string")).otherwise("n/a")
    opts = X.options_from_list(F.array(F.col("p_brand"), F.lit("  "), F.col("p_name")))
    return table(spark, sf, "part").select(
        "p_partkey", X.first_number(0, a, size * 2).alias("wrong_count"), X.options_text(opts, "|").alias("options")
    )
