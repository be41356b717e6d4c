"""Model extraction queries (M1-M9, A17) over the documents and conversations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from itembank.functions.questions import options_text
from itembank.operators import extraction as E
from itembank.plans.registry import query
from itembank.plans.sqltext import SWS, rep, sqid, strim
from itembank.plans.sqlviews import Q
from itembank.session import materialize, scratch_path
from itembank.sources.tables import questions, table


def _numbered(spark, sf):
    """Documents whose lines with a leading vowel begin a question, so that chunks have places to end at."""
    text = F.regexp_replace("text", r"(?m)^([AEIOU])", "3. $1")
    return table(spark, sf, "documents").select(F.col("source").alias("bank"), "doc_id", text.alias("text"))


def _chunks(spark, sf):
    return E.chunk_documents(_numbered(spark, sf))


_BARE = strim(rep("raw", r"[\x{FEFF}]"))
QUESTION = rf"^[{SWS}]*([（(][{SWS}]*[0-9]{{1,3}}[{SWS}]*[）)]|[0-9]{{1,3}}[{SWS}]*[.、．)）:：]|[一二三四五六七八九十]{{1,3}}[{SWS}]*[、.．)）]|第[{SWS}]*[0-9]{{1,3}}[{SWS}]*[题問])"
# totals before each line (and after the last) give every line the end of a chunk that begins there; the chunks are a walk over these
CHUNKS = rf"""d AS (SELECT source AS bank, doc_id, regexp_split_to_array(regexp_replace(text, '(?m)^([AEIOU])', '3. \1', 'g'), '\r\n|\r|\n') AS a FROM documents),
w AS (SELECT bank, doc_id, i, {_BARE} AS t FROM (SELECT *, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM d)),
l AS (SELECT bank, doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, regexp_matches(t, '{QUESTION}') AS q,
  sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM w WHERE t <> ''),
z AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
e AS (SELECT a.doc_id, a.k, max(CASE WHEN b.after - a.after + length(a.t) + 1 <= 2500 THEN b.k END) AS fit FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k >= a.k GROUP BY 1, 2),
s AS (SELECT doc_id, k, greatest(k + 1, coalesce(fit, k) + 1) AS stop FROM e),
m AS (SELECT s.doc_id, s.k, max(b.k) AS good FROM s JOIN l a ON a.doc_id = s.doc_id AND a.k = s.k
  JOIN l b ON b.doc_id = s.doc_id AND b.k > s.k AND b.k < s.stop AND b.q AND (b.after - length(b.t) - 1) - (a.after - length(a.t) - 1) >= 1500 GROUP BY 1, 2),
c AS (SELECT s.doc_id, s.k, z.n, CASE WHEN stop < n THEN coalesce(good, stop) ELSE stop END AS cut FROM s JOIN z USING (doc_id) LEFT JOIN m ON m.doc_id = s.doc_id AND m.k = s.k),
r AS (SELECT doc_id, 0 AS no, 0::BIGINT AS first FROM z UNION ALL
  SELECT r.doc_id, no + 1, greatest(first + 1, cut - 2) FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.first WHERE cut < n),
v_chunks AS (SELECT l.bank, r.doc_id, r.no AS chunk_no, r.first AS lo, c.cut - 1 AS hi, string_agg(l.t, chr(10) ORDER BY l.k) AS text,
  min_by(l.t, l.k) AS head FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.first JOIN l ON l.doc_id = r.doc_id AND l.k >= r.first AND l.k < c.cut GROUP BY ALL)"""


@query("m1_chunk_lines", f'WITH RECURSIVE {CHUNKS} SELECT bank, doc_id, chunk_no, lo AS "from", hi AS "to", text FROM v_chunks')
def m1(spark, sf):
    return _chunks(spark, sf)


@query("m2_messages", "SELECT conv_id, turn, role, '以下是某份题库文件的文本片段，请识别其中的题目。' || chr(10) || '--- 文本片段开始 ---' || chr(10) || text || chr(10) || '--- 文本片段结束 ---' AS content FROM conversations")
def m2(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", E.messages(F.col("text"))[1]["content"].alias("content"))


def stub(messages: list[dict]) -> str:
    """A stand-in model: one question made of the passage's first line."""
    body = messages[1]["content"].split("\n")
    item = {"stem": body[2], "options": ["A. x", "B. y"], "answer": "A"}
    reply = json.dumps({"questions": [item]}, ensure_ascii=False)
    tokens = {"prompt_tokens": len(body), "completion_tokens": len(reply)}
    return json.dumps({"choices": [{"message": {"content": reply}}], "usage": tokens}, ensure_ascii=False)


REPLY = """'{"questions": [{"stem": ' || to_json(head) || ', "options": ["A. x", "B. y"], "answer": "A"}]}'"""


@query("m3_batch_infer", f"""WITH RECURSIVE {CHUNKS}, a AS (SELECT *, {REPLY} AS reply FROM v_chunks)
SELECT bank, doc_id, chunk_no, 'ok' AS status, 1 AS attempts, '' AS error, '{{"choices": [{{"message": {{"content": ' || to_json(reply)
  || '}}}}], "usage": {{"prompt_tokens": ' || (hi - lo + 4) || ', "completion_tokens": ' || length(reply) || '}}}}' AS response FROM a""")
def m3(spark, sf):
    chunks = _chunks(spark, sf).withColumn("messages", E.messages(F.col("text")))
    store = scratch_path(spark, "answers")
    return E.infer_stored(chunks, stub, store, backoff_s=0).select(*E.CHUNK_ID, "status", "attempts", "response", "error")


# answers in six layouts: fenced, bare list, wrapped with a trailing comma, not JSON, one object, keyed objects with a repeat
ANSWERS = ["fenced", "list", "wrapped", "broken", "single", "keyed"]


def answers(spark, sf):
    """Assistant turns as model responses: (bank, doc_id, chunk_no, response)."""
    t = table(spark, sf, "conversations").filter("role = 'assistant'").withColumn("s", F.col("conv_id") % 6).withColumn("word", F.split("text", " ")[0])
    lit = lambda text: F.lit(text)
    q = lambda *cols: F.to_json(F.struct(*cols))
    stem, word = F.col("text").alias("stem"), F.col("word")
    std = q(stem, F.lit("单选").alias("qtype"), F.struct(word.alias("a"), F.lit("B. 乙").alias("B")).alias("options"), F.lit("答案：b").alias("answer"))
    bare = q(F.col("text").alias("question"), F.array(lit("A. 对"), lit("B. 错")).alias("choices"), lit("A").alias("correct"), lit("真假 判断").alias("type"),
             lit("n").alias("analysis"))
    wrapped = q(F.col("text").alias("title"), lit("正确").alias("answer"))
    single = q(stem, lit("A. 甲 B. 乙 C. 丙").alias("options"), lit("c,a").alias("answer"), lit("multiple").alias("type"))
    content = (
        F.when(F.col("s") == 0, F.concat(lit("好的：\n```json\n{\"questions\":["), std, lit(",5]}\n```\n完")))
        .when(F.col("s") == 1, F.concat(lit("["), bare, lit("]")))
        .when(F.col("s") == 2, F.concat(lit('{"data":{"list":['), wrapped, lit(",]}}")))
        .when(F.col("s") == 3, F.concat(lit("抱歉 "), F.lit("没有")))
        .when(F.col("s") == 4, single)
        .otherwise(F.concat(lit('{"questions":{"q1":'), std, lit(',"q2":'), std, lit(',"q3":{"answer":"A"}}}')))
    )
    t = t.withColumn("content", content)
    tokens = F.struct(F.length("text").alias("prompt_tokens"), (F.col("turn") + 1).alias("completion_tokens"))
    chat = F.to_json(F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"), tokens.alias("usage")))
    parts = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(
        F.struct(F.substring("content", 1, 3).alias("text")), F.struct(F.expr("substring(content, 4)").alias("text"))).alias("content")).alias("message"))).alias("choices")))
    m = F.col("turn") % 4
    response = (
        F.when(m == 1, chat).when(m == 2, F.concat(lit('{"status":200,"data":'), chat, lit("}"))).when(m == 3, parts)
        .otherwise(F.to_json(F.struct(F.col("content").alias("output_text"))))
    )
    return t.select(
        F.concat(lit("b"), (F.col("conv_id") % 7).cast("string")).alias("bank"), F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("chunk_no"), response.alias("response"), "content", "s",
    )


V = """v AS (SELECT 'b' || conv_id % 7 AS bank, conv_id AS doc_id, CAST(turn AS INT) AS chunk_no, conv_id % 6 AS s, text, split_part(text, ' ', 1) AS word, length(text) AS n FROM conversations WHERE role = 'assistant')"""
ITEM = V + f""",
x AS (SELECT *, {strim('text')} AS stem FROM v WHERE s <> 3),
v_q AS (SELECT bank, doc_id, chunk_no, 1 AS item_no, {sqid('stem')} AS qid, stem, CASE s WHEN 1 THEN '判断' WHEN 2 THEN '判断' WHEN 4 THEN '多选' ELSE '单选' END AS qtype,
  CASE s WHEN 1 THEN 'A. 对' || chr(10) || 'B. 错' WHEN 2 THEN '' WHEN 4 THEN 'A. 甲' || chr(10) || 'B. 乙' || chr(10) || 'C. 丙' ELSE 'A. ' || word || chr(10) || 'B. 乙' END AS options,
  CASE s WHEN 1 THEN '正确' WHEN 2 THEN '正确' WHEN 4 THEN 'AC' ELSE 'B' END AS answer, CASE WHEN s = 1 THEN 'n' ELSE '' END AS explanation FROM x)"""


def _parsed(spark, sf):
    rows = answers(spark, sf).withColumn("content", E.message_content(F.col("response")))
    return E.parse_items(materialize(rows.drop("response"), "answers"))


@query("m4_content", f"WITH {V} SELECT bank, doc_id, chunk_no, true AS whole FROM v")
def m4(spark, sf):
    return answers(spark, sf).select(
        "bank", "doc_id", "chunk_no", (E.message_content(F.col("response")) == F.col("content")).alias("whole")
    )


@query("m5_tolerant_json", f"WITH {V} SELECT bank, doc_id, chunk_no, s <> 3 AS ok FROM v")
def m5(spark, sf):
    return answers(spark, sf).select("bank", "doc_id", "chunk_no", E.tolerant_json(E.json_text(F.col("content"))).isNotNull().alias("ok"))


@query("m6_llm_items", f"WITH {ITEM} SELECT * FROM v_q")
def m6(spark, sf):
    return _parsed(spark, sf)[0].select(
        "bank", "doc_id", "chunk_no", "item_no", "qid", "stem", "qtype", options_text(F.col("options")).alias("options"), "answer", "explanation"
    )


@query("m6_llm_errors", f"""WITH {V}
SELECT bank, doc_id, chunk_no, 0 AS item_no, '模型返回的不是合法 JSON' AS error FROM v WHERE s = 3
UNION ALL SELECT bank, doc_id, chunk_no, 2, '第 2 条不是对象，略过' FROM v WHERE s = 0
UNION ALL SELECT bank, doc_id, chunk_no, 2, '第 2 条与之前的相同，略过' FROM v WHERE s = 5
UNION ALL SELECT bank, doc_id, chunk_no, 3, '第 3 条没有题干，略过' FROM v WHERE s = 5""")
def m6_errors(spark, sf):
    return _parsed(spark, sf)[1]


@query("m7_cross_chunk", f"""WITH {ITEM}, r AS (SELECT *, row_number() OVER (PARTITION BY bank, qid ORDER BY doc_id, chunk_no, item_no) AS rn FROM v_q)
SELECT bank, qid, doc_id, chunk_no, stem FROM r WHERE rn = 1""")
def m7(spark, sf):
    return E.across_chunks(_parsed(spark, sf)[0]).select("bank", "qid", "doc_id", "chunk_no", "stem")


@query("m8_error_class", """WITH e AS (SELECT event_id, 400 + CAST(event_id % 120 AS INT) AS status FROM events)
SELECT event_id, status, c AS code, c <> 'auth' AS retryable FROM (SELECT *, CASE WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rate'
  WHEN status IN (408, 504) THEN 'timeout' WHEN status >= 500 THEN 'server' ELSE 'bad_request' END AS c FROM e)""")
def m8(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.lit(400) + (F.col("event_id") % 120).cast("int")).alias("status"))
    return rows.select("event_id", "status", E.error_class(F.col("status")).alias("c")).select("event_id", "status", "c.*")


@query("m9_explain_queue", f"""WITH {Q} SELECT bank, qid, explanation <> '' AS cached, explanation, CASE WHEN explanation <> '' THEN '' ELSE
'题型：' || qtype || '题' || chr(10) || '题干：' || stem || chr(10) || '选项：' || chr(10) || 'A. ' || opt_a || chr(10) || 'B. ' || opt_b || chr(10) || 'C. ' || opt_c || chr(10) || 'D. ' || opt_d
|| chr(10) || '正确答案：' || answer END AS prompt FROM v_questions""")
def m9(spark, sf):
    return E.explain_queue(questions(spark, sf))


@query("a17_usage", f"""WITH {V} SELECT bank, count(*) AS chunks, count(*) FILTER (WHERE s <> 3) AS done, count(*) FILTER (WHERE s = 3) AS failed,
CAST(sum(CASE WHEN chunk_no % 4 IN (1, 2) THEN n ELSE 0 END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN chunk_no % 4 IN (1, 2) THEN chunk_no + 1 ELSE 0 END) AS BIGINT) AS completion
FROM v GROUP BY bank""")
def a17(spark, sf):
    rows = answers(spark, sf).withColumn("u", E.usage(F.col("response"))).withColumn(
        "ok", E.tolerant_json(E.json_text(E.message_content(F.col("response")))).isNotNull()
    )
    return rows.groupBy("bank").agg(
        F.count("*").alias("chunks"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum("u.prompt").alias("prompt"), F.sum("u.completion").alias("completion"),
    )
