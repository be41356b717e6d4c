"""The canonical views written as DuckDB common table expressions."""

QTYPE = (
    "CASE p_size % 5 WHEN 0 THEN '单选' WHEN 1 THEN '多选' WHEN 2 THEN '判断' "
    "WHEN 3 THEN '简答' ELSE '论述' END"
)

Q = f"""
q0 AS (
  SELECT p.*, {QTYPE} AS qtype FROM part p
),
v_questions AS (
  SELECT p_brand AS bank, p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS qid, p_name AS stem, qtype,
         p_brand AS opt_a, p_type AS opt_b, 'size ' || p_size AS opt_c, p_name AS opt_d,
         CASE WHEN qtype = '单选' THEN substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1)
              WHEN qtype = '多选' THEN CASE p_partkey % 4 WHEN 0 THEN 'AB' WHEN 1 THEN 'BC' WHEN 2 THEN 'CD' ELSE 'AD' END
              WHEN qtype = '判断' THEN CASE WHEN p_partkey % 2 = 0 THEN '正确' ELSE '错误' END
              ELSE p_name END AS answer,
         CASE WHEN qtype = '单选' THEN substr('ABCD', CAST((p_partkey + 1) % 4 + 1 AS INT), 1)
              WHEN qtype = '多选' THEN substr('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1)
              WHEN qtype = '判断' THEN CASE WHEN p_partkey % 2 = 0 THEN '错' ELSE '对' END
              ELSE '?' END AS wrong_answer,
         CASE WHEN p_size < 10 THEN '' ELSE 'see ' || p_type END AS explanation,
         CASE WHEN p_type = 'PROMO' THEN 'manual' ELSE 'auto' END AS source,
         p_size % 3 AS page, p_size % 7 AS line, p_size % 2 AS para,
         CASE WHEN p_partkey % 3 <> 0 THEN 1990 + p_size END AS year,
         CASE WHEN p_type = 'STANDARD' THEN '' ELSE p_type END AS topic
  FROM q0
)"""

A = Q + """,
v_attempts AS (
  SELECT o_custkey AS learner, q.bank, q.qid, l_orderkey AS session_id, o_orderpriority AS mode,
         l_shipdate AS answered_at, l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS tie,
         q.qtype, q.topic, q.stem, q.answer,
         CASE WHEN l_returnflag <> 'R' THEN q.answer ELSE q.wrong_answer END AS user_answer,
         l_returnflag <> 'R' AS correct, l_tax = 0 AS fav_click
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v_questions q ON q.ord = l_partkey
)"""

ACC = "CASE WHEN {a} = 0 THEN 0.0 ELSE floor((CAST({c} AS DOUBLE) / {a}) * 1000 + 0.5) / 10 END"


def acc(correct: str, answered: str) -> str:
    return ACC.format(c=correct, a=answered)


# review state by a row-by-row reading of the schedule rules: islands opened by a wrong answer
BOOK_BODY = """
b1 AS (SELECT *, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER w AS isl FROM {src}
       WINDOW w AS (PARTITION BY bank, qid ORDER BY answered_at, seq, tie ROWS UNBOUNDED PRECEDING)),
b2 AS (SELECT *, sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER (PARTITION BY bank, qid, isl
       ORDER BY answered_at, seq, tie ROWS UNBOUNDED PRECEDING) AS nc FROM b1),
bi AS (SELECT bank, qid, isl, max(nc) AS nc, min(answered_at) AS wrong_at, max(answered_at) AS last_at
       FROM b2 WHERE isl > 0 GROUP BY bank, qid, isl),
be AS (SELECT *, coalesce(sum(CASE WHEN nc >= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY bank, qid ORDER BY isl
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch,
       max(isl) OVER (PARTITION BY bank, qid) AS last_isl FROM bi),
bw AS (SELECT *, row_number() OVER (PARTITION BY bank, qid, epoch ORDER BY isl) AS wrong_count,
       min(wrong_at) OVER (PARTITION BY bank, qid, epoch) AS added_at FROM be),
v_book AS (
  SELECT bank, qid, CAST(wrong_count AS BIGINT) AS wrong_count, CAST(nc AS BIGINT) AS correct_streak,
         CAST(least(nc, 6) AS BIGINT) AS stage,
         CAST(last_at AS DATE) + CAST(CASE least(nc, 6) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4
              WHEN 4 THEN 7 WHEN 5 THEN 15 ELSE 30 END AS INT) AS next_review,
         added_at, wrong_at AS last_wrong_at, last_at AS last_answer_at
  FROM bw WHERE isl = last_isl AND nc < 7
)"""

BOOK = A + "," + BOOK_BODY.format(src="v_attempts")

EVENTS = """
v_events AS (
  SELECT CAST(user_id AS VARCHAR) AS bank, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS qid,
         event_id AS seq, 0 AS tie, ts AS answered_at, event_type AS qtype, value < 70 AS correct
  FROM events
)"""

FAV = """,
v_fav AS (
  SELECT bank, qid, max(answered_at) AS fav_at FROM v_attempts WHERE fav_click
  GROUP BY bank, qid HAVING count(*) % 2 = 1
)"""


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"
