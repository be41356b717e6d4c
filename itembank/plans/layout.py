"""Page layout queries (L1-L7, S4) over the words of the documents laid out on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from itembank.operators import layout as Y
from itembank.plans.registry import query
from itembank.sources.tables import spread, table


def items(spark, sf):
    """Words as page items: even documents in two columns of five, odd ones in one of ten.

    The baselines of two documents in seven drift downwards from word to word: by 0.4 points, which a
    moving mean follows, or by 1.4, which tears rows apart and lets those of two text columns meet.
    """
    words = spread(table(spark, sf, "documents")).selectExpr(
        # one blank needs no pattern
        "doc_id", r"array_remove(split(replace(replace(replace(text, '\t', ' '), '\r', ' '), '\n', ' '), ' '), '') AS ws"
    ).selectExpr("doc_id", "size(ws) AS n", "doc_id % 2 = 0 AS two", "posexplode(ws) AS (m, str)").filter("n > 0")
    per, place = "if(two, 300, 600)", "m % if(two, 300, 600) % if(two, 5, 10)"
    return words.selectExpr(
        "doc_id", "cast(m div 600 + 1 AS int) AS page", "m AS item_no",
        f"cast(36 + if(two AND m % 600 >= 300, 306, 0) + {place} * if(two, 30, 55) AS double) AS x",
        f"800 - 12 * ((m % {per}) div if(two, 5, 10)) - {place} * CASE doc_id % 7 WHEN 3 THEN 1.4D WHEN 5 THEN 0.4D ELSE 0D END AS y",
        "cast(least(length(str) * 4, 25) AS double) AS w", "10D AS h", "str",
    )


ITEMS = r"""
w0 AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+') AS ws, doc_id % 2 = 0 AS two FROM documents),
w1 AS (SELECT doc_id, two, unnest(ws) AS str, generate_subscripts(ws, 1) - 1 AS m FROM w0),
v_items AS (SELECT doc_id, CAST(m // 600 + 1 AS INT) AS page, CAST(m AS INT) AS item_no,
  CAST(36 + CASE WHEN two AND m % 600 >= 300 THEN 306 ELSE 0 END + CASE WHEN two THEN (m % 300) % 5 * 30 ELSE (m % 600) % 10 * 55 END AS DOUBLE) AS x,
  CAST(800 - 12 * CASE WHEN two THEN (m % 300) // 5 ELSE (m % 600) // 10 END AS DOUBLE)
    - CAST(CASE WHEN two THEN m % 300 % 5 ELSE m % 600 % 10 END AS DOUBLE) * CASE doc_id % 7 WHEN 3 THEN 1.4::DOUBLE WHEN 5 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS y,
  CAST(least(length(str) * 4, 25) AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h, str FROM w1)"""
FRAME = """,
fr AS (SELECT *, x + w AS right_x, count(*) OVER p AS n, min(x) OVER p AS min_x, max(x + w) OVER p - min(x) OVER p AS width FROM v_items WINDOW p AS (PARTITION BY doc_id, page)),
v_framed AS (SELECT * FROM fr WHERE n >= 30 AND width > 0)"""

# item by item: the row that takes it (nearest mean, or oldest first item within the tolerance), and the baselines so far
MOVING = "CASE WHEN list_min(d) <= 1.5 THEN list_position(d, list_min(d)) ELSE len(ys) + 1 END"
FIXED = "coalesce(nullif(list_position(list_transform(d, lambda v: v <= 2), true), 0), len(ys) + 1)"
MEAN = "CASE WHEN i = r THEN v + (y - v) / (ns[i] + 1) ELSE v END"


def _fold(name: str, src: str, keys: str, pick: str, base: str) -> str:
    """``name``: the items of ``src`` with their row, numbered from the top; the query needs RECURSIVE."""
    n, f = name, "CASE WHEN r > len(ys) THEN list_append"
    return f""",
{n}_q AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY item_no) AS k FROM {src}),
{n}_f AS (SELECT {keys}, k, CAST(1 AS BIGINT) AS r, [y] AS ys, [1] AS ns FROM {n}_q WHERE k = 1
  UNION ALL
  SELECT {keys}, k, r, {f}(ys, y) ELSE list_transform(ys, lambda v, i: {base}) END,
    {f}(ns, 1) ELSE list_transform(ns, lambda v, i: CASE WHEN i = r THEN v + 1 ELSE v END) END
  FROM (SELECT *, CAST({pick} AS BIGINT) AS r FROM (
    SELECT q.*, f.ys, f.ns, list_transform(f.ys, lambda v: abs(v - q.y)) AS d FROM {n}_f f JOIN {n}_q q USING ({keys}) WHERE q.k = f.k + 1))),
{n}_e AS (SELECT {keys}, arg_max(ys, k) AS ys FROM {n}_f GROUP BY {keys}),
{n}_u AS (SELECT {keys}, unnest(ys) AS base, generate_subscripts(ys, 1) AS r FROM {n}_e),
{n}_n AS (SELECT {keys}, r, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY base DESC, r) AS INT) AS row FROM {n}_u),
{n} AS (SELECT q.*, row FROM {n}_q q JOIN {n}_f f USING ({keys}, k) JOIN {n}_n USING ({keys}, r))"""


def _text(name: str, src: str, keys: str) -> str:
    return f""",
{name}_t AS (SELECT *, lag(x + w) OVER r AS e FROM {src} WINDOW r AS (PARTITION BY {keys}, row ORDER BY x, item_no)),
{name} AS (SELECT {keys}, row, string_agg(CASE WHEN x - e > 2.5 THEN ' ' ELSE '' END || str, '' ORDER BY x, item_no) AS text FROM {name}_t GROUP BY {keys}, row)"""


ROWS = ITEMS + _fold("v_rows", "v_items", "doc_id, page", MOVING, MEAN)
MEANS = """,
tm AS (SELECT doc_id, page, any_value(width) AS width, list((x + right_x) / 2) AS cs, count(*) AS n, sum((x + right_x) / 2) AS total,
  min((x + right_x) / 2) AS lo, max((x + right_x) / 2) AS hi FROM v_framed GROUP BY ALL),
mm AS (SELECT doc_id, page, 0 AS i, lo AS a, hi AS b, hi <= lo AS done, hi > lo AS ok FROM tm
  UNION ALL
  SELECT doc_id, page, i + 1, if(l IN (0, n), a, sl / l), if(l IN (0, n), b, (total - sl) / (n - l)),
    l IN (0, n) OR (abs(sl / l - a) < 0.5 AND abs((total - sl) / (n - l) - b) < 0.5), l NOT IN (0, n)
  FROM (SELECT *, coalesce(list_sum(ls), 0) AS sl, len(ls) AS l FROM (
    SELECT mm.*, n, total, list_filter(cs, lambda c: c <= (a + b) / 2) AS ls FROM mm JOIN tm USING (doc_id, page) WHERE NOT done AND i < 12))),
me AS (SELECT doc_id, page, arg_max(a, i) AS a, arg_max(b, i) AS b, arg_max(ok, i) AS ok FROM mm GROUP BY ALL),
mg AS (SELECT *, len(list_filter(cs, lambda c: c >= a + (b - a) * 0.25 AND c <= a + (b - a) * 0.75)) AS mid_n,
  len(list_filter(cs, lambda c: c < (a + b) / 2)) AS left_n FROM me JOIN tm USING (doc_id, page)),
v_means AS (SELECT doc_id, page, (a + b) / 2 AS split_x FROM mg WHERE ok AND b - a >= greatest(width * 0.25, 60)
  AND mid_n <= n * 0.12 AND left_n >= n * 0.15 AND n - left_n >= n * 0.15)"""
BAND = """,
bc AS (SELECT DISTINCT doc_id, page, unnest(range(greatest(0, CAST(floor((x - min_x) / width * 100) AS INT)), least(99, CAST(ceil((right_x - min_x) / width * 100) - 1 AS INT)) + 1)) AS b FROM v_framed),
bp AS (SELECT DISTINCT doc_id, page, min_x, width FROM v_framed),
be AS (SELECT bp.*, i FROM bp, range(30, 71) t(i) WHERE NOT EXISTS (SELECT 1 FROM bc WHERE bc.doc_id = bp.doc_id AND bc.page = bp.page AND bc.b = i)),
br AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS g FROM be),
bs AS (SELECT doc_id, page, min_x, width, min(i) AS f, count(*) AS len FROM br GROUP BY doc_id, page, min_x, width, g),
bb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY len DESC, f) AS rn FROM bs),
v_band AS (SELECT doc_id, page, min_x + ((f + len / 2) / 100) * width AS split_x FROM bb WHERE rn = 1 AND len >= 3)"""
VOTE = _fold("v_anchored", "v_framed", "doc_id, page", FIXED, "v") + """,
vg AS (SELECT *, x - lag(right_x) OVER r AS gap, (x + lag(right_x) OVER r) / 2 AS mid FROM v_anchored WINDOW r AS (PARTITION BY doc_id, page, row ORDER BY x, item_no)),
vb AS (SELECT doc_id, page, row, min_x, width, gap, mid, row_number() OVER (PARTITION BY doc_id, page, row ORDER BY gap DESC NULLS LAST, x) AS rn FROM vg),
vv AS (SELECT doc_id, page, row, min_x, width, CASE WHEN gap >= greatest(8, width * 0.015) THEN least(19, greatest(0, CAST(floor((mid - min_x) / width * 20) AS INT))) END AS bin FROM vb WHERE rn = 1),
vp AS (SELECT doc_id, page, min_x, width, count(*) AS rows_n, count(bin) AS gaps FROM vv GROUP BY ALL),
vc AS (SELECT doc_id, page, bin, count(*) AS n FROM vv WHERE bin BETWEEN 5 AND 14 GROUP BY ALL),
vs AS (SELECT doc_id, page, unnest([bin - 1, bin, bin + 1]) AS bin, n FROM vc),
vk AS (SELECT doc_id, page, bin, sum(n) AS votes FROM vs GROUP BY ALL),
vm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY votes DESC, bin) AS rn FROM vk),
v_vote AS (SELECT doc_id, page, min_x + ((bin + 0.5) / 20) * width AS split_x FROM vm JOIN vp USING (doc_id, page) WHERE rn = 1 AND gaps >= 5 AND votes >= greatest(5, rows_n * 0.5))"""
ORDERED = ITEMS + FRAME + MEANS + BAND + VOTE + """,
st AS (SELECT *, 1 AS step FROM v_means UNION ALL SELECT *, 2 FROM v_band UNION ALL SELECT *, 3 FROM v_vote),
sd AS (SELECT doc_id, page, step, split_x FROM v_items JOIN st USING (doc_id, page) GROUP BY ALL
  HAVING count(*) FILTER (WHERE x < split_x) >= 10 AND count(*) FILTER (WHERE x >= split_x) >= 10),
sp AS (SELECT doc_id, page, arg_min(split_x, step) AS split_x FROM sd GROUP BY ALL),
v_placed AS (SELECT v_items.*, CASE WHEN x >= split_x THEN 1 ELSE 0 END AS col FROM v_items LEFT JOIN sp USING (doc_id, page))""" + _fold(
    "v_cols", "v_placed", "doc_id, page, col", MOVING, MEAN) + _text("v_lines", "v_cols", "doc_id, page, col")


@query("l1_row_cluster", f"WITH RECURSIVE {ROWS} SELECT doc_id, page, item_no, row FROM v_rows")
def l1(spark, sf):
    return Y.cluster_rows(items(spark, sf)).select("doc_id", "page", "item_no", "row")


LINES = f"WITH RECURSIVE {ROWS}{_text('v_text', 'v_rows', 'doc_id, page')} SELECT doc_id, page, row, text FROM v_text"


@query("l2_line_text", LINES)
def l2(spark, sf):
    return Y.page_lines(items(spark, sf))


@query("s4_page_lines", f"""{LINES.replace(' SELECT doc_id, page, row, text FROM v_text', '')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY row) AS line, page, 0 AS para, text FROM v_text""")
def s4(spark, sf):
    return Y.page_source(items(spark, sf)).select("doc_id", "page", "line", "para", "text")


def _rounded(df):
    return df.filter("split_x IS NOT NULL").select("doc_id", "page", F.expr("floor(split_x * 1000 + 0.5D) / 1000D").alias("split_x"))


@query("l3_two_means", f"WITH RECURSIVE {ITEMS}{FRAME}{MEANS} SELECT doc_id, page, floor(split_x * 1000 + 0.5) / 1000 AS split_x FROM v_means")
def l3(spark, sf):
    return _rounded(Y.two_means(Y.framed(items(spark, sf))))


@query("l4_blank_band", f"WITH {ITEMS}{FRAME}{BAND} SELECT doc_id, page, floor(split_x * 1000 + 0.5) / 1000 AS split_x FROM v_band")
def l4(spark, sf):
    return _rounded(Y.blank_band(Y.framed(items(spark, sf))))


@query("l5_gap_vote", f"WITH RECURSIVE {ITEMS}{FRAME}{VOTE} SELECT doc_id, page, floor(split_x * 1000 + 0.5) / 1000 AS split_x FROM v_vote")
def l5(spark, sf):
    return _rounded(Y.gap_vote(Y.framed(items(spark, sf))))


@query("l6_reading_order", f"""WITH RECURSIVE {ORDERED}
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, row) AS line, col, text FROM v_lines""")
def l6(spark, sf):
    return Y.reading_order(items(spark, sf)).select("doc_id", "page", "line", "col", "text")


@query("l7_text_layer", f"""WITH {ITEMS}, v_pages AS (SELECT doc_id, page FROM v_items UNION SELECT doc_id, 0 FROM documents),
c AS (SELECT doc_id, page, CAST(sum(length(str)) AS BIGINT) AS chars FROM v_items GROUP BY ALL)
SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE chars IS NULL) AS empty_pages, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, coalesce(sum(chars), 0) >= 50 AS usable
FROM v_pages LEFT JOIN c USING (doc_id, page) GROUP BY doc_id""")
def l7(spark, sf):
    it = items(spark, sf)
    covers = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("page"))
    return Y.text_layer(it.select("doc_id", "page").unionByName(covers), Y.reading_order(it)).drop("column_pages")
