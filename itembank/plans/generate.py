"""Item generation queries (N1-N18) over the documents, with Latin word lists.

The detector queries (n5, n6) run the full detectors. The later steps read hits of two plain
patterns, words with a term suffix and numbers, whose places SQL can state exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions.questions import options_text
from itembank.operators import generate as N
from itembank.plans.registry import query
from itembank.plans.sqltext import SWS, rep, rep1, sbullets, scompact, snormws, sqid, sstem, stopic, strim
from itembank.session import materialize
from itembank.sources.lines import text_lines
from itembank.sources.tables import spread, table

LATIN = N.Lexicon(
    terminators="。！？；!?;.", terms=["heiten", "ciones", "mentre", "ndshes", "edthe", "the ed"], names=["Apache", "General Public", "auxre", "Licensed"],
    letters="A-Za-z", term_suffixes=["tion", "ment", "keit"], name_suffixes=["heit", "dad"],
    judge_hint=r"[0-9]| is | est | ist | son ", negation=r" nicht| pas", guard="",
    add_negation=[(" is ", " is not ", False), (" est ", " n'est pas ", False), (" ist ", " ist nicht ", False), (" son ", " no son ", False)],
)
SEED = N.SEED
SQL_SPLIT = r"regexp_split_to_array(text, '\r\n|\r|\n')"


def _lines(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.col("source").alias("bank"), "doc_id", "text")
    return text_lines(docs, ["bank", "doc_id"])


def _filtered(spark, sf):
    sents = N.sentences(N.drop_repeated_headers(N.prepared_lines(_lines(spark, sf))), LATIN)
    return N.filter_sentences(sents)


BASE = f"""
l0 AS (SELECT source AS bank, doc_id, i, {strim(rep('raw', '[' + chr(92) + 'x{FEFF}]'))} AS t0 FROM (
  SELECT source, doc_id, unnest({SQL_SPLIT}) AS raw, generate_subscripts({SQL_SPLIT}, 1) AS i FROM documents)),
l1 AS (SELECT bank, doc_id, CAST(i AS INT) AS line, {sbullets(snormws('t0'))} AS text,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM l0 WHERE t0 <> ''),
l2 AS (SELECT *, {scompact('text')} AS key FROM l1 WHERE text <> ''),
r0 AS (SELECT bank, key FROM l2 WHERE length(key) <= 30 GROUP BY bank, key HAVING count(*) >= 3),
v_kept AS (SELECT * FROM l2 WHERE NOT EXISTS (SELECT 1 FROM r0 WHERE r0.bank = l2.bank AND r0.key = l2.key))"""
PAGE = r"^([0-9]{1,4}|[-–—]?[0-9]{1,4}[-–—]?|第[0-9]+页([/共][0-9]+页?)?|(?i:page)[0-9]+(((?i:of)|/)[0-9]+)?|[0-9]+/[0-9]+)$"
PIECES = r"regexp_extract_all(text, '[^。！？；!?;.]*[。！？；!?;.]|[^。！？；!?;.]+')"
SENTS = BASE + f""",
s0 AS (SELECT bank, doc_id, pos, line, list_filter(list_transform({PIECES}, lambda x: {strim('x')}), lambda x: x <> '') AS ps
  FROM v_kept WHERE NOT regexp_matches(key, '{PAGE}')),
v_sents AS (SELECT bank, doc_id, pos, line, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS sent FROM s0)"""
HEAD_PREFIX = r"^(第[一二三四五六七八九十百零0-9]+[章节讲部分单元篇课]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十0-9]+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]|[0-9]+[、.．])"
_RAWB = rep1("text", rf"^[{SWS}·•●○▪◦◆■□▶►※★☆*+>》」』\-–—~]+")
HEADING = f"""({scompact(sbullets('text'))} <> '' AND NOT regexp_matches(text, '[。！？；]$') AND (
  (regexp_matches({_RAWB}, '{HEAD_PREFIX}') AND length({scompact(sbullets('text'))}) <= 24) OR
  (length({scompact(sbullets('text'))}) <= 16 AND NOT regexp_matches(text, '[，,、：:；;]') AND NOT regexp_matches({scompact(sbullets('text'))}, '[是了在为的有会能与]'))))"""
TOC = r"^[0-9.、,，。()（）【】\-–—/=·…]+$|^(目录|(?i:contents))$|\.{3,}[0-9]+$"
FILTERED = SENTS + f""",
f0 AS (SELECT *, {scompact('text')} AS c FROM v_sents),
v_filtered AS (SELECT *, CASE WHEN {HEADING} THEN 'heading' WHEN length(c) < 12 THEN 'short' WHEN c = '' OR regexp_matches(c, '{TOC}') THEN 'contents'
  WHEN regexp_matches(c, '{PAGE}') THEN 'page' WHEN regexp_matches(text, '公众号|扫码|点击|关注|加群|欢迎订阅|微信搜|小红书') THEN 'promo'
  WHEN regexp_matches({_RAWB}, '^(解析|答案|参考答案|答|解答|出处)[{SWS}]*[:：]') THEN 'answer line' ELSE '' END AS reason FROM f0)"""
_HEADTEXT = strim(rep1(sbullets("text"), HEAD_PREFIX))
TOPICS = FILTERED + f""",
v_topics AS (SELECT *, coalesce(last_value(CASE WHEN reason = 'heading' THEN CASE WHEN length({scompact(_HEADTEXT)}) > 20 THEN {_HEADTEXT}[:20] ELSE {_HEADTEXT} END END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY pos, sent ROWS UNBOUNDED PRECEDING), '') AS topic FROM v_filtered)"""


@query("n1_repeat_header", f"WITH {BASE} SELECT bank, doc_id, line, text FROM v_kept")
def n1(spark, sf):
    return N.drop_repeated_headers(N.prepared_lines(_lines(spark, sf))).select("bank", "doc_id", "line", "text")


@query("n2_sentences", f"WITH {SENTS} SELECT bank, doc_id, pos, sent, text FROM v_sents")
def n2(spark, sf):
    lines = N.drop_repeated_headers(N.prepared_lines(_lines(spark, sf)))
    return N.sentences(lines, LATIN).select("bank", "doc_id", "pos", "sent", "text")


@query("n3_sentence_filter", f"WITH {FILTERED} SELECT doc_id, pos, sent, reason FROM v_filtered")
def n3(spark, sf):
    return _filtered(spark, sf).select("doc_id", "pos", "sent", "reason")


@query("n4_topic_carry", f"WITH {TOPICS} SELECT doc_id, pos, sent, topic FROM v_topics")
def n4(spark, sf):
    return N.carry_topics(_filtered(spark, sf)).select("doc_id", "pos", "sent", "topic")


def _found(pattern: str, kind: str, weight: str = "0", group: bool = False) -> str:
    """Matches of a pattern with their places, from the pieces between them."""
    term = "m[k][2:length(m[k]) - 1]" if group else "m[k]"
    return f"""SELECT doc_id, pos, sent, {term} AS term, '{kind}' AS kind, CAST(list_sum(list_transform(p[:k], lambda x: length(x))) +
      coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) + {1 if group else 0} AS INT) AS "index", CAST({weight.format(t=term)} AS INT) AS weight FROM (
      SELECT *, generate_subscripts(m, 1) AS k FROM (SELECT doc_id, pos, sent, regexp_extract_all(text, '{pattern}') AS m,
        regexp_split_to_array(text, '{pattern}') AS p FROM v_filtered WHERE reason = '') WHERE len(m) > 0)"""


_ALL = [
    _found(r"[0-9]+(\.[0-9]+)?" + rf"[{SWS}]*[%％]", "number"), _found(rf"[0-9]+[{SWS}]*[:：][{SWS}]*[0-9]+", "number"),
    _found(r"[0-9]{2,}(\.[0-9]+)?", "number"), _found(r"\b[A-Z][A-Z0-9]{1,5}\b", "en"),
    f"SELECT * FROM ({_found(chr(34) + '[^' + chr(34) + ']{1,30}' + chr(34), 'quote', 'length({t})', True)}) WHERE NOT regexp_matches(term, '[。！？；，,;]')",
] + [_found(w, "term", "length({t})") for w in LATIN.terms] + [_found(w, "name", "length({t})") for w in LATIN.names]


def _suffixed(words: list[str], kind: str, head: int, ok: str) -> str:
    """Words that end in a suffix, with the few letters before it; the rules for particles, measures and verbs need Han letters."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""SELECT doc_id, pos, sent, t AS term, '{kind}' AS kind, CAST("end" - length(t) AS INT) AS "index", 0 AS weight FROM (
  SELECT *, i + length(d) AS "end", regexp_extract(substr(text, greatest(i - {head - 1}, 1)::BIGINT, least(i, {head})::BIGINT), '([A-Za-z]*)$', 1) || d AS t FROM (
    SELECT doc_id, pos, sent, text, d, unnest(list_filter(range(0, length(text) - length(d) + 1), lambda x: substr(text, x + 1, length(d)) = d)) AS i
    FROM v_filtered, (SELECT unnest([{listed}]) AS d) WHERE reason = '' AND contains(text, d))) WHERE {ok}"""


_SUFFIXED = [
    _suffixed(LATIN.term_suffixes, "term", N.TERM_HEAD, "length(t) BETWEEN 3 AND 12"),
    _suffixed(LATIN.name_suffixes, "name", N.NAME_HEAD,
              """length(t) BETWEEN 2 AND 12 AND ("end" = length(t) OR NOT regexp_matches(substr(text, "end" - length(t), 1), '[A-Za-z]'))"""),
]
RAW = FILTERED + f""",
v_raw AS ({" UNION ALL ".join([*_ALL, *_SUFFIXED])})"""
# candidates in order of preference, taken one by one where they meet none taken before
RESOLVED = RAW + """,
g AS (SELECT doc_id, pos, sent, list({'k': k, 'w': -weight, 'l': -length(term), 'i': i, 'term': term, 'kind': kind} ORDER BY k, -weight, -length(term), i, term, kind) AS hs
  FROM (SELECT *, "index" AS i, CASE kind WHEN 'quote' THEN 0 WHEN 'term' THEN 1 WHEN 'name' THEN 2 WHEN 'number' THEN 3 ELSE 4 END AS k FROM v_raw) GROUP BY 1, 2, 3),
w AS (SELECT doc_id, pos, sent, hs, 1 AS n, hs[:0] AS kept FROM g UNION ALL
  SELECT doc_id, pos, sent, hs, n + 1, CASE WHEN len(list_filter(kept, lambda o: hs[n].i < o.i - o.l AND o.i < hs[n].i - hs[n].l)) > 0 THEN kept ELSE list_append(kept, hs[n]) END
  FROM w WHERE n <= len(hs)),
v_resolved AS (SELECT doc_id, pos, sent, x.term AS term, x.kind AS kind, x.i AS "index", -x.w AS weight FROM (SELECT *, unnest(kept) AS x FROM w WHERE n = len(hs) + 1))"""


@query("n5_key_terms", f"WITH {RAW} SELECT * FROM v_raw")
def n5(spark, sf):
    ready = _filtered(spark, sf).filter("reason = ''")
    return N.key_terms(ready, LATIN).select("doc_id", "pos", "sent", F.explode("raw").alias("h")).select("doc_id", "pos", "sent", "h.*")


@query("n6_overlap_resolve", f"WITH RECURSIVE {RESOLVED} SELECT * FROM v_resolved")
def n6(spark, sf):
    ready = _filtered(spark, sf).filter("reason = ''")
    return N.resolve_overlaps(N.key_terms(ready, LATIN)).select("doc_id", "pos", "sent", F.explode("hits").alias("h")).select(
        "doc_id", "pos", "sent", "h.*"
    )


# --- steps after the detectors ----------------------------------------------------------------------
def _usable(spark, sf, filtered=None):
    rows = N.usable_with_topics(_filtered(spark, sf) if filtered is None else filtered)
    return N.blankable(N.blanks(N.resolve_overlaps(N.key_terms(rows, LATIN)), LATIN))


def _written(spark, sf):
    return materialize(_usable(spark, sf), "usable")


_SUFFIX = "|".join(LATIN.term_suffixes)
_STEM_LEN = f"CASE WHEN kind = 'term' AND regexp_matches(term, '({_SUFFIX})$') AND length(term) > 5 THEN length(term) - 4 ELSE length(term) END"
_KIND = "CASE kind WHEN 'quote' THEN 0 WHEN 'term' THEN 1 WHEN 'name' THEN 2 WHEN 'number' THEN 3 ELSE 4 END"
HITS = RESOLVED + TOPICS[len(FILTERED):] + f""",
v_blanks AS (SELECT bank, doc_id, pos, sent, h."index" AS start, h.kind, substr(h.term, 1, {_STEM_LEN}) AS blank, h.term, h.weight FROM v_resolved h JOIN v_topics USING (doc_id, pos, sent)),
b1 AS (SELECT b.*, length({scompact('blank')}) AS len, length(s.c) AS n, s.text, s.topic, s.line FROM v_blanks b JOIN v_topics s USING (bank, doc_id, pos, sent)),
v_ok AS (SELECT * FROM b1 WHERE len >= 1 AND len <= 12 AND (len >= 2 OR kind = 'number') AND len <= n * 0.4 AND n - len >= 8),
v_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, sent ORDER BY {_KIND}, weight DESC, length(blank) DESC, start) - 1 AS blank_no FROM v_ok) WHERE blank_no < @K@)"""


def hits_sql(k: int) -> str:
    return HITS.replace("@K@", str(k))


@query("n7_blank_span", f"WITH RECURSIVE {hits_sql(1)} SELECT doc_id, pos, sent, start, kind, blank, CAST(length({scompact('blank')}) AS INT) AS len FROM v_blanks")
def n7(spark, sf):
    return _usable(spark, sf).select("doc_id", "pos", "sent", F.explode("blanks").alias("b")).select(
        "doc_id", "pos", "sent", "b.start", "b.kind", F.col("b.text").alias("blank"), "b.len"
    )


@query("n8_blankable", f"WITH RECURSIVE {hits_sql(1)} SELECT doc_id, pos, sent, start, kind, blank FROM v_ok")
def n8(spark, sf):
    return _usable(spark, sf).select("doc_id", "pos", "sent", F.explode("choices").alias("b")).select(
        "doc_id", "pos", "sent", "b.start", "b.kind", F.col("b.text").alias("blank")
    )


@query("n9_top_blank", f"WITH RECURSIVE {hits_sql(3)} SELECT doc_id, pos, sent, CAST(blank_no AS INT) AS blank_no, start, kind, blank FROM v_top")
def n9(spark, sf):
    return N.top_blanks(_usable(spark, sf), 3).select("doc_id", "pos", "sent", "blank_no", "start", "kind", "blank")


_BEFORE, _AFTER = "substr(text, 1, start)", "substr(text, start + length(blank) + 1)"
_PUNCT = r"[，。、；：！？（）()【】《》“”‘’「」『』…—·,.;:!?]"
CLOZE = rep(
    f"{_BEFORE} || CASE WHEN {_BEFORE} <> '' AND NOT regexp_matches({_BEFORE}, '[{SWS}]$') AND NOT regexp_matches({_BEFORE}, '{_PUNCT}$') THEN ' ' ELSE '' END || '____' || "
    f"CASE WHEN {_AFTER} <> '' AND NOT regexp_matches({_AFTER}, '^[{SWS}]') AND NOT regexp_matches({_AFTER}, '^{_PUNCT}') THEN ' ' ELSE '' END || {_AFTER}", " {2,}", " ")


@query("n10_cloze", f"""WITH RECURSIVE {hits_sql(1)}, c AS (SELECT *, {CLOZE} AS stem FROM v_top)
SELECT bank, doc_id, pos, sent, stem, blank AS answer, {sqid('stem')} AS qid, CASE WHEN topic <> '' THEN topic ELSE {stopic('stem')} END AS topic FROM c""")
def n10(spark, sf):
    return N.cloze_items(_usable(spark, sf)).select(
        "bank", "doc_id", "pos", "sent", "stem", F.col("options")["A"].alias("answer"), "qid", "topic"
    )


POOL = hits_sql(1) + f""",
p0 AS (SELECT *, {sstem('blank')} AS key FROM b1),
p1 AS (SELECT *, row_number() OVER (PARTITION BY bank, key ORDER BY doc_id, pos, sent, start) AS rn FROM p0
  WHERE key <> '' AND len <= 12 AND len >= CASE WHEN kind = 'number' THEN 1 ELSE 2 END),
v_pool AS (SELECT bank, key, blank AS text, kind, CAST(len AS INT) AS len, sha1('{SEED}|' || key) AS h FROM p1 WHERE rn = 1)"""


@query("n11_pool", f"WITH RECURSIVE {POOL} SELECT bank, key, text, kind, len FROM v_pool")
def n11(spark, sf):
    return N.distractor_pool(_usable(spark, sf))


RINGS = POOL + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY bank, kind ORDER BY len, h, key) AS kr, row_number() OVER (PARTITION BY bank ORDER BY h, key) AS br,
  count(*) OVER (PARTITION BY bank) AS n2 FROM v_pool),
it AS (SELECT bank, doc_id, pos, sent, kind, len, blank, start, text, topic, {scompact('text')} AS packed, {sstem('blank')} AS own,
  CAST('0x' || substr(sha1('{SEED}|' || bank || '|' || doc_id || '|' || pos || '|' || sent || '|0'), 1, 8) AS BIGINT) AS ofs FROM v_top),
nn AS (SELECT it.bank, doc_id, pos, sent, count(*) FILTER (WHERE r.kind = it.kind AND r.len < it.len - 3) AS lo,
  count(*) FILTER (WHERE r.kind = it.kind AND abs(r.len - it.len) <= 3) AS n1 FROM it JOIN rk r ON r.bank = it.bank GROUP BY ALL),
cd AS (SELECT it.*, r.text AS cand, CASE WHEN r.kind = it.kind AND abs(r.len - it.len) <= 3 THEN ((r.kr - 1 - lo - ofs) % n1 + n1) % n1
   ELSE n1 + ((r.br - 1 - ofs) % n2 + n2) % n2 END AS j
  FROM it JOIN nn USING (bank, doc_id, pos, sent) JOIN rk r ON r.bank = it.bank
  WHERE NOT contains(r.key, own) AND NOT contains(own, r.key) AND NOT contains(packed, {scompact('r.text')})),
rd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, sent ORDER BY j) AS rn FROM cd),
v_dist AS (SELECT bank, doc_id, pos, sent, any_value(blank) AS blank, any_value(start) AS start, any_value(text) AS text, any_value(topic) AS topic,
  list(cand ORDER BY rn) AS ds FROM rd WHERE rn <= 3 GROUP BY bank, doc_id, pos, sent HAVING count(*) = 3)"""


@query("n12_distractors", f"WITH RECURSIVE {RINGS} SELECT bank, doc_id, pos, sent, blank, array_to_string(ds, '|') AS distractors FROM v_dist")
def n12(spark, sf):
    usable = _written(spark, sf)
    ranked = N.rank_pool(N.distractor_pool(usable))
    picked = N.pick_distractors(N.top_blanks(usable, 1), ranked)
    return picked.select("bank", "doc_id", "pos", "sent", "blank", F.array_join("distractors", "|").alias("distractors"))


CHOICES = RINGS + f""",
co AS (SELECT *, list_transform(list_sort(list_transform(list_prepend(blank, ds), lambda c: sha1('{SEED}|' || doc_id || '|' || pos || '|' || sent || '|' || c) || c)), lambda x: substr(x, 41)) AS os FROM v_dist),
v_choice AS (SELECT bank, doc_id, pos, sent, {CLOZE} AS stem, 'A. ' || os[1] || chr(10) || 'B. ' || os[2] || chr(10) || 'C. ' || os[3] || chr(10) || 'D. ' || os[4] AS options,
  substr('ABCD', CAST(list_position(os, blank) AS INT), 1) AS answer FROM co)"""


@query("n13_choice_items", f"WITH RECURSIVE {CHOICES} SELECT bank, doc_id, pos, sent, stem, options, answer FROM v_choice")
def n13(spark, sf):
    return N.choice_items(_written(spark, sf)).select(
        "bank", "doc_id", "pos", "sent", "stem", options_text(F.col("options")).alias("options"), "answer"
    )


_RULES = [(" is ", " is not "), (" est ", " n''est pas "), (" ist ", " ist nicht "), (" son ", " no son ")]
_ADD = " ".join(f"WHEN contains(text, '{a}') THEN substr(text, 1, instr(text, '{a}') - 1) || '{b}' || substr(text, instr(text, '{a}') + {len(a)})" for a, b in _RULES)
_CUT = "instr(text, regexp_extract(text, ' nicht| pas'))"
MUTATE = hits_sql(1) + f""",
m0 AS (SELECT doc_id, pos, sent, min("index") AS ni, arg_min(term, "index") AS num FROM v_resolved WHERE kind = 'number' GROUP BY doc_id, pos, sent),
m1 AS (SELECT t.*, ni, regexp_extract(num, '[0-9]+(\\.[0-9]+)?') AS sample, coalesce(regexp_matches(num, '[%％]'), false) AS pct, sha1('{SEED}|' || text) AS h
  FROM v_topics t LEFT JOIN m0 USING (doc_id, pos, sent) WHERE reason = ''),
m2 AS (SELECT *, TRY_CAST(split_part(sample, '.', 1) AS DECIMAL(38,0)) AS v, CASE WHEN pct THEN 10 ELSE 1 END AS size,
  CASE WHEN contains(sample, '.') THEN '.' || split_part(sample, '.', 2) ELSE '' END AS frac FROM m1),
m3 AS (SELECT *, v + CASE WHEN substr(h, 9, 1) < '8' THEN size ELSE -size END AS moved FROM m2),
m4 AS (SELECT *, CASE WHEN moved < 0 OR (pct AND moved = 0 AND NOT regexp_matches(frac, '[1-9]')) THEN v + size ELSE moved END AS nv FROM m3),
v_mut AS (SELECT *, CASE WHEN nv IS NOT NULL THEN substr(text, 1, ni) || CAST(nv AS VARCHAR) || frac || substr(text, ni + length(sample) + 1)
  WHEN regexp_matches(text, ' nicht| pas') THEN substr(text, 1, {_CUT} - 1) || substr(text, {_CUT} + length(regexp_extract(text, ' nicht| pas')))
  {_ADD} END AS mutated FROM m4)"""


@query("n15_mutate", f"WITH RECURSIVE {MUTATE} SELECT doc_id, pos, sent, coalesce(mutated, '') AS mutated FROM v_mut")
def n15(spark, sf):
    return N.mutate(_usable(spark, sf), LATIN).select("doc_id", "pos", "sent", F.coalesce("mutated", F.lit("")).alias("mutated"))


JUDGES = MUTATE + """,
j0 AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY doc_id, pos, sent) AS jn FROM v_mut WHERE regexp_matches(text, '[0-9]| is | est | ist | son ')),
v_judge AS (SELECT bank, doc_id, pos, sent, CASE WHEN jn % 2 = 0 AND mutated IS NOT NULL THEN mutated ELSE text END AS stem,
  CASE WHEN jn % 2 = 0 AND mutated IS NOT NULL THEN '错误' ELSE '正确' END AS answer FROM j0)"""


@query("n14_judge_items", f"WITH RECURSIVE {JUDGES} SELECT * FROM v_judge")
def n14(spark, sf):
    return N.judge_items(_written(spark, sf), LATIN).select("bank", "doc_id", "pos", "sent", "stem", "answer")


# the three kinds together: distractors as in n12, true/false as in n14
ITEMS = RINGS + ", " + CHOICES[len(RINGS) + 2:] + ", " + JUDGES[len(hits_sql(1)) + 2:] + f""",
fi AS (SELECT bank, doc_id, pos, sent, {CLOZE} AS stem FROM v_top),
un AS (SELECT bank, doc_id, pos, sent, 'fill' AS kind, 0 AS kn, stem FROM fi UNION ALL SELECT bank, doc_id, pos, sent, 'choice', 1, stem FROM v_choice
  UNION ALL SELECT bank, doc_id, pos, sent, 'judge', 2, stem FROM v_judge),
v_items AS (SELECT *, {sqid('stem')} AS qid FROM un),
sn AS (SELECT bank, doc_id, pos, sent, row_number() OVER (PARTITION BY bank ORDER BY doc_id, pos, sent) AS n FROM v_topics WHERE reason = ''),
tn AS (SELECT i.*, n, ((kn - n) % 3 + 3) % 3 AS turn FROM v_items i JOIN sn USING (bank, doc_id, pos, sent)),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, doc_id, pos, sent ORDER BY turn) AS i FROM tn) WHERE i <= 1),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, qid ORDER BY doc_id, pos, sent, i) AS u FROM ch) WHERE u = 1),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, kind ORDER BY n, i) AS kr FROM uq) WHERE kr <= 50),
v_final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY kr, kn) AS ord FROM bk) WHERE ord <= 50)"""


@query("n16_balance_cap", f"WITH RECURSIVE {ITEMS} SELECT bank, doc_id, pos, sent, kind, qid, ord FROM v_final")
def n16(spark, sf):
    usable = _written(spark, sf)
    return N.balance(N.all_items(usable, LATIN), usable, 50).select(
        "bank", "doc_id", "pos", "sent", "kind", "qid", F.col("ord").cast("bigint").alias("ord")
    )


@query("n_generate", f"WITH RECURSIVE {ITEMS} SELECT bank, doc_id, pos, sent, kind, stem, qid, ord FROM v_final")
def n_generate(spark, sf):
    """The path a user calls, from lines to items."""
    return N.generate(_lines(spark, sf), 50, lexicon=LATIN).select(
        "bank", "doc_id", "pos", "sent", "kind", "stem", "qid", F.col("ord").cast("bigint").alias("ord")
    )


@query("n17_dedupe", f"""WITH RECURSIVE {JUDGES}, i AS (SELECT *, {sqid('stem')} AS qid FROM v_judge),
r AS (SELECT *, row_number() OVER (PARTITION BY bank, qid ORDER BY doc_id, pos, sent) AS u FROM i) SELECT bank, doc_id, pos, sent, qid FROM r WHERE u = 1""")
def n17(spark, sf):
    items = N.judge_items(_written(spark, sf), LATIN)
    return N.keep_first(items, ["bank", "qid"], ["doc_id", "pos", "sent"]).select("bank", "doc_id", "pos", "sent", "qid")


@query("n18_gen_summary", f"""WITH RECURSIVE {ITEMS},
a AS (SELECT bank, count(*) AS total, count(*) FILTER (WHERE reason = '') AS usable FROM v_filtered GROUP BY bank),
b AS (SELECT bank, count(*) AS questions, count(*) FILTER (WHERE kind = 'judge') AS judge, count(*) FILTER (WHERE kind = 'choice') AS choice,
  count(*) FILTER (WHERE kind = 'fill') AS fill, count(DISTINCT (doc_id, pos, sent)) AS used FROM v_final GROUP BY bank)
SELECT bank, total, usable, coalesce(questions, 0) AS questions, coalesce(judge, 0) AS judge, coalesce(choice, 0) AS choice, coalesce(fill, 0) AS fill,
  total - coalesce(used, 0) AS skipped FROM a LEFT JOIN b USING (bank)""")
def n18(spark, sf):
    # the sentences are counted and used, so they are written once
    filtered = materialize(_filtered(spark, sf), "filtered")
    usable = materialize(_usable(spark, sf, filtered), "usable")
    items = N.balance(N.all_items(usable, LATIN), usable, 50)
    return N.generation_summary(filtered, items)
