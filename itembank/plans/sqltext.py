"""Text helpers written as DuckDB expressions (no lookaround, its own whitespace class)."""

SWS = r"\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
STEM_CLASS = rf"[{SWS}，。、,.;；:：（）()【】\[\]「」『』？?！!·\-—_]+"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def rep1(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)})"


def strim(c: str) -> str:
    return rep(c, rf"^[{SWS}]+|[{SWS}]+$")


def scompact(c: str) -> str:
    return rep(c, rf"[{SWS}]+")


def scollapse(c: str) -> str:
    return strim(rep(c, rf"[{SWS}]+", " "))


def sclean(c: str) -> str:
    return rep(rep(c, r"\x{00A0}", " "), r"[\x{FEFF}\x{200B}\x{200E}\x{200F}\r]")


def snormws(c: str) -> str:
    return strim(rep(rep(rep(c, r"[\x{FEFF}\x{200B}]"), r"[\t\x{3000}]+", " "), " {2,}", " "))


def sstem(c: str) -> str:
    return rep(c, STEM_CLASS)


def sqid(c: str) -> str:
    return f"substr(sha1({sstem(c)}), 1, 16)"


BULLET = rf"^[{SWS}·•●○▪◦◆■□▶►※★☆*+>》」』\-–—~]+"
LEAD = (
    r"^(?:\d{1,3}[、.．)）]|[（(]\d{1,3}[)）]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]+)"
    rf"([{SWS}\x{{4e00}}-\x{{9fa5}}（）()《》“”【】]|$)"
)


def sbullets(c: str) -> str:
    for _ in range(3):
        c = rep1(rep1(rep1(c, BULLET), LEAD, r"\1"), rf"^[{SWS}]+")
    return strim(c)


def schoice(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(upper({c}), '[A-J]'))), '')"


TRUE_SQL = "('正确','对','是','T','TRUE','Y','YES','√','✓','V','1','对的','正确的')"
FALSE_SQL = "('错误','错','否','不对','不是','F','FALSE','N','NO','×','X','✗','0','错的','错误的')"
LITERAL_SQL = (
    "('正确','错误','对','错','是','否','对的','错的','正确的','错误的','不对','√','✓','×','✗','v','V','x','X','t','T','f','F')"
)


def sjudge(c: str) -> str:
    s = scompact(f"upper({c})")
    return f"CASE WHEN {s} IN {TRUE_SQL} THEN '正确' WHEN {s} IN {FALSE_SQL} THEN '错误' ELSE '' END"


def stoken(v: str) -> str:
    """``v`` must already be trimmed of whitespace and answer punctuation."""
    w = f"[{SWS}]*"
    return (
        f"CASE WHEN {v} = '' THEN '' "
        f"WHEN regexp_full_match({v}, {q(f'[(（]?{w}[A-Ha-h]{{1,6}}{w}[)）]?')}) THEN {schoice(v)} "
        f"WHEN regexp_full_match({v}, {q(f'[A-Ha-h](?:{w}[、,，/{SWS}]{w}[A-Ha-h]){{1,5}}')}) THEN {schoice(v)} "
        f"WHEN length({v}) <= 4 AND {v} IN {LITERAL_SQL} THEN {sjudge(v)} "
        f"WHEN regexp_matches({v}, '^[A-Ha-h]{{1,6}}([^A-Za-z0-9]|$)') THEN {schoice(f'''regexp_extract({v}, '^([A-Ha-h]{{1,6}})', 1)''')} "
        f"ELSE '' END"
    )


def strim_answer(c: str) -> str:
    return f"trim({strim(c)}, '。．.；;：:、,，)）]】 ' || chr(9) || chr(12288))"


def syear(c: str) -> str:
    return (
        f"list_min(list_transform(list_filter(regexp_split_to_array({c}, '[^0-9]+'), lambda x: regexp_full_match(x, '(19|20)[0-9]{{2}}')), "
        "lambda x: CAST(x AS INT)))"
    )


TOPIC_SQL = r"[【\[]([^】\]]{1,20})[】\]]|（([^）]{1,10})）"


def stopic(c: str) -> str:
    return f"trim(coalesce(nullif(regexp_extract({c}, {q(TOPIC_SQL)}, 1), ''), regexp_extract({c}, {q(TOPIC_SQL)}, 2)))"
