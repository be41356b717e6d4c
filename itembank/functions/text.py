"""Text cleaning and normalising as column expressions.

Whitespace everywhere means the full Unicode set below, which is wider than the engine's own.
Lengths and cuts count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: whitespace, stripped punctuation, bullets, numbering -------------------------
# as a pattern class: Latin blanks are one table lookup, and one range check rules out the others for most characters
WS = r" \t\n\x0B\f\r\u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
STEM_STRIP = rf"[{WS},.;:()\[\]?!·\-_[\u2014-\uFF1F&&[，。、；：（）【】「」『』？！—]]]+"
BULLET_CHARS = WS_CHARS + "·•●○▪◦◆■□▶►※★☆*+>》」』-–—~"
NUMBERING = (
    r"^(?:\d{1,3}[、.．)）]|[（(]\d{1,3}[)）]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十]+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]+)"
    rf"(?=[{WS}]|[\u4e00-\u9fa5（）()《》“”【】]|\z)"
)
_ROUND = rf"[{WS}·•●○▪◦◆■□▶►※★☆*+>》」』\-–—~]*+(?:{NUMBERING[1:]})?+[{WS}]*+"
SCORE_PREFIX = rf"^[{WS}]*[\[【（(][{WS}]*(?:共[{WS}]*计?|总计?)?[{WS}]*\d{{1,3}}[{WS}]*分[{WS}]*[\]】）)][{WS}]*"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
TOPIC = r"[【\[]([^】\]]{1,20})[】\]]|（([^）]{1,10})）"
LINE_BREAK = r"\r\n|\r|\n"


def sub(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(repl))


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_ws(c: Column) -> Column:
    """Blanks off both ends, which are all that is looked at: a pattern would be tried at every character."""
    return F.btrim(c, F.lit(WS_CHARS))


def ltrim_ws(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def starts_with_letter(c: Column) -> Column:
    """Whether a text starts with a Latin letter, so that no bullet, number or heading mark can be there."""
    return F.ascii(c).bitwiseOR(32).between(97, 122)


def compact(c: Column) -> Column:
    return sub(F.replace(c, F.lit(" "), F.lit("")), rf"[{WS}]+")


def compact_len(c: Column) -> Column:
    return F.length(compact(c))


def collapse(c: Column) -> Column:
    return trim_ws(sub(c, rf"[{WS}]+", " "))


def clean_text(c: Column) -> Column:
    """No-break space to space; byte-order, zero-width and direction marks and CR dropped."""
    out = F.coalesce(c, F.lit(""))
    for char, repl in (("\u00a0", " "), ("\ufeff", ""), ("\u200b", ""), ("\u200e", ""), ("\u200f", ""), ("\r", "")):
        out = F.replace(out, F.lit(char), F.lit(repl))
    return out


def normalize_whitespace(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for char, repl in (("\ufeff", ""), ("\u200b", ""), ("\t", " "), ("\u3000", " ")):
        out = F.replace(out, F.lit(char), F.lit(repl))
    return trim_ws(sub(out, r" {2,}", " "))


def trim_bullets(c: Column) -> Column:
    """Drop leading bullets and blanks."""
    return F.ltrim(c, F.lit(BULLET_CHARS))


def strip_bullets(c: Column) -> Column:
    """Drop leading bullets and numbering, three rounds at most, by one pattern."""
    return trim_ws(sub(F.coalesce(c, F.lit("")), f"^{_ROUND * 3}"))


def normalize_stem(c: Column) -> Column:
    return sub(F.coalesce(c, F.lit("")), STEM_STRIP)


def strip_score(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return trim_ws(F.when(c.contains("分"), sub(c, SCORE_PREFIX)).otherwise(c))


def extract_year(c: Column) -> Column:
    """The smallest four-digit year of the text, null when there is none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(YEAR), F.lit(1))
    return F.array_min(F.transform(found, lambda y: y.cast("int")))


def extract_topic(c: Column) -> Column:
    """The leftmost bracketed topic, empty when there is none."""
    c = F.coalesce(c, F.lit(""))
    first = F.regexp_extract(c, TOPIC, 1)
    return trim_ws(F.when(first != "", first).otherwise(F.regexp_extract(c, TOPIC, 2)))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def cut(c: Column, n: int) -> Column:
    return truncate(collapse(F.coalesce(c, F.lit(""))), n)


def html_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_lines(c: Column) -> Column:
    return sub(html_escape(c), LINE_BREAK, "<br>")


def mask_secret(c: Column) -> Column:
    s = trim_ws(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= 8, F.repeat(F.lit("*"), F.length(s))).otherwise(
        F.concat(F.substring(s, 1, 4), F.lit("********"), F.substring(s, -4, 4))
    )


def bank_name(file_name: Column, default: str = "未命名题库", suffix: str = "") -> Column:
    base = trim_ws(sub(F.coalesce(file_name, F.lit("")), r"\.[^.]+\z"))
    return F.concat(F.when(base == "", default).otherwise(base), F.lit(suffix))
