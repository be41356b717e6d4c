"""Knowledge text to cloze, multiple-choice and true/false items.

Sentences, key terms and blanks are worked out inside the row. Only four things move data: counting
repeated header lines, carrying headings over a document, the pool of distractors, and the caps.
Distractors come from rings: the pool of a bank is ranked once, every item starts at a place given by
its own hash and joins the next few ranks by equality. Items not served by the first window are looked
up in an index of substrings: those that nothing can serve go, the others walk on, so nothing is cut off.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itembank.constants import FALSE_WORD, JUDGE, SINGLE, TRUE_WORD
from itembank.functions.questions import question_id
from itembank.functions.text import (
    WS, WS_CHARS, compact, compact_len, extract_topic, extract_year, ltrim_ws, normalize_stem, normalize_whitespace, starts_with_letter, strip_bullets,
    sub, trim_bullets, trim_ws,
)
from itembank.operators.ordering import first_rows, join_null_safe, keep_first, ordinal
from itembank.operators.segment import computed, staged
from itembank.session import materialize

# --- fixed values: thresholds -------------------------------------------------------------------
BLANK = "____"
MIN_SENTENCE, MIN_REST, MAX_BLANK, MAX_RATIO = 12, 8, 12, 0.4
LEN_TOLERANCE, DISTRACTORS = 3, 3
REPEAT_MIN, REPEAT_MAX_CHARS = 3, 30
TERM_HEAD, NAME_HEAD = 4, 3
SEED = 20240101
KIND_RANK = {"quote": 0, "term": 1, "name": 2, "number": 3, "en": 4}

# --- fixed values: sentence filters -----------------------------------------------------------------
PROMO = "公众号 扫码 点击 关注 加群 欢迎订阅 微信搜 小红书".split()
ANSWER_LINE = rf"^(?:解析|答案|参考答案|答|解答|出处)[{WS}]*[:：]"
HEADING_PREFIX = (
    r"^(?:第[一二三四五六七八九十百零\d]+[章节讲部分单元篇课]|[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十\d]+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]|\d+[、.．])"
)
PAGE_LINES = r"^(?:\d{1,4}|[-–—]?\d{1,4}[-–—]?|第\d+页(?:[/共]\d+页?)?|(?i:page)\d+(?:(?:(?i:of)|/)\d+)?|\d+/\d+)$"
TOC_LINES = r"^(?:[\d.、,，。()（）【】\-–—/=·…]+|目录|(?i:contents))$"
TOC_DOTS = r"\.{3,}\d+$"

# --- fixed values: term words -----------------------------------------------------------------------
TERMS = """太平天国运动 五四运动 辛亥革命 新民主主义革命 旧民主主义革命 新文化运动 洋务运动 戊戌变法 义和团运动 北伐战争 抗日战争 鸦片战争
甲午中日战争 解放战争 土地改革 改革开放 十一届三中全会 一国两制 社会主义 资本主义 帝国主义 封建主义 马克思主义 列宁主义 毛泽东思想 邓小平理论
三个代表重要思想 科学发展观 中国特色社会主义 社会主义市场经济 人民代表大会 政治协商会议 民族区域自治 五年计划 一带一路 脱贫攻坚 乡村振兴
供给侧结构性改革 共产主义 无产阶级 资产阶级 生产力 生产关系 经济基础 上层建筑 唯物史观 剩余价值学说 实践是检验真理的唯一标准
南京条约 辛丑条约 马关条约 北京条约 天津条约 人权宣言 独立宣言 共产党宣言 联合国宪章 中华人民共和国宪法
科举制度 郡县制 分封制 宗法制 井田制 均田制 三省六部制 君主立宪制 民主集中制 儒家思想 道家思想 法家思想 墨家思想 白话文 诗经 楚辞
光合作用 细胞分裂 生态系统 能量守恒定律 万有引力定律 相对论 量子力学 元素周期律 达尔文进化论 血液循环 免疫系统 神经系统 消化系统 呼吸系统""".split()
NAMES = """毛泽东 周恩来 邓小平 朱德 刘少奇 孙中山 李大钊 陈独秀 林则徐 洪秀全 康有为 梁启超 鲁迅 胡适 蔡元培 李鸿章 曾国藩 蒋介石 张学良 袁隆平
钱学森 邓稼先 华罗庚 陈景润 屠呦呦 马克思 恩格斯 列宁 斯大林 华盛顿 林肯 罗斯福 拿破仑 牛顿 爱因斯坦 达尔文 居里夫人 爱迪生 中国共产党 国民党
共青团 联合国 欧盟 世界贸易组织 中华人民共和国 中国人民解放军 中国科学院 中国社会科学院 北京大学 清华大学 复旦大学 浙江大学 国务院
全国人民代表大会 延安 井冈山 瑞金 遵义 南京 广州 武汉 西安 黄河 长江""".split()
QUOTES = [r"《([^》]{1,30})》", r"「([^」]{1,30})」", r"『([^』]{1,30})』", r"“([^”]{1,30})”", r'"([^"]{1,30})"']
NUMBERS = [
    rf"(?<![\d.])\d{{3,4}}[{WS}]*年(?:[{WS}]*\d{{1,2}}[{WS}]*月(?:[{WS}]*\d{{1,2}}[{WS}]*日)?)?",
    rf"(?<![\d.])\d{{1,2}}[{WS}]*月[{WS}]*\d{{1,2}}[{WS}]*日",
    rf"\d+(?:\.\d+)?[{WS}]*[%％]",
    rf"\d+[{WS}]*[:：][{WS}]*\d+",
    rf"\d+(?:\.\d+)?[{WS}]*(?:万|亿|千|百|多|余)?[{WS}]*(?:人|年|岁|次|个|种|项|倍|米|千米|公里|吨|元|美元|条|部|篇|届|级|名|所|座|件|艘|架|万|亿|千|百)",
    r"\d{2,}(?:\.\d+)?",
]
TERM_SUFFIXES = """主义 制度 革命 会议 条约 宣言 思想 政策 方针 路线 纲领 精神 原则 标准 方略 工程 计划 体系 机制 格局 运动 战争 变法 起义
改革 理论 学说 法案 公约 协定 联盟 学派""".split()
NAME_SUFFIXES = "大学 政府 公司 党 国 军 部 委 院 会 省 市 县".split()
MEASURE = r"^([一二三四五六七八九十两几]+[次个种场届项名位件条份座])"
BLOCKED = "的了是在为和与及对把被由使从就都也还又并则而且其此该这那将已"
PARTICLES = "的了在是为和与及对把被由使到从就都也还又并则而且其此该这那会能可要将已有以着过次个种项些条场名位件份座"
VERBS = """符合 达到 坚持 实行 进行 完成 实现 推动 促进 标志 成为 构成 属于 包括 建立 提出 采取 采用 使用 具有 形成 发生 出现 发展 提高 加强
保证 表明 说明 反映 决定 影响 要求 需要 依靠 利用 通过 制定 举行 召开 取得 赢得 结束 开始 沦为 侵犯""".split()
PERSON = r"([一-龥]{2,4})(?=(?:先生|同志|提出|领导|主持|创办|创建|发表|撰写|就任|当选|指挥|指出|牺牲|逝世))"
ACRONYM = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{1,5}(?![A-Za-z0-9])"
JUDGE_HINT = r"[0-9]|是|不是|属于|不属于|必须|可以|有|没有"
NEGATION = r"不(?=是|属于|可以|必须|同|正确|相同)|没(?=有)"
ADD_NEGATION = [("可以", "不可以", False), ("必须", "不必", False), ("属于", "不属于", False), ("是", "不是", True), ("有", "没有", True)]
GUARD = "但凡或若如是不要总就还也单"
PUNCTUATION = r"[，。、；：！？（）()【】《》“”‘’「」『』…—·,.;:!?]"


@dataclass(frozen=True)
class Lexicon:
    """Everything language-bound; the default is Chinese."""

    terminators: str = "。！？；!?;"
    terms: list[str] = field(default_factory=lambda: list(dict.fromkeys(TERMS)))
    names: list[str] = field(default_factory=lambda: list(dict.fromkeys(NAMES)))
    letters: str = "一-龥"
    term_suffixes: list[str] = field(default_factory=lambda: list(TERM_SUFFIXES))
    name_suffixes: list[str] = field(default_factory=lambda: list(NAME_SUFFIXES))
    judge_hint: str = JUDGE_HINT
    negation: str = NEGATION
    add_negation: list[tuple[str, str, bool]] = field(default_factory=lambda: list(ADD_NEGATION))
    guard: str = GUARD


def _s(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(_s(w) for w in words) + ")" if words else "cast(array() as array<string>)"


# --- sentences ----------------------------------------------------------------------------------


def prepared_lines(lines: DataFrame) -> DataFrame:
    """Lines cleaned for generation; blank ones dropped."""
    clean = computed(lines, text=normalize_whitespace(F.col("text")))
    return staged(clean, text=F.when(starts_with_letter(F.col("text")), F.col("text")).otherwise(strip_bullets(F.col("text")))).filter("text <> ''")


def drop_repeated_headers(lines: DataFrame) -> DataFrame:
    """Drop short lines that occur three times or more in a bank.

    Lines are written once with their keys. The repeated ones come from a map-side combined count
    that reads keys only, and are looked up by key. Long lines have no key and are not shuffled.
    """
    keyed = staged(lines, _key=compact(F.col("text")))
    short = (F.length("_key") <= REPEAT_MAX_CHARS) & ~F.col("_key").startswith("##")
    keyed = materialize(keyed.withColumn("_key", F.when(short, F.col("_key"))), "keyed")
    few = keyed.filter("_key IS NOT NULL")
    repeated = few.groupBy("bank", "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") >= REPEAT_MIN)
    rare = few.join(repeated.select("bank", "_key"), ["bank", "_key"], "left_anti")
    return keyed.filter("_key IS NULL").select(*lines.columns).unionByName(rare.select(*lines.columns))


def is_page_number(c: Column) -> Column:
    return F.when(~_may_be_page(ltrim_ws(c)), F.lit(False)).otherwise(compact(c).rlike(rf"^$|{PAGE_LINES}"))


def _may_be_page(c: Column) -> Column:
    """Of the texts that start with a Latin letter only those with the p of page."""
    return ~starts_with_letter(c) | F.ascii(c).isin(ord("P"), ord("p"))


def _all_but(ends: str) -> str:
    """The class of all characters but these: one table lookup for Latin ones, where a negated class asks for each in turn."""
    taken = sorted({ord(e) for e in ends if ord(e) > 0xFF})
    others = [(a + 1, b - 1) for a, b in zip([0xFF, *taken], [*taken, 0x110000], strict=True) if a + 1 < b]
    latin = "".join(f"\\x{{{i:x}}}" for i in range(0x100) if chr(i) not in ends)
    return "[" + latin + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in others) + "]"


def sentences(lines: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Lines to sentences, each keeping its terminator and its line's location."""
    ends = (lexicon or Lexicon()).terminators
    piece = f"({_all_but(ends)}*+[{ends}]|{_all_but(ends)}++)"
    if set(ends) & set(WS_CHARS):
        pieces = F.regexp_extract_all("text", F.lit(piece), F.lit(1))
        kept = F.filter(F.transform(pieces, trim_ws), lambda t: t != "")
    else:
        # a piece ends with its terminator or the trimmed line, so only blanks before it are left to skip
        kept = F.regexp_extract_all(trim_ws(F.col("text")), F.lit(f"[{WS}]*+{piece}"), F.lit(1))
    rest = [c for c in lines.columns if c != "text"]
    return lines.filter(~is_page_number(F.col("text"))).select(*rest, F.posexplode(kept).alias("sent", "text"))


def is_heading(raw: Column, bare: Column, squeezed: Column) -> Column:
    """``bare`` is the text without its first bullets, ``squeezed`` without bullets, numbers and blanks."""
    numbered = bare.rlike(HEADING_PREFIX)
    short = (F.length(squeezed) <= 16) & ~raw.rlike(r"[，,、：:；;]") & ~squeezed.rlike(r"[是了在为的有会能与]")
    return (squeezed != "") & (F.length(squeezed) <= 24) & ~raw.rlike(r"[。！？；]$") & (numbered | short)


def heading_text(raw: Column) -> Column:
    """The lambda has the patterns tried once, and keeps them out of the code generated around it: methods that grow too long stay uncompiled."""
    t = F.when(starts_with_letter(raw), trim_ws(raw)).otherwise(trim_ws(sub(strip_bullets(raw), HEADING_PREFIX)))
    return F.transform(F.array(t), lambda h: F.when(F.length(compact(h)) > 20, F.substring(h, 1, 20)).otherwise(h))[0]


def noise_reason(raw: Column, bare: Column, t: Column) -> Column:
    """Why a sentence cannot carry an item; empty when it can. ``t`` is the text without blanks."""
    n = F.length(t)
    # patterns are tried where the first letter or any Han letter allows a match; the word contents is shorter than a sentence
    contents = (t == "") | (~starts_with_letter(t) & t.rlike(TOC_LINES)) | (F.contains(t, F.lit("...")) & t.rlike(TOC_DOTS))
    promo = raw.rlike(r"[\u4e00-\u9fff]") & reduce(or_, [F.contains(raw, F.lit(w)) for w in PROMO])
    return (
        F.when(n < MIN_SENTENCE, "short").when(contents, "contents").when(_may_be_page(t) & t.rlike(PAGE_LINES), "page")
        .when(promo, "promo").when(~starts_with_letter(bare) & bare.rlike(ANSWER_LINE), "answer line")
        .when(starts_with_letter(raw) & raw.rlike(rf"^[A-Da-d][.、)）][{WS}]*[一-龥]"), "option line")
        .when((n < MIN_SENTENCE + 2) & raw.rlike(rf"^[（(]?[{WS}]*\d+[{WS}]*[)）][{WS}]*[一-龥]"), "numbered fragment")
        .otherwise("")
    )


def filter_sentences(sents: DataFrame) -> DataFrame:
    """Add reason: heading, one of the noise reasons, or empty for a usable sentence."""
    raw = F.col("text")
    bare = starts_with_letter(raw)
    rows = computed(sents, _t=compact(raw))
    rows = staged(
        rows, _bare=F.when(bare, raw).otherwise(trim_bullets(raw)), _squeezed=F.when(bare, F.col("_t")).otherwise(compact(strip_bullets(raw)))
    )
    head = is_heading(raw, F.col("_bare"), F.col("_squeezed"))
    return staged(rows, reason=F.when(head, "heading").otherwise(noise_reason(raw, F.col("_bare"), F.col("_t")))).drop("_bare", "_squeezed", "_t")


def carry_topics(filtered: DataFrame) -> DataFrame:
    """The last heading above each sentence of its document, empty before the first."""
    w = Window.partitionBy("bank", "doc_id").orderBy("pos", "sent").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("reason") == "heading", heading_text(F.col("text")))
    return filtered.withColumn("topic", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("")))


def usable_with_topics(filtered: DataFrame) -> DataFrame:
    """The usable sentences with their topics; only they and the headings are moved."""
    return carry_topics(filtered.filter("reason IN ('', 'heading')")).filter("reason = ''").drop("reason")


# --- key terms ---------------------------------------------------------------------------------


_NO_PLACES = "cast(array() as array<struct<term:string,index:int>>)"
_NO_HITS = "cast(array() as array<struct<term:string,kind:string,index:int,weight:int>>)"


def _matches(text: str, pattern: str, group: int = 0) -> str:
    """Array of (term, index) of a pattern's matches, 0-based; ``group`` 1 takes what the marks enclose.

    Most texts have none, which one search tells.
    """
    lead = 1 if group else 0
    marked = f"split(regexp_replace({text}, {_s(pattern)}, '\\u0001${group}\\u0002{'$0' if group else ''}\\u0003'), '\\u0001')"
    if group:
        # the whole match follows its inner text, so its length advances the position
        step = "s.at + length(substring_index(substring_index(p, '\\u0003', 1), '\\u0002', -1)) + length(substring_index(p, '\\u0003', -1))"
    else:
        step = "s.at + length(substring_index(p, '\\u0002', 1)) + length(substring_index(p, '\\u0003', -1))"
    return f"""if({text} rlike {_s(pattern)}, transform(array({marked}), m -> aggregate(slice(m, 2, greatest(size(m) - 1, 0)),
        named_struct('at', length(m[0]), 'out', cast(array() as array<struct<term:string,index:int>>)),
        (s, p) -> named_struct('at', {step}, 'out', array_append(s.out,
            named_struct('term', substring_index(p, '\\u0002', 1), 'index', s.at + {lead}))),
        s -> s.out))[0], {_NO_PLACES})"""


def _word_hits(text: str, words: list[str]) -> str:
    """Array of (term, index) of the occurrences of every word; those of different words may overlap.

    Occurrences are counted first; what precedes each of them tells its place. For a word that
    ends as it begins the text is cut before every occurrence, so the pieces that begin with the word tell the places.
    """
    if not words:
        return _NO_PLACES
    n = "cast((octet_length({0}) - octet_length(replace({0}, d, ''))) div octet_length(d) as int)".format(text)
    places = f"transform(sequence(1, {n}), k -> named_struct('term', d, 'index', length(substring_index({text}, d, k))))"
    looped = [w for w in words if not w or any(w.startswith(w[i:]) for i in range(1, len(w)))]
    if looped:
        before = f"{_s('(?=' + chr(92) + 'Q')} || d || {_s(chr(92) + 'E)')}"
        places = f"""if(array_contains({_list(looped)}, d), transform(array(split({text}, {before})), ps -> transform(filter(transform(ps,
            (p, k) -> named_struct('hit', startswith(p, d), 'at', aggregate(slice(ps, 1, k), 0, (n, q) -> n + length(q)))), x -> x.hit),
            x -> named_struct('term', d, 'index', x.at)))[0], {places})"""
    return f"flatten(transform(filter({_list(words)}, d -> contains({text}, d)), d -> {places}))"


def _as_hits(rows: str, kind: str, weight: str) -> str:
    return f"transform({rows}, h -> named_struct('term', h.term, 'kind', '{kind}', 'index', h.index, 'weight', {weight}))"


def _suffix_hits(text: str, lex: Lexicon, names: bool) -> str:
    """Terms formed by a suffix and the few letters before it, trimmed of particles and verbs."""
    words = lex.name_suffixes if names else lex.term_suffixes
    if not words:
        return _NO_HITS
    head_max = NAME_HEAD if names else TERM_HEAD
    head = (
        f"regexp_extract(substring({text}, greatest(h.index - {head_max - 1}, 1), least(h.index, {head_max})), '([{lex.letters}]*)$', 1)"
    )
    if names:
        trim = f"if(length(t) > 2 AND contains('{PARTICLES}', substring(t, 1, 1)), substring(t, 2), t)"
        ok = f"""length(x.t) BETWEEN 2 AND {MAX_BLANK} AND (x.end = length(x.t)
            OR NOT substring({text}, x.end - length(x.t), 1) rlike '[{lex.letters}]'
            OR contains('{PARTICLES}', substring({text}, x.end - length(x.t), 1)))"""
        kind = "name"
    else:
        measure = f"length(regexp_extract(t, {_s(MEASURE)}, 1))"
        verb = f"length(coalesce(try_element_at(filter({_list(VERBS)}, v -> startswith(t, v)), 1), ''))"
        trim = f"""CASE WHEN length(t) <= 3 THEN t WHEN contains('{PARTICLES}', substring(t, 1, 1)) THEN substring(t, 2)
            WHEN {measure} > 0 AND length(t) - {measure} >= 3 THEN substring(t, {measure} + 1)
            WHEN {verb} > 0 AND length(t) - {verb} >= 3 THEN substring(t, {verb} + 1) ELSE t END"""
        ok = f"length(x.t) BETWEEN 3 AND {MAX_BLANK} AND NOT substring(x.t, 1, length(x.t) - x.n) rlike '[{BLOCKED}]'"
        kind = "term"
    # particles, measures and verbs are Han words, so there is nothing to trim where a Latin letter comes first
    trimmed = f"if(ascii(w.t) < 256, w.t, aggregate(sequence(1, 4), w.t, (t, i) -> {trim}))"
    found = f"transform({_word_hits(text, words)}, h -> named_struct('t', concat({head}, h.term), 'n', length(h.term), 'end', h.index + length(h.term)))"
    rows = f"transform({found}, w -> named_struct('t', {trimmed}, 'n', w.n, 'end', w.end))"
    return f"""transform(filter({rows}, x -> {ok}),
        x -> named_struct('term', x.t, 'kind', '{kind}', 'index', cast(x.end - length(x.t) as int), 'weight', 0))"""


def pattern_hits(lex: Lexicon, text: str = "text") -> list[str]:
    """Hits of quotes, dictionaries, numbers and acronyms."""
    quotes = [
        f"filter({_as_hits(_matches(text, p, 1), 'quote', 'length(h.term)')}, h -> NOT h.term rlike '[。！？；，,;]')" for p in QUOTES
    ]
    numbers = [_as_hits(_matches(text, p), "number", "0") for p in NUMBERS]
    # one search tells whether any of a group of patterns can match
    return [
        f"if({' OR '.join(f'contains({text}, {_s(q[0])})' for q in QUOTES)}, concat({', '.join(quotes)}), {_NO_HITS})",
        _as_hits(_word_hits(text, lex.terms), "term", "length(h.term)"),
        _as_hits(_word_hits(text, lex.names), "name", "length(h.term)"),
        f"if({text} rlike '[0-9]', concat({', '.join(numbers)}), {_NO_HITS})",
        f"if({text} rlike '[A-Z][A-Z0-9]', {_as_hits(_matches(text, ACRONYM), 'en', '0')}, {_NO_HITS})",
    ]


def key_terms(usable: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Add raw: every candidate of a sentence as (term, kind, index, weight), from all detectors."""
    lex = lexicon or Lexicon()
    parts = [
        *pattern_hits(lex), _suffix_hits("text", lex, names=False), _suffix_hits("text", lex, names=True),
        _as_hits(_matches("text", PERSON), "name", "length(h.term)"),
    ]
    # an explode above would have the detectors run a second time, to leave out empty arrays
    return staged(usable, raw=F.expr(f"concat({', '.join(parts)})"))


def _kind_rank(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in KIND_RANK.items()) + " ELSE 9 END"


def resolve_overlaps(with_raw: DataFrame) -> DataFrame:
    """Add hits: candidates kept greedily by kind, weight, length and place, in reading order."""
    ranked = f"""array_sort(transform(raw, h -> named_struct('k', {_kind_rank('h.kind')}, 'w', -h.weight, 'l', -length(h.term), 'i', h.index,
        'term', h.term, 'kind', h.kind)))"""
    kept = f"""aggregate({ranked}, cast(array() as array<struct<k:int,w:int,l:int,i:int,term:string,kind:string>>),
        (out, h) -> if(exists(out, o -> h.i < o.i - o.l AND o.i < h.i - h.l), out, array_append(out, h)))"""
    return with_raw.withColumn(
        "hits",
        F.expr(f"""if(size(raw) < 2, raw,
            transform(array_sort(transform({kept}, h -> named_struct('index', h.i, 'l', h.l, 'term', h.term, 'kind', h.kind, 'weight', -h.w))),
            h -> named_struct('term', h.term, 'kind', h.kind, 'index', h.index, 'weight', h.weight)))"""),
    ).drop("raw")


def blanks(with_hits: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Add blanks: for every hit the text to blank; a term keeps its suffix in the sentence."""
    lex = lexicon or Lexicon()
    suffix = f"try_element_at(filter({_list(lex.term_suffixes)}, f -> endswith(h.term, f) AND length(h.term) > length(f) + 1), 1)"
    text = f"if(h.kind = 'term', substring(h.term, 1, length(h.term) - length(coalesce({suffix}, ''))), h.term)"
    squeezed = f"length(regexp_replace(b.text, '[{WS}]+', ''))".replace("\\", "\\\\")
    return with_hits.withColumn(
        "blanks",
        F.expr(f"""transform(transform(hits, h -> named_struct('text', {text}, 'kind', h.kind, 'start', h.index, 'weight', h.weight)),
            b -> named_struct('text', b.text, 'kind', b.kind, 'start', b.start, 'weight', b.weight, 'len', {squeezed}))"""),
    )


def blankable(with_blanks: DataFrame) -> DataFrame:
    """Add choices: the blanks worth asking, best first."""
    rows = staged(with_blanks, _n=F.when(F.size("blanks") > 0, compact_len(F.col("text"))).otherwise(0))
    ok = f"""b.len >= 1 AND b.len <= {MAX_BLANK} AND (b.len >= 2 OR b.kind = 'number') AND b.len <= _n * {MAX_RATIO}D AND _n - b.len >= {MIN_REST}"""
    return rows.withColumn(
        "choices",
        F.expr(f"""transform(array_sort(transform(filter(blanks, b -> {ok}), b -> named_struct('k', {_kind_rank('b.kind')}, 'w', -b.weight,
            'l', -length(b.text), 'start', b.start, 'text', b.text, 'kind', b.kind, 'len', b.len))),
            b -> named_struct('text', b.text, 'kind', b.kind, 'start', b.start, 'len', b.len))"""),
    ).drop("_n")


def top_blanks(with_choices: DataFrame, k: int = 1) -> DataFrame:
    """The best ``k`` blanks of each sentence with distinct starts, one row each."""
    distinct = "filter(choices, (b, i) -> NOT exists(slice(choices, 1, i), o -> o.start = b.start))"
    rest = [c for c in with_choices.columns if c not in ("choices", "blanks", "hits")]
    return with_choices.selectExpr(*rest, f"posexplode(slice({distinct}, 1, {k})) AS (blank_no, b)").selectExpr(
        *rest, "blank_no", "b.text AS blank", "b.kind AS kind", "b.start AS start", "b.len AS len"
    )


def cloze(text: Column, blank: Column, start: Column) -> Column:
    """The sentence with the blank cut out and set off by spaces unless punctuation is near."""
    before = F.substring(text, F.lit(1), start)
    after = F.substring(text, start + F.length(blank) + 1, F.length(text))
    left = F.when((before != "") & ~before.rlike(rf"[{WS}]$") & ~F.substring(before, -1, 1).rlike(PUNCTUATION), " ").otherwise("")
    right = F.when((after != "") & ~after.rlike(rf"^[{WS}]") & ~F.substring(after, 1, 1).rlike(PUNCTUATION), " ").otherwise("")
    return sub(F.concat(before, left, F.lit(BLANK), right, after), r" {2,}", " ")


# --- items ----------------------------------------------------------------------------------------

SENT = ["bank", "doc_id", "pos", "sent"]


def usable_sentences(lines: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Lines to usable sentences with topic, hits, blanks and choices."""
    sents = sentences(drop_repeated_headers(prepared_lines(lines)), lexicon)
    ready = usable_with_topics(filter_sentences(sents))
    return blankable(blanks(resolve_overlaps(key_terms(ready, lexicon)), lexicon))


def distractor_pool(usable: DataFrame) -> DataFrame:
    """Distinct blanks of a bank by normalised text, the first occurrence speaking for all."""
    rows = usable.selectExpr(*SENT, "posexplode(blanks) AS (n, b)").selectExpr(
        *SENT, "n", "b.text AS text", "b.kind AS kind", "b.len AS len"
    )
    rows = staged(rows, key=normalize_stem(F.col("text"))).filter(
        f"key <> '' AND len <= {MAX_BLANK} AND len >= if(kind = 'number', 1, 2)"
    )
    return rows.groupBy("bank", "key").agg(
        F.min_by(F.struct("text", "kind", "len"), F.struct("doc_id", "pos", "sent", "n")).alias("_r")
    ).select("bank", "key", "_r.*")


def hash_int(*cols: Column) -> Column:
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def rank_pool(pool: DataFrame, seed: int = SEED) -> DataFrame:
    """Places of a pool term on its two rings: (bank, kind) by length and hash, and bank by hash."""
    hashed = pool.withColumn("_h", F.sha1(F.concat_ws("|", F.lit(str(seed)), "key")))
    by_kind = ordinal(hashed, ["bank", "kind"], ["len", "_h", "key"], "kind_rank")
    return ordinal(by_kind, ["bank"], ["_h", "key"], "bank_rank").drop("_h")


def _substrings(text: str, most: str) -> str:
    """The distinct substrings of a text of at most so many characters."""
    return f"""array_distinct(flatten(transform(sequence(1, length({text})), i ->
        transform(sequence(1, least({most}, length({text}) - i + 1)), l -> substring({text}, i, l)))))"""


def servable(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Those of the items (with own_key, packed and n2) that have three distractors at all, found without a walk.

    Pool keys are short, so their substrings, counted once, tell how many keys contain an
    answer; keys that an answer or a sentence contains are met by equality with its own
    substrings. What the pool has beyond these fits.
    """
    pool = ranked.select("bank", "key", compact(F.col("text")).alias("spelling"))
    wanted = items.select("bank", F.col("own_key").alias("sub")).distinct()
    parts = pool.selectExpr("bank", f"explode({_substrings('key', 'length(key)')}) AS sub")
    around = join_null_safe(parts, wanted, ["bank", "sub"], "left_semi").groupBy("bank", "sub").agg(F.count("*").alias("_around"))
    inner = items.select(*SENT, "blank_no", "own_key", "packed")
    by_key = inner.filter("own_key <> ''").selectExpr("*", f"explode({_substrings('own_key', 'length(own_key)')}) AS key")
    by_text = inner.filter("packed <> ''").selectExpr("*", f"explode({_substrings('packed', str(MAX_BLANK))}) AS spelling")
    met = join_null_safe(by_key, pool.select("bank", "key"), ["bank", "key"]).select(*SENT, "blank_no", "own_key", "key").unionByName(
        join_null_safe(by_text, pool, ["bank", "spelling"]).select(*SENT, "blank_no", "own_key", "key")
    )
    inside = met.distinct().filter(~F.contains("key", F.col("own_key"))).groupBy(*SENT, "blank_no").agg(F.count("*").alias("_inside"))
    told = join_null_safe(items, around.withColumnRenamed("sub", "own_key"), ["bank", "own_key"], "left")
    told = join_null_safe(told, inside, [*SENT, "blank_no"], "left")
    fit = F.col("n2") - F.coalesce("_around", F.lit(0)) - F.coalesce("_inside", F.lit(0))
    return told.filter((F.col("own_key") != "") & (fit >= DISTRACTORS)).select(*items.columns)


def pick_distractors(items: DataFrame, ranked: DataFrame, seed: int = SEED, window: int = 16, widest: int = 4096) -> DataFrame:
    """Three distractors for every item that has them: (item columns, distractors).

    Same kind and similar length come first, in ring order from the item's own start; then the
    whole bank, likewise. A candidate must differ from the answer, neither may contain the other,
    and it must not occur in the sentence. Items still short after the first window are tested
    for servability and go on from where they stopped, by windows of ``widest`` candidates at most.
    """
    id_cols = [*SENT, "blank_no"]
    ranked = materialize(ranked, "ring")
    lens = ranked.groupBy("bank", "kind", "len").agg(F.count("*").alias("n"))
    sizes = lens.groupBy("bank", "kind").agg(F.collect_list(F.struct("len", "n")).alias("_lens"))
    totals = lens.groupBy("bank").agg(F.sum("n").alias("n2"))
    todo = (
        join_null_safe(join_null_safe(items, totals, ["bank"]), sizes, ["bank", "kind"], "left")
        .withColumn("_lens", F.coalesce("_lens", F.expr("cast(array() as array<struct<len:int,n:bigint>>)")))
        .withColumn("lo", F.expr(f"aggregate(_lens, 0L, (s, x) -> s + if(x.len < len - {LEN_TOLERANCE}, x.n, 0L))"))
        .withColumn("n1", F.expr(f"aggregate(_lens, 0L, (s, x) -> s + if(abs(x.len - len) <= {LEN_TOLERANCE}, x.n, 0L))"))
        .withColumn("at", hash_int(F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))
        .drop("_lens")
    )
    todo = staged(todo, own_key=normalize_stem(F.col("blank")), packed=compact(F.col("text")))
    todo = todo.withColumn("got", F.expr("cast(array() as array<string>)"))
    done, start, cut = None, 0, window
    while True:
        found = _ring_window(todo, ranked, start, cut, id_cols)
        state = join_null_safe(todo, found, id_cols, "left").withColumn(
            "got", F.expr(f"slice(concat(got, coalesce(more, cast(array() as array<string>))), 1, {DISTRACTORS})")
        )
        state = materialize(state.drop("more"), "distractors")
        full = state.filter(F.size("got") >= DISTRACTORS).select(*items.columns, F.col("got").alias("distractors"))
        done = full if done is None else done.unionByName(full)
        start, first = start + cut, start == 0
        cut = min(cut * 4, widest)
        left = state.filter((F.size("got") < DISTRACTORS) & (F.col("n1") + F.col("n2") > start))
        if left.isEmpty():
            return done
        todo = materialize(servable(left, ranked), "servable") if first else left


def _ring_window(todo: DataFrame, ranked: DataFrame, start: int, cut: int, id_cols: list[str]) -> DataFrame:
    """more: the first distractors among the ``cut`` candidates of each item from ``start`` on."""
    slots = todo.filter(F.col("n1") + F.col("n2") > start).withColumn(
        "j", F.explode(F.expr(f"sequence({start}L, least({start + cut}L, n1 + n2) - 1)"))
    ).withColumn("tier", F.when(F.col("j") < F.col("n1"), 1).otherwise(2))
    near = slots.filter("tier = 1").withColumn("kind_rank", F.expr("lo + (at + j) % n1 + 1"))
    far = slots.filter("tier = 2").withColumn("bank_rank", F.expr("(at + j - n1) % n2 + 1"))
    p = ranked.select("bank", "key", F.col("text").alias("cand"), F.col("kind").alias("cand_kind"), F.col("len").alias("cand_len"), "kind_rank", "bank_rank")
    a = join_null_safe(near, p.withColumnRenamed("cand_kind", "kind").drop("bank_rank"), ["bank", "kind", "kind_rank"]).select(
        *id_cols, "j", "own_key", "packed", "key", "cand"
    )
    b = join_null_safe(far, p.drop("kind_rank"), ["bank", "bank_rank"]).filter(
        ~((F.col("cand_kind") == F.col("kind")) & (F.abs(F.col("cand_len") - F.col("len")) <= LEN_TOLERANCE))
    ).select(*id_cols, "j", "own_key", "packed", "key", "cand")
    fit = (
        ~F.contains("key", F.col("own_key")) & ~F.contains("own_key", F.col("key")) & ~F.contains("packed", compact(F.col("cand")))
    )
    return (
        a.unionByName(b).filter(fit).groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("j", "cand"))).alias("_c"))
        .select(*id_cols, F.expr(f"transform(slice(_c, 1, {DISTRACTORS}), c -> c.cand)").alias("more"))
    )


def _question(df: DataFrame, kind: str, stem: Column, qtype: str, options: Column, answer: Column, note: Column | None = None) -> DataFrame:
    note = F.lit("") if note is None else note
    rows = df.select(
        *SENT, F.lit(kind).alias("kind"), stem.alias("stem"), F.lit(qtype).alias("qtype"), options.alias("options"),
        answer.alias("answer"), F.concat(F.lit("出自原文："), F.col("text"), note).alias("explanation"), "topic", F.col("text").alias("raw"),
        "page", "line", "para",
    )
    return rows.withColumn("qid", question_id(F.col("stem"), F.col("options"))).withColumn("year", extract_year(F.col("stem"))).withColumn(
        "topic", F.coalesce(F.nullif("topic", F.lit("")), extract_topic(F.col("stem")))
    )


def cloze_items(usable: DataFrame) -> DataFrame:
    best = top_blanks(usable, 1)
    return _question(best, "fill", cloze(F.col("text"), F.col("blank"), F.col("start")), SINGLE, F.create_map(F.lit("A"), "blank"), F.lit("A"))


def choice_items(usable: DataFrame, seed: int = SEED, ranked: DataFrame | None = None) -> DataFrame:
    """Items with four options in an order given by hashes; the answer points at the right one."""
    ranked = rank_pool(distractor_pool(usable), seed) if ranked is None else ranked
    picked = pick_distractors(top_blanks(usable, 1), ranked, seed)
    order = f"sha1(concat_ws('|', '{seed}', doc_id, pos, sent, c))"
    picked = picked.withColumn(
        "_opts", F.expr(f"transform(array_sort(transform(array_prepend(distractors, blank), c -> struct({order} AS h, c AS c))), x -> x.c)")
    )
    options = F.map_from_arrays(F.split(F.lit("ABCD"), ""), F.col("_opts"))
    answer = F.substring(F.lit("ABCD"), F.array_position("_opts", F.col("blank")).cast("int"), F.lit(1))
    return _question(picked, "choice", cloze(F.col("text"), F.col("blank"), F.col("start")), SINGLE, options, answer)


def mutate(df: DataFrame, lexicon: Lexicon | None = None, seed: int = SEED) -> DataFrame:
    """Add mutated (null when nothing can be changed) and note.

    The first number moves; failing that a negation goes; failing that one is put in.
    """
    lex = lexicon or Lexicon()
    first = "try_element_at(filter(hits, h -> h.kind = 'number'), 1)"
    rows = df.withColumn("_num", F.expr(first)).withColumn("_hash", F.sha1(F.concat_ws("|", F.lit(str(seed)), "text")))
    digits = F.regexp_extract(F.col("_num.term"), r"(\d+(?:\.\d+)?)", 1)
    rows = staged(
        rows, _sample=F.coalesce(digits, F.lit("")),
        _roll=F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint"), _up=F.substring("_hash", 9, 1) < "8",
        _at=F.col("_num.index") + F.length(F.regexp_extract(F.col("_num.term"), r"^(\D*)", 1)),
    )
    whole = F.substring_index("_sample", ".", 1).try_cast("decimal(38,0)")
    frac = F.when(F.contains("_sample", F.lit(".")), F.concat(F.lit("."), F.substring_index("_sample", ".", -1))).otherwise("")
    term = F.col("_num.term")
    size = (
        F.when(term.rlike(rf"^\d{{3,4}}[{WS}]*年"), F.col("_roll") % 5 + 1).when(term.rlike("[%％]"), F.lit(10).cast("bigint"))
        .otherwise(F.lit(1).cast("bigint"))
    )
    rows = staged(rows, _whole=whole, _frac=frac, _size=size, _pct=F.coalesce(term.rlike("[%％]"), F.lit(False)))
    moved = F.col("_whole") + F.when(F.col("_up"), F.col("_size")).otherwise(-F.col("_size"))
    zero = F.col("_pct") & (moved == 0) & ~F.col("_frac").rlike("[1-9]")
    fixed = F.when((moved < 0) | zero, F.col("_whole") + F.col("_size")).otherwise(moved)
    rows = staged(rows, _new=F.concat(fixed.cast("string"), F.col("_frac")))
    t = F.col("text")
    by_number = F.concat(
        F.substring(t, F.lit(1), F.col("_at")), "_new", F.substring(t, F.col("_at") + F.length("_sample") + 1, F.length(t))
    )
    cut = F.regexp_extract(t, rf"(?s)^(.*?)({lex.negation})", 2)
    by_cut = sub(t, rf"(?s)^(.*?)(?:{lex.negation})", "$1")
    add = F.lit(None).cast("struct<text:string,note:string>")
    for word, repl, guard in reversed(lex.add_negation):
        pattern = rf"(?s)^(.*?)(?<![{lex.guard}]){word}" if guard and lex.guard else rf"(?s)^(.*?){word}"
        add = F.when(
            t.rlike(pattern), F.struct(sub(t, pattern, f"$1{repl}").alias("text"), F.lit(f"把「{word}」改成了「{repl}」").alias("note"))
        ).otherwise(add)
    change = (
        F.when(
            F.col("_new").isNotNull() & (F.col("_sample") != ""),
            F.struct(by_number.alias("text"), F.concat(F.lit("把「"), "_sample", F.lit("」改成了「"), "_new", F.lit("」")).alias("note")),
        )
        .when(cut != "", F.struct(by_cut.alias("text"), F.concat(F.lit("删去了原文中的「"), cut, F.lit("」")).alias("note")))
        .otherwise(add)
    )
    return staged(rows, _m=change).withColumn("mutated", F.col("_m.text")).withColumn("note", F.col("_m.note")).drop(
        "_num", "_hash", "_sample", "_roll", "_up", "_at", "_whole", "_frac", "_size", "_pct", "_new", "_m"
    )


def sentence_numbers(usable: DataFrame, name: str = "n") -> DataFrame:
    """Number the sentences of a bank in document order."""
    return ordinal(usable, ["bank"], ["doc_id", "pos", "sent"], name)


def judge_items(usable: DataFrame, lexicon: Lexicon | None = None, seed: int = SEED) -> DataFrame:
    """True/false items, true and false by turns; a sentence that cannot be falsified stays true."""
    lex = lexicon or Lexicon()
    fit = sentence_numbers(usable.filter(F.col("text").rlike(lex.judge_hint)))
    rows = mutate(fit, lex, seed)
    false = (F.col("n") % 2 == 0) & F.col("mutated").isNotNull()
    rows = rows.withColumn("_stem", F.when(false, F.col("mutated")).otherwise(F.col("text"))).withColumn(
        "_answer", F.when(false, FALSE_WORD).otherwise(TRUE_WORD)
    ).withColumn("_note", F.when(false, F.concat(F.lit("\n（本题改动："), "note", F.lit("）"))).otherwise(""))
    empty = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    return _question(rows, "judge", F.col("_stem"), JUDGE, empty, F.col("_answer"), F.col("_note"))


def balance(items: DataFrame, usable: DataFrame, count: int, per_sentence: int = 1) -> DataFrame:
    """Take at most ``per_sentence`` items of a sentence, kinds by turns, and ``count`` of a bank."""
    place = {"fill": 0, "choice": 1, "judge": 2}
    kind_no = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in place.items()) + " END")
    numbered = items.join(sentence_numbers(usable.select(*SENT)), SENT)
    turn = numbered.withColumn("_turn", F.pmod(kind_no - F.col("n"), F.lit(3)))
    w = Window.partitionBy(*SENT).orderBy("_turn")
    chosen = turn.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= per_sentence)
    # by a window, whose columns stay apart: what the caller does not read is neither worked out nor moved
    unique = first_rows(chosen, ["bank", "qid"], ["doc_id", "pos", "sent", "_i"], 1, "_u")
    by_kind = first_rows(unique, ["bank", "kind"], ["n", "_i"], count, "_rn")
    return first_rows(by_kind.withColumn("_k", kind_no), ["bank"], ["_rn", "_k"], count, "ord").drop("_turn", "_i", "_u", "_rn", "_k", "n")


def all_items(usable: DataFrame, lexicon: Lexicon | None = None, seed: int = SEED) -> DataFrame:
    return cloze_items(usable).unionByName(choice_items(usable, seed)).unionByName(judge_items(usable, lexicon, seed))


def generate(lines: DataFrame, count: int = 50, per_sentence: int = 1, lexicon: Lexicon | None = None, seed: int = SEED) -> DataFrame:
    """Lines to a balanced, capped set of items per bank."""
    usable = materialize(usable_sentences(lines, lexicon), "usable")
    return balance(all_items(usable, lexicon, seed), usable, count, per_sentence)


def generation_summary(filtered: DataFrame, items: DataFrame) -> DataFrame:
    """Sentence and item counts of each bank."""
    s = filtered.groupBy("bank").agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "").alias("usable"))
    q = items.groupBy("bank").agg(
        F.count("*").alias("questions"), F.count_if(F.col("qtype") == JUDGE).alias("judge"),
        F.count_if((F.col("qtype") != JUDGE) & (F.size("options") > 1)).alias("choice"),
        F.count_if((F.col("qtype") != JUDGE) & (F.size("options") <= 1)).alias("fill"),
        F.count_distinct("doc_id", "pos", "sent").alias("_used"),
    )
    return s.join(q, "bank", "left").fillna(0).withColumn("skipped", F.col("total") - F.col("_used")).drop("_used")
