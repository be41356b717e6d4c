"""Quality rules: a threshold table compiled into one projection of ratios of a text; columns only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import documents

#: The words that running prose of a language cannot do without.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this", "from", "are",
    "der", "die", "das", "und", "ist", "den", "nicht", "mit", "von", "zu", "ein", "eine", "auf", "im", "dem", "des",
    "le", "la", "les", "et", "des", "une", "du", "est", "que", "qui", "dans", "pour", "pas", "sur", "par", "au",
    "el", "los", "las", "y", "en", "se", "del", "con", "una", "por", "para", "su",
    "il", "di", "e", "che", "non", "per", "o", "os", "da", "em", "um", "uma", "não", "het", "een", "van", "dat", "op", "te",
]

WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A text fails when part / whole lies below `least` or above `most`; a whole of 0 never fails.

    part and whole name measures. Bounds are whole thousandths, compared in integers, so that a
    ratio that equals its bound passes on every engine.
    """

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def fails(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        bounds = ([part < self.least * whole] if self.least is not None else []) + ([part > self.most * whole] if self.most is not None else [])
        failed = bounds[0] if bounds else F.lit(False)
        for bound in bounds[1:]:
            failed = failed | bound
        return (whole > 0) & failed

    def sql(self) -> str:
        bounds = ([f"{self.part} * 1000 < {self.least} * {self.whole}"] if self.least is not None else []) + (
            [f"{self.part} * 1000 > {self.most} * {self.whole}"] if self.most is not None else []
        )
        return f"({self.whole} > 0 AND ({' OR '.join(bounds) or 'false'}))"


#: The base verdict, then the rules that only texts in good order pass.
BASE = (
    Rule("few_words", "n_words", "one", least=50_000),
    Rule("repeated_words", "n_repeat_words", "n_words", most=500),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2_000, most=12_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_words", least=5),
    Rule("digits", "n_digits", "word_chars", most=500),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=400),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=300),
)


def _window(each: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(each, at + k) for k in range(WINDOW)])


def _repeated(rows: DataFrame) -> DataFrame:
    """rows with `starts`, the places of windows that occur twice or more, in place of `each`, the hashes of the words.

    Windows are sorted as plain longs, the upper bits from the hash and the lower ones the place.
    Only neighbours with equal upper bits are compared by their whole hashes, as pairs.
    """
    each, bits, upper_bits, order, near = [F.col(c) for c in ("each", "bits", "upper_bits", "order", "near")]
    n = F.size(each) - (WINDOW - 1)
    out = rows.withColumn("bits", F.length(F.bin(F.size(each)))).withColumn("upper_bits", F.expr("-shiftleft(1L, bits)"))
    placed = F.transform(F.slice(each, 1, n), lambda _, i: _window(each, i).bitwiseAND(upper_bits).bitwiseOR(i.cast("long")))
    out = out.withColumn("order", F.when(n >= 2, F.sort_array(placed)))
    upper = lambda x: F.call_function("shiftrightunsigned", x, bits)
    beside = lambda x, i: (upper(x) == upper(F.get(order, i - 1))) | (upper(x) == upper(F.get(order, i + 1)))
    out = out.withColumn("near", F.transform(F.filter(order, beside), lambda x: (x - x.bitwiseAND(upper_bits)).cast("int")))
    pairs = F.when(F.size(near) > 0, F.sort_array(F.transform(near, lambda i: F.struct(_window(each, i).alias("h"), i.alias("at")))))
    out = out.withColumn("near", pairs)
    again = F.filter(near, lambda x, i: (x["h"] == F.get(near, i - 1)["h"]) | (x["h"] == F.get(near, i + 1)["h"]))
    return out.withColumn("starts", F.transform(again, lambda x: x["at"])).drop("each", "bits", "upper_bits", "order", "near")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules compare, all long; each step reads the text or its words once.

    White space is `[\\x20\\x09-\\x0D]`. A repeated word stands in a window of three words that
    occurs twice or more in the text, the first included; windows are told apart by 64-bit hashes.
    Sorting windows takes n log n for a text of n words, so very long texts are whole as well.
    """
    text, space = F.col("text"), " \t\n\u000b\f\r"
    trimmed = F.btrim(text, F.lit(space))
    read = documents(docs).select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")).alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^0-9]+", "")).cast("long").alias("n_digits"),
    )
    words, lines = F.col("words"), F.col("lines")
    counted = read.select(
        "doc_id", "n_symbols", "n_digits",
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(words).cast("long").alias("n_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•‣▪·]\s"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*\z"))).cast("long").alias("n_cut_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("each"),
    )
    starts = _repeated(counted)
    within = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)]))))
    return starts.withColumn("n_repeat_words", F.coalesce(F.size(within), F.lit(0)).cast("long")).drop("starts").withColumn("one", F.lit(1).cast("long"))


def judged(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row doc_id, the measures, base_failed, failed_rules and kept.

    failed_rules names the rules that a text fails, in the table's order, joined by commas; kept
    is true where it fails none. Null texts count as empty; a text without words fails
    `few_words` and no ratio, since no ratio with a whole of 0 fails. Every row of docs gives one
    row: repeated rows are judged alike, null ids stay null, an empty table gives no row. Other
    columns of docs are not read, whatever their names.
    """
    table = (*base, *rules)
    names = F.concat_ws(",", *[F.when(rule.fails(), F.lit(rule.name)) for rule in table])
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | rule.fails()
    return measures(docs).withColumn("failed_rules", names).withColumn("base_failed", base_failed).withColumn("kept", F.col("failed_rules") == "").drop("one")


def rules_report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, failed_rules and kept under the given table of rules."""
    return judged(docs)


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    named = ", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in (*BASE, *RULES))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), read AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM read)
), found AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n >= 2
), again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM found, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), m AS (
  SELECT r.doc_id, 1 AS one, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits,
    len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪·][\x20\x09-\x0D]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines,
    coalesce(a.n, 0) AS n_repeat_words
  FROM read AS r LEFT JOIN again AS a ON a.doc_id = r.doc_id
), named AS (
  SELECT *, concat_ws(',', {named}) AS failed_rules, {" OR ".join(r.sql() for r in BASE)} AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_digits, n_stop_words, n_lines, n_dup_lines, n_bullet_lines, n_cut_lines,
  n_repeat_words, failed_rules, base_failed, failed_rules = '' AS kept
FROM named"""


#: One row a document where doc_id is unique, as in the given table.
RULES_SQL = _sql()
