"""Filter interaction audit: per-part sorted lists of failing rows, merged by galloping over ranges, sizes summed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import exact, join_back, whole_text
from itembank.session import materialize

FILTERS = "ABCDE"
#: Rows of one range of a part's lists, at most.
RANGE_ROWS = 16_384
#: A set of filters is a number whose bits name them.
SETS = range(1, 1 << len(FILTERS))
GROUPS = ("all", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails; E needs the table."""
    trimmed = F.btrim(text, F.lit(" \t\n\u000b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
    capitals = F.length(F.regexp_replace(text, r"[^A-Z]+", ""))
    return {
        "words": words,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, part, A to E (fails or not), good and toxic; written once.

    Texts are told apart by SHA-256. A row fails E where another row with the same text has a
    smaller doc_id, so rows with the smallest one, and rows without an id, do not. A document is
    good or toxic where any of its label rows says 1.
    """
    own = exact(docs, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("text")
    )
    text = F.col("text")
    read = own.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(name) for name, c in failures(text).items()])
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    rows = read.select(
        "doc_id", "part", "digest", (n_words < 200).alias("A"), (100 * n_distinct.cast("long") < 50 * n_words.cast("long")).alias("B"), "C", "D"
    )
    rows = materialize(rows, "audit-texts")

    n = rows.count()
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    rows = join_back(rows, texts.where("copies > 1"), ["digest"], "copies", n)
    rows = rows.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))

    told = exact(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = join_back(rows, ids.join(told, "doc_id"), ["doc_id"], "copies", n)
    return rows.select("doc_id", "part", *FILTERS, *[F.coalesce(g, F.lit(False)).alias(g) for g in GROUPS[1:]])


def postings(rows: DataFrame) -> DataFrame:
    """Per part and range of rows: the number of rows, and a sorted list of failing rows per filter, of good and of toxic rows.

    Lists hold row numbers within the range, counted in order of doc_id, so that repeated and null
    ids stay apart; first_id and last_id bound its ids. A range lies within one task and has
    RANGE_ROWS rows at most, whatever the size of its part. No shuffle: rows are sorted where they are.
    """
    flags = [*FILTERS, *GROUPS[1:]]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: str | None = None
        ids: list[pa.Array] = []
        bits: list[np.ndarray] = []
        held = 0

        def range_of() -> pa.RecordBatch:
            all_bits = np.concatenate(bits, axis=1)
            known = pa.concat_arrays(ids).drop_null()
            lists = [pa.array([np.flatnonzero(b)], pa.list_(pa.int64())) for b in all_bits]
            ends = [pa.array([known[at].as_py() if len(known) else None], pa.int64()) for at in (0, -1)]
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([held], pa.int64()), *ends, *lists], names=["part", "n_rows", "first_id", "last_id", *flags])

        for batch in batches:
            names = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(names[1:] != names[:-1]) + 1
            values = np.array([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(flags))], dtype=bool).reshape(len(flags), -1)
            for start, end in zip([0, *edges], [*edges, len(names)], strict=True):
                while start < end:
                    if held and (names[start] != part or held == RANGE_ROWS):
                        yield range_of()
                        ids, bits, held = [], [], 0
                    part, take = names[start], min(end - start, RANGE_ROWS - held)
                    ids.append(batch.column(0).slice(start, take))
                    bits.append(values[:, start : start + take])
                    held, start = held + take, start + take
        if held:
            yield range_of()

    kind = "part string, n_rows long, first_id long, last_id long, " + ", ".join(f"{f} array<long>" for f in flags)
    return rows.select("doc_id", "part", *flags).sortWithinPartitions("part", "doc_id").mapInArrow(build, kind)


def hits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a are in b: the shorter list gallops through the longer by binary searches."""
    if not len(a) or not len(b):
        return np.zeros(len(a), dtype=bool)
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return b[np.minimum(at, len(b) - 1)] == a
    found = np.zeros(len(a), dtype=bool)
    at = np.searchsorted(a, b)
    at = at[at < len(a)]
    found[at[np.isin(a[at], b, assume_unique=True)]] = True
    return found


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """The union of sorted lists, k ways: the longest stays as it is, each shorter one's new entries go in at their places."""
    longest, *rest = sorted(lists, key=len, reverse=True)
    for own in rest:
        new = own[~hits(own, longest)]
        longest = np.insert(longest, np.searchsorted(longest, new), new) if len(new) else longest
    return longest


def _size_names() -> list[str]:
    return [f"{group}_{s}" for group in GROUPS for s in SETS]


def sizes(lists: DataFrame) -> DataFrame:
    """Per part: rows, and the size of the union of failing rows for every set of filters, of all, good and toxic rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for r in range(batch.num_rows):
                own = [batch.column(2 + i)[r].values.to_numpy() for i in range(len(FILTERS) + 2)]
                failing, counts = own[: len(FILTERS)], []
                for only in (None, own[-2], own[-1]):
                    each = failing if only is None else [x[hits(x, only)] for x in failing]
                    unions: dict[int, np.ndarray] = {}
                    for s in SETS:
                        high = s.bit_length() - 1
                        rest = s & ~(1 << high)
                        unions[s] = merged([unions[rest], each[high]]) if rest else each[high]
                    counts += [len(unions[s]) for s in SETS]
                out.append(counts)
            columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(len(GROUPS) * len(SETS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["part", "n_rows", *_size_names()])

    kind = "part string, n_rows long, " + ", ".join(f"{name} long" for name in _size_names())
    each = lists.select("part", "n_rows", *FILTERS, *GROUPS[1:]).mapInArrow(add, kind)
    return each.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n_rows", *_size_names())])


def _steps() -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, set before, set after) of every order of the filters."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append(("".join(FILTERS[i] for i in order), step + 1, f, before, before | 1 << f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step the counts of rows: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row is a document, so repeated rows count as often as they are there. Null texts are empty;
    null sources and the source '' are one part; rows without an id are documents without labels.
    Labels of unknown documents count nowhere. An empty table gives no row. Other columns are not read.

    Every count follows from the sizes of unions: a filter removes what its list adds to the union
    of those before it, and finds redundant what that union holds of its list already.
    """
    table = sizes(postings(materialize(flagged(docs, labels), "audit-flags")))
    steps = _steps()
    whole = (1 << len(FILTERS)) - 1
    union = {group: F.array(F.lit(0).cast("long"), *[F.col(f"{group}_{s}") for s in SETS]) for group in GROUPS}
    shapley = []
    for f in range(len(FILTERS)):
        gains = [(order[3], order[4]) for order in steps if order[2] == f]
        total = F.lit(0).cast("long")
        for before, after in sorted(set(gains)):
            total = total + gains.count((before, after)) * (F.get("all", F.lit(after)) - F.get("all", F.lit(before)))
        shapley.append(total)
    wide = table.select("part", "n_rows", *[c.alias(g) for g, c in union.items()])
    wide = wide.select("*", F.array(*shapley).alias("shapley"), F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at"))
    place = lambda k: F.get(F.lit([s[k] for s in steps]), F.col("at"))
    wide = wide.select("*", place(0).alias("filter_order"), place(1).alias("step"), place(2).alias("f"), place(3).alias("before"), place(4).alias("after"))
    added = {g: F.get(g, F.col("after")) - F.get(g, F.col("before")) for g in GROUPS}
    single = F.get("all", F.get(F.lit([1 << f for f in range(len(FILTERS))]), F.col("f")))
    others = F.get("all", F.get(F.lit([whole & ~(1 << f) for f in range(len(FILTERS))]), F.col("f")))
    return wide.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("n_rows") - F.get("all", F.col("after"))).alias("kept"),
        added["all"].alias("removed"),
        (single - added["all"]).alias("redundant"),
        (F.get("all", F.lit(whole)) - others).alias("unique_fails"),
        added["good"].alias("good_lost"),
        added["toxic"].alias("toxic_lost"),
        F.get("shapley", F.col("f")).alias("shapley"),
    )


#: Counts by part and set of failed filters, then every order over them.
AUDIT_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
    CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)
), steps AS (
  SELECT o, k::INT AS step, o[k] AS x, left(o, k::INT - 1) AS before FROM (SELECT o, unnest(range(1, 6)) AS k FROM orders WHERE length(o) = 5)
), counted AS (
  SELECT part, o, step, x,
    sum(CASE WHEN translate(failed, before || x, '') = failed THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') = failed THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') <> failed THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') = failed THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, x) AND translate(failed, before, '') = failed THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted"""
