"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly; columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import whole_text
from itembank.session import materialize

#: Words in a shingle, and the percentage of an item's shingles that a document must hold.
WORDS, CONTAINMENT = 5, 80
#: MinHash bins are 2^(class + EXTRA_BITS), so four or more per shingle of a document. A shared shingle is
#: then the minimum of its bin with a chance of at least (1 - e^-x) / x for x = 1/4, which is 0.885.
EXTRA_BITS = 2
#: An item shares SMALL * 0.8 = 8 shingles or more, and is missed with a chance of 0.115^8 = 3e-8.
#: Smaller items are searched among all shingles of the documents instead.
SMALL = 10


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct shingles of words: runs of WORDS, or all of them where there are fewer; none without words."""
    n = F.size(words)
    several = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.array_join(F.slice(words, i, WORDS), " "))
    few = F.when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(n >= WORDS, several).otherwise(few))


def hashes_of(each: Column) -> Column:
    """Sorted distinct hashes of the same shingles, from the hashes of the words."""
    n = F.size(each)
    several = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(WORDS)]))
    few = F.when(n > 0, F.array(F.xxhash64(F.array_join(F.transform(each, lambda h: h.cast("string")), " "))))
    return F.sort_array(F.array_distinct(F.when(n >= WORDS, several).otherwise(F.coalesce(few, F.array().cast("array<bigint>")))))


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and hashes; staged, so that words and their hashes are made once."""
    words = rows.select(*keys, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("each"))
    return words.select(*keys, hashes_of(F.col("each")).alias("hashes"))


def size_class(n: Column) -> Column:
    """The partition of a document: class c has 2^(c-1) to 2^c - 1 shingles."""
    return F.coalesce(F.when(n > 0, F.floor(F.log2(n)).cast("int") + 1), F.lit(0))


def _bin(h: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(64) - bits)


def signature(hashes: Column, bits: Column) -> Column:
    """The smallest hash of each of 2^bits equal ranges: one-permutation MinHash of sorted hashes."""
    return F.filter(hashes, lambda h, i: (i == 0) | (_bin(h, bits) != _bin(F.get(hashes, i - 1), bits)))


def indexed(items: DataFrame) -> DataFrame:
    """(h, item_id, least): a shingle of an item, and the least size class in whose signature it is.

    A shingle is the minimum of its bin when the next smaller hash is in another bin, and bins
    only get finer with the class; so one number says it for all classes. Shingles of small
    items have class -1: they are searched without signatures.
    """
    shared = F.transform(
        F.col("hashes"),
        lambda h, i: F.when(i == 0, F.lit(0)).otherwise(F.lit(64) - F.length(F.bin(h.bitwiseXOR(F.get(F.col("hashes"), i - 1))))),
    )
    rows = items.select("item_id", "n_item", F.explode(F.arrays_zip("hashes", shared.alias("shared"))).alias("x"))
    least = F.when(F.col("n_item") < SMALL, F.lit(-1)).otherwise(F.greatest(F.col("x.shared") - EXTRA_BITS + 1, F.lit(0)))
    return rows.select(F.col("x.hashes").alias("h"), "item_id", least.cast("int").alias("least"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_found, n_item) of every item of whose shingles a document holds the percentage or more.

    1. Each document becomes hashed shingles in its own row. Its size class decides into how
       many bins its MinHash signature is cut, so a long document keeps a long signature and
       a short item inside it is not lost.
    2. Items are indexed for all classes at once. A document and an item that agree on the
       minimum of a bin are candidates; small items are searched among all shingles.
    3. Candidates are verified on words: the item's exact shingles are counted in the document's.

    A document is its doc_id: rows with one id are judged together, one holding the item is
    enough, and the largest count is given. Null ids are one document. Null and empty texts hold
    nothing, items without words are in nothing, and items with equal ids count each for itself
    by the largest. Empty tables give an empty result. Joins are by equality; Spark broadcasts
    the items or the candidates only where they are below its size limit.
    """
    return _contained(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")), ["doc_id"], items, percent)


def _contained(docs: DataFrame, keys: list[str], items: DataFrame, percent: int) -> DataFrame:
    """The same for documents told apart by keys, which may be null."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    split = texts.select("item_id", "text", words_of(F.col("text")).alias("words"))
    grams = split.select("item_id", "text", grams_of(F.col("words")).alias("grams"))
    known = materialize(_hashed(grams, "item_id", "grams").withColumn("n_item", F.size("grams")), "items").where("n_item > 0")
    index = materialize(indexed(known), "item-index")

    hashed = _hashed(docs, *keys).withColumn("class", size_class(F.size("hashes")))
    minima = hashed.select(*keys, "class", F.explode(signature(F.col("hashes"), F.col("class") + EXTRA_BITS)).alias("h"))
    large = index.where("least >= 0")
    pairs = minima.join(large, "h").where(F.col("class") >= F.col("least")).select(*keys, "item_id")
    small = index.where("least < 0")
    if not small.isEmpty():
        every = hashed.select(*keys, F.explode("hashes").alias("h"))
        pairs = pairs.unionByName(every.join(small, "h").select(*keys, "item_id"))
    candidates = materialize(pairs.distinct(), "candidates")

    asked = _asked(candidates, keys, known)
    held = docs.join(asked, _same(docs, asked, keys)).select(
        *keys, "item_id", "n_item", "grams", words_of(F.col("text")).alias("words")
    )
    counted = held.select(*keys, "item_id", "n_item", F.size(F.array_intersect("grams", grams_of(F.col("words")))).alias("n_found"))
    # the threshold comes after the aggregation: a filter before it would be pushed below and count again
    found = counted.groupBy(*keys, "item_id").agg(F.max("n_found").cast("long").alias("n_found"), F.max("n_item").cast("long").alias("n_item"))
    return found.where(F.col("n_found") * 100 >= F.col("n_item") * percent)


def _same(docs: DataFrame, asked: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & docs[key].eqNullSafe(asked[f"asked_{key}"])
    return same


def _asked(candidates: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    c, k = candidates.alias("c"), known.alias("k")
    return c.join(k, F.col("c.item_id").eqNullSafe(F.col("k.item_id"))).select(
        *[F.col(f"c.{key}").alias(f"asked_{key}") for key in keys], F.col("c.item_id").alias("item_id"), "k.n_item", "k.grams"
    )


def clean(docs: DataFrame, items: DataFrame, percent: int = CONTAINMENT) -> DataFrame:
    """The rows of docs, all their columns, whose document holds no item.

    Here a row without an id is a document of its own, told by a hash of its text.
    """
    key, own = F.col("doc_id").cast("long"), F.when(F.col("doc_id").cast("long").isNull(), F.sha2(whole_text(), 256))
    told = docs.select(key.alias("doc_id"), own.alias("own"), whole_text().alias("text"))
    found = _contained(told, ["doc_id", "own"], items, percent)
    leaked = materialize(found.select(F.col("doc_id").alias("_leaked"), F.col("own").alias("_leaked_own")).distinct(), "leaked")
    return docs.join(leaked, key.eqNullSafe(F.col("_leaked")) & own.eqNullSafe(F.col("_leaked_own")), "left_anti")


#: The exact answer by counting all shingles.
CONTAINED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id AS id, lower(coalesce(text, '')) AS t FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id AS id, lower(coalesce(text, '')) AS t FROM benchmark),
dw AS (SELECT r, id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n FROM
  (SELECT r, id, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM d)),
bw AS (SELECT r, id, unnest(w) AS w, generate_subscripts(w, 1) AS p, len(w) AS n FROM
  (SELECT r, id, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM b)),
dg AS (SELECT DISTINCT id AS doc_id, CASE WHEN n >= 5 THEN concat_ws(' ', w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v, lead(w, 4) OVER v)
  ELSE string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS g
  FROM dw WINDOW v AS (PARTITION BY r ORDER BY p) QUALIFY p <= greatest(n - 4, 1)),
bg AS (SELECT DISTINCT id AS item_id, CASE WHEN n >= 5 THEN concat_ws(' ', w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v, lead(w, 4) OVER v)
  ELSE string_agg(w, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS g
  FROM bw WINDOW v AS (PARTITION BY r ORDER BY p) QUALIFY p <= greatest(n - 4, 1)),
n AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY 1)
SELECT doc_id, bg.item_id, count(*) AS n_found, any_value(n_item) AS n_item
FROM dg JOIN bg USING (g) JOIN n ON n.item_id = bg.item_id
GROUP BY 1, 2 HAVING count(*) * 100 >= any_value(n_item) * 80
"""
