"""Exact Jaccard self-join on word shingles: pivots, Voronoi cells and triangle-inequality windows.

Jaccard distance d = 1 - J is a metric, and EPS = 0.2 links two documents. Pivots alone cannot
part a corpus of texts: most documents lie at distance 1 from any pivot, and a window of 2 * EPS
around that distance would copy every document everywhere. So the first regions are those of
single shingles: two linked documents share a shingle among the first |A| - ceil(0.8 |A|) + 1 of
each under one global order (rare ones first), and a document goes to the region of each of
these. Within regions the join is the metric one:

1. The pivot of a region is its most central document, the one that shares most over all its
   regions; an original so becomes the pivot of its copies. Pairs of documents with their
   pivot are linear in the region, and groups of copies come together through them.
2. Regions whose documents are all connected by now need nothing more.
3. Small regions that are left compare the documents of different components.
4. Large regions become Voronoi cells of their pivots, and a document leaves them if it is in too
   few for a link that shares no small region. A cell is joined anew on the differences of its
   documents to the pivot: by the triangle inequality two documents of different components
   link only if they have differences in common, more the farther they are from the pivot, and if
   their distances to it are within a window. So the regions of single differences, the rare ones
   of each document first, hold every link of the cell.

Pairs are verified by counting only where they can link at all: sizes must be within a factor of
1.25, and with c common shingles in both prefixes the overlap is at most c plus what the larger
set has after its prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import documents, join_back, slices, whole_text
from itembank.llm.shingle_sets import set_key, shingle_sets, short_key
from itembank.session import materialize

#: Two documents link when 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 80
#: Shingles are counted in so many buckets (a power of two near the number of rows, within these bits),
#: 4 bytes each: the counts that every task is told are 16 MB at most. Any order is exact, this one keeps regions small.
LEAST_BITS, MOST_BITS = 14, 22
#: Buckets of a row of counts.
BLOCK = 1 << 12
#: Regions up to this size compare their documents directly, larger ones through their pivots.
SMALL_REGION = 128


def _need(n):
    """Least overlap of a set of n with any set that it links to."""
    return (PERCENT * n + 99) // 100


def first_pass(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, n, key, id) of every row, id being the short key, and (block, counts) of the shingles of each task by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            for at in range(0, len(sets), 100):
                every = np.concatenate(sets[at : at + 100])
                np.add.at(counts, (every >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array(keys, pa.binary()), "id": pa.array([short_key(k) for k in keys], pa.int64()),
                "block": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary()),
            })
        blocks = [(k, c) for k, c in enumerate(counts.reshape(-1, BLOCK)) if c.any()]
        for k, c in blocks:
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()), "key": pa.nulls(1, pa.binary()), "id": pa.nulls(1, pa.int64()),
                "block": pa.array([k], pa.int32()), "counts": pa.array([c.tobytes()], pa.binary()),
            })

    return materialize(docs.mapInArrow(run, "doc_id long, n long, key binary, id long, block int, counts binary"), "sets")


def bucket_counts(first: DataFrame, bits: int) -> np.ndarray:
    """The counts of all tasks summed up, one bucket after the other; a task adds up blocks as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        for k, c in total.items():
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([k], pa.int32()), "counts": pa.array([np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()),
            })

    told = first.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(run, "block int, counts binary").toArrow()
    counts = np.zeros((1 << bits) // BLOCK * BLOCK, np.uint32).reshape(-1, BLOCK)
    for k, c in zip(told.column("block").to_pylist(), told.column("counts").to_pylist(), strict=True):
        counts[k] = np.frombuffer(c, np.uint32)
    return counts.reshape(-1)


class _Order:
    """The global order of shingles: by the count of their bucket, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.shift = counts, np.uint64(64 - (len(counts).bit_length() - 1))

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        size = len(hashes) - _need(len(hashes)) + 1
        return hashes[np.argsort(self.counts[(hashes >> self.shift).astype(np.int64)], kind="stable")[:size]]


def prefix_rows(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(s, id, n): each row's prefix shingles with the short key and size of its set."""
    told = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(told.value)
        for batch in slices(batches):
            sets = [s for s in shingle_sets(batch.column("text").to_pylist()) if len(s)]
            if not sets:
                continue
            prefixes = [order.prefix(s) for s in sets]
            sizes = [len(p) for p in prefixes]
            yield pa.RecordBatch.from_pydict({
                "s": np.concatenate(prefixes).view(np.int64),
                "id": np.repeat(np.array([short_key(set_key(s)) for s in sets], np.int64), sizes),
                "n": np.repeat(np.array([len(s) for s in sets], np.int32), sizes),
            })

    return docs.mapInArrow(run, "s long, id long, n int")


def regions(prefixes: DataFrame) -> DataFrame:
    """(s, id, n) of regions with two sets or more, each set once.

    Rows are sorted by region and id, so a task streams over them and holds one row of the
    open region.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # of the open region, and whether it was given out
        given = False
        for batch in batches:
            s, i, n = (batch.column(c).to_numpy() for c in ("s", "id", "n"))
            if last is not None:
                s, i, n = np.append(last[0], s), np.append(last[1], i), np.append(np.int32(last[2]), n)
            keep = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
            s, i, n = s[keep], i[keep], n[keep]
            same = s[1:] == s[:-1]
            before, after = np.append(False, same), np.append(same, False)
            out = before | after
            out[0] &= not given  # the row held from the last batch may be out already
            given = bool(before[-1]) or (given and len(s) == 1)
            last = (int(s[-1]), int(i[-1]), int(n[-1]))
            if out.any():
                yield pa.RecordBatch.from_pydict({"s": s[out], "id": i[out], "n": n[out]})

    dealt = prefixes.repartition("s").sortWithinPartitions("s", "id")
    return materialize(dealt.mapInArrow(run, "s long, id long, n int"), "regions")


def central_pairs(region: DataFrame) -> DataFrame:
    """(a, b): sets with the pivot of their region, where they can link."""
    sized = region.join(region.groupBy("s").agg(F.count(F.lit(1)).alias("m")), "s")
    score = sized.groupBy("id").agg(F.sum("m").alias("score"))
    scored = region.join(score, "id")
    pivots = scored.groupBy("s").agg(F.max(F.struct("score", "id", "n")).alias("p"))
    met = region.join(pivots, "s").where(F.col("id") != F.col("p.id"))
    return _promising(met.select(F.col("id").alias("x"), F.col("n").alias("p"), F.col("p.id").alias("y"), F.col("p.n").alias("q")), F.lit(0))


def _promising(met: DataFrame, unseen) -> DataFrame:
    """Distinct (a, b) of rows (x, p, y, q), a row for each common shingle of two sets of p and q, that can link.

    unseen bounds the common shingles in prefixes that have no row.
    """
    pair = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.max("p").alias("p"), F.max("q").alias("q"), F.max(unseen).alias("unseen")
    )
    p, q = F.col("p"), F.col("q")
    rest = F.ceil(F.greatest(p, q) * PERCENT / 100) - 1  # what the larger set has after its prefix
    # 100 * both >= PERCENT * (p + q - both)
    enough = (F.col("c") + F.col("unseen") + rest) * (100 + PERCENT) >= (p + q) * PERCENT
    return pair.where(_window(p, q) & enough).select("a", "b")


def _window(p, q):
    """Sizes of sets that can link."""
    return (PERCENT * p <= 100 * q) & (PERCENT * q <= 100 * p)


def candidate_sets(docs: DataFrame, first: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, key, hashes) of the sets with the given short keys, each once, from one document that has it."""
    carriers = first.where("key IS NOT NULL").join(ids, "id", "left_semi")
    carriers = materialize(carriers.groupBy("key").agg(F.min("doc_id").alias("carrier")).select("carrier").distinct(), "carriers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s for s in shingle_sets(batch.column("text").to_pylist()) if len(s)]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([short_key(k) for k in keys], pa.int64()), "key": pa.array(keys, pa.binary()),
                "hashes": pa.array([s.tobytes() for s in sets], pa.binary()),
            })

    texts = docs.join(carriers, docs["doc_id"].eqNullSafe(carriers["carrier"])).select("text")
    found = texts.mapInArrow(run, "id long, key binary, hashes binary")
    # a carrier's id may be that of several rows, equal ones included, and a null carrier brings all rows without an id
    return materialize(found.join(ids, "id", "left_semi").dropDuplicates(["id", "key"]), "candidate-sets")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d, linked) of pairs of short keys, by counting common shingles."""

    @F.pandas_udf("both long")
    def common(x, y):
        import pandas as pd

        both = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame({"both": np.array(both, np.int64)})

    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", (F.octet_length("x") / 8).alias("p"), (F.octet_length("y") / 8).alias("q"), common("x", "y").alias("c"))
    both = F.col("c.both")
    union = F.col("p") + F.col("q") - both
    return materialize(met.select("a", "b", (1 - both / union).alias("d"), (100 * both >= PERCENT * union).alias("linked")), "distances")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every end of a link: the smallest id that links reach.

    Rounds of taking the least root among neighbours and then the root's own root, until
    nothing changes; each round is written, which cuts the lineage.
    """
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = materialize(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    roots = materialize(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("root")), "roots")
    while True:
        seen = edges.join(roots.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("seen"))
        lower = roots.join(seen, "id").select("id", F.least("root", "seen").alias("root"), F.col("root").alias("old"))
        lower = materialize(lower, "lower")
        up = lower.select(F.col("id").alias("root"), F.col("root").alias("top"))
        jumped = lower.join(up, "root").select("id", F.least("root", "top").alias("root"), "old")
        jumped = materialize(jumped, "roots")
        if jumped.where("root <> old").isEmpty():
            return jumped.select("id", "root")
        roots = jumped.select("id", "root")


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of regions that hold several components, with each row's own in `root`."""
    rows = rows.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    return rows.join(several.select("s", "m"), "s")


def _direct(small: DataFrame, many: DataFrame) -> DataFrame:
    """Pairs of different components that can link, from regions of at most SMALL_REGION rows.

    A pair may also share large regions; of those that either set is in (`many`) the fewer bound how many.
    """
    rows = small.join(many, "id", "left").select("s", "id", "n", "root", F.coalesce("large", F.lit(0)).alias("large"))
    x, y = rows.alias("x"), rows.alias("y")
    cond = (F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & _window(F.col("x.n"), F.col("y.n"))
    met = x.join(y, cond).select(
        F.col("x.id").alias("x"), F.col("x.n").alias("p"), F.col("y.id").alias("y"), F.col("y.n").alias("q"), F.least("x.large", "y.large").alias("large")
    )
    return _promising(met, F.col("large"))


def _trimmed(large: DataFrame) -> DataFrame:
    """Rows of large regions without sets that no link there can concern alone.

    Two sets that share no small region have as many common prefix shingles as they share large
    ones. A link of sets of p and q needs more than 4/9 (p + q) - 0.8 max(p, q) of them, so a set
    that is in no more large regions than that, for all sizes q it meets, is found in small ones.
    """
    sizes = large.groupBy("s").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    p = F.col("n")
    lo, hi = F.greatest(F.col("lo"), p * PERCENT / 100), F.least(F.col("hi"), p * 100 / PERCENT)

    def least(q):
        return PERCENT * (p + q) / (100 + PERCENT) - PERCENT * F.greatest(p, q) / 100

    needs = large.join(sizes, "s").groupBy("id").agg(F.count(F.lit(1)).alias("large"), F.min(F.least(least(lo), least(hi))).alias("more_than"))
    return large.join(needs.where(F.col("large") > F.col("more_than") - 1e-9).select("id"), "id", "left_semi")


def cells(large: DataFrame) -> DataFrame:
    """(pivot, id, n) of the documents that share a large region with its most central document."""
    score = large.groupBy("id").agg(F.count(F.lit(1)).alias("score"))
    pivots = large.join(score, "id").groupBy("s").agg(F.max(F.struct("score", "id")).alias("p"))
    met = large.join(pivots, "s").select(F.col("p.id").alias("pivot"), "id", "n")
    return met.where("id <> pivot").groupBy("pivot", "id").agg(F.max("n").alias("n"))


def _differences(cell: DataFrame, sets: DataFrame) -> DataFrame:
    """cell with the shingles that a document and its pivot do not share."""

    @F.pandas_udf("array<bigint>")
    def unshared(x, y):
        import pandas as pd

        return pd.Series([np.setxor1d(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64), assume_unique=True) for p, q in zip(x, y, strict=True)])

    x = sets.select("id", F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("pivot"), F.col("hashes").alias("y"))
    return cell.join(x, "id").join(y, "pivot").select(*cell.columns, unshared("x", "y").alias("diff"))


def within_cells(cell: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of different components of a cell that can link, pivots apart.

    Sets x and y of sizes n and n' link only if |x ^ y| <= (n + n') / 9, and with their differences
    X and Y to the pivot |x ^ y| = |X| + |Y| - 2 |X & Y|. One of two documents of different
    components is not linked to the pivot, so its difference is above (its n + the pivot's) / 9,
    and they have at least t = (|X| + |Y| - (n + n') / 9) / 2 > 0 differences in common. Then the
    first |X| - t + 1 of X and as many of Y, in one order, have one in common. t is bounded from
    below by the least difference of those a document has to meet.
    """
    top = roots.select(F.col("id").alias("pivot"), F.col("root").alias("pivot_root"))
    rows = cell.join(roots, "id", "left").join(top, "pivot", "left").select(
        "pivot", "id", "n", F.coalesce("root", "id").alias("root"), (F.coalesce("root", "id") == F.coalesce("pivot_root", "pivot")).alias("linked")
    )
    rows = materialize(_differences(rows, sets).withColumn("size", F.size("diff")), "differences")
    span = rows.groupBy("pivot").agg(F.max("n").alias("most"), F.min(F.when(~F.col("linked"), F.col("size"))).alias("far")).where("far IS NOT NULL")
    rows = rows.join(span, "pivot")
    each = rows.select("pivot", "id", F.explode("diff").alias("token"))
    seen = each.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("seen"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("seen", "token"))), lambda t: t["token"])
    order = each.join(seen, ["pivot", "token"]).groupBy("pivot", "id").agg(ranked.alias("tokens"))
    allowed = (F.col("n") + F.col("most")) * (100 - PERCENT) / (100 + PERCENT)

    def prefix(least):
        t = F.greatest(F.ceil((F.col("size") + least - allowed) / 2 - 1e-9), F.lit(1))
        return F.slice("tokens", F.lit(1), F.greatest(F.col("size") - t + 1, F.lit(0)).cast("int"))

    rows = rows.drop("diff").join(order, ["pivot", "id"]).withColumn("short", prefix(F.col("far"))).withColumn("long", prefix(F.lit(1)))
    rows = materialize(rows.drop("tokens"), "prefixes")

    def side(name: str, own: DataFrame, tokens: str) -> DataFrame:
        return own.select("pivot", F.explode(tokens).alias("token"), "id", "n", "root", "size").alias(name)

    def met(x: DataFrame, y: DataFrame, more) -> DataFrame:
        share = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root"))
        near = F.abs(F.col("x.size") - F.col("y.size")) * (100 + PERCENT) <= (F.col("x.n") + F.col("y.n")) * (100 - PERCENT)
        found = x.join(y, share & near & _window(F.col("x.n"), F.col("y.n")) & more)
        return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    apart, together = rows.where(~F.col("linked")), rows.where("linked")
    mixed = met(side("x", apart, "long"), side("y", together, "short"), F.lit(True))
    alone = met(side("x", apart, "short"), side("y", apart, "short"), F.col("x.id") < F.col("y.id"))
    return mixed.unionByName(alone).distinct()


def _ids(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest doc_id that links reach, the row's own included. Rows of equal
    sets are linked; an empty set (null or empty text, or white space alone) is linked with
    nothing and keeps its own id. Null ids count only where a component has no other, repeated
    ids like others. An empty table gives an empty result.
    """
    rows, named = _named(documents(docs))
    return _numbered(rows, named)


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of every row, and (key, copies, component_id, lead) of every set: lead is the least key of its component."""
    bits = min(MOST_BITS, max(LEAST_BITS, docs.count().bit_length()))
    first = first_pass(docs, bits)
    rows = first.where("key IS NOT NULL").select("doc_id", "n", "key")
    region = regions(prefix_rows(docs, bucket_counts(first, bits)))
    pairs = materialize(central_pairs(region), "central-pairs")
    sets = candidate_sets(docs, first, _ids(pairs))
    tested = distances(pairs, sets)
    roots = components(tested.where("linked").select("a", "b"))
    active = materialize(_mixed(region, roots), "mixed")
    large = active.where(F.col("m") > SMALL_REGION)
    many = materialize(large.groupBy("id").agg(F.count(F.lit(1)).alias("large")), "many")
    cell = materialize(cells(_trimmed(large)), "cells")
    to_pivots = cell.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    pairs = _direct(active.where(F.col("m") <= SMALL_REGION), many).unionByName(to_pivots).distinct()
    pairs = materialize(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = _ids(pairs.unionByName(to_pivots)).join(sets.select("id").distinct(), "id", "left_anti")
    sets = sets.unionByName(candidate_sets(docs, first, more))
    tested = tested.unionByName(distances(pairs, sets))
    roots = components(tested.where("linked").select("a", "b"))
    if not cell.isEmpty():
        pairs = within_cells(cell, sets, roots).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.unionByName(distances(pairs, sets))
        roots = components(tested.where("linked").select("a", "b"))
    nodes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked = sets.select("id", "key").join(roots, "id").select("key", "root").distinct()
    named = nodes.join(linked, "key")
    tops = named.groupBy("root").agg(F.min("least").alias("top"), F.min("key").alias("lead"))
    tops = named.join(tops, "root").select("key", "top", "lead")
    named = nodes.join(tops, "key", "left").select("key", "copies", F.coalesce("top", "least").alias("component_id"), F.coalesce("lead", "key").alias("lead"))
    return rows, materialize(named, "components")


def _numbered(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each row with the smallest doc_id of its component; sets in many rows meet theirs without a shuffle."""
    sets = named.select("key", "copies", "component_id")
    told = join_back(rows.where("n > 0"), sets, ["key"], "copies", rows.count())
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return told.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, of the document with the smallest id of each component.

    Rows that share an id stay or go together. Rows without an id go where their component has
    an id, and else one of them stays. Empty sets are linked with nothing, so their rows stay.
    """

    @F.pandas_udf("binary")
    def key_of(texts):
        import pandas as pd

        return pd.Series([set_key(s) for s in shingle_sets(texts.tolist())], dtype=object)

    rows, named = _named(documents(docs))
    gone = _numbered(rows, named).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialize(gone, "copies")
    doc_id = F.col("doc_id").cast("long")
    kept = docs.where(doc_id.isNotNull()).join(gone, doc_id == gone["_gone"], "left_anti")
    leads = named.where("component_id IS NULL AND key = lead").select(F.col("key").alias("_set"))
    nameless, words = docs.where(doc_id.isNull()), F.coalesce(whole_text().rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # first one row of each set, so that a set in many rows does not meet the join
    told = nameless.where(words).withColumn("_set", key_of(whole_text())).dropDuplicates(["_set"])
    told = told.join(leads, "_set", "left_semi").select(*docs.columns)
    return kept.unionByName(nameless.where(~words)).unionByName(told)
