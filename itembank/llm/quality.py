"""Quality classifier: document evidence combined with host and path rates by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import whole_text
from itembank.session import materialize

#: A table of path rates of at most so many rows is broadcast, a larger one is joined by shuffle.
BROADCAST_PATHS = 100_000
#: Pseudo-counts of the smoothing, and bounds of an estimated prior weight.
SMOOTHING, LEAST_WEIGHT, MOST_WEIGHT = 1.0, 2.0, 1e6


@dataclass(frozen=True)
class Columns:
    """Where a table keeps its key, text, host and path; a path lies within its host."""

    key: str = "doc_id"
    text: str = "text"
    host: str = "source"
    path: str = "lang"


def _share(part: Column, whole: Column, steps: int) -> Column:
    return F.floor(F.when(whole > 0, part / whole).otherwise(0.0) * steps).cast("int")


def signals(text: Column) -> dict[str, Column]:
    """Binned signals of a text, all bounded in number.

    How many of its words carry runs of symbols or are a lone symbol, how many repeat the word
    before, and how far words repeat at all, the last by size class, since long texts repeat more.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words = F.size(words)
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]{2,}|(?<!\S)[^\p{L}\p{N}\s](?!\S)"))
    again = F.regexp_count(text, F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))"))
    size = F.floor(F.log2(n_words + F.lit(1))).cast("int")
    return {
        "symbols": F.least(_share(symbols, n_words, 20), F.lit(10)),
        "again": _share(again, n_words, 10),
        "words": F.least(size, F.lit(20)) * 16 + _share(F.size(F.array_distinct(words)), n_words, 10),
    }


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@dataclass(frozen=True)
class Model:
    """Fitted tables: log-likelihood ratios by signal and bin (a bounded number, on the driver), and path rates."""

    ratios: dict[str, dict[int, float]]
    base: float
    paths: DataFrame
    columns: Columns

    def evidence(self) -> Column:
        """Sum of the log-likelihood ratios of a text's bins; an unseen bin says nothing."""
        return _evidence(self.ratios, signals(whole_text(self.columns.text)))

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with struct `_quality` (evidence, path_rate, quality) after its own columns; no row is lost or added."""
        c = self.columns
        paths = F.broadcast(self.paths) if self.paths.count() <= BROADCAST_PATHS else self.paths
        rows = docs.withColumn("_evidence", self.evidence()).alias("d")
        rates = paths.alias("p")
        on = F.col(f"d.{c.host}").eqNullSafe(F.col("p._host")) & F.col(f"d.{c.path}").eqNullSafe(F.col("p._path"))
        rate = F.coalesce(F.col("p._rate"), F.lit(self.base))
        told = F.struct(
            F.col("d._evidence").alias("evidence"), rate.alias("path_rate"), _expit(F.col("d._evidence") + _logit(rate)).alias("quality")
        )
        return rows.join(rates, on, "left").select(*[F.col(f"d.`{x}`") for x in docs.columns], told.alias("_quality"))


def _evidence(ratios: dict[str, dict[int, float]], bins: dict[str, Column]) -> Column:
    parts = [F.lit(0.0)]
    for name, column in bins.items():
        if table := ratios.get(name):
            known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
            parts.append(F.coalesce(F.try_element_at(known, column), F.lit(0.0)))
    return _sum(parts)


def fit(docs: DataFrame, labels: DataFrame, columns: Columns = Columns()) -> Model:
    """Fit on all labelled rows and on all documents.

    1. Signals of every document are computed once and written (without texts).
    2. Ratios come from counts of labelled documents by signal, bin and label. A document
       with several labels counts once, as good where half of them or more are; null labels
       and labels of unknown documents are ignored.
    3. Every document gives soft evidence of its path's rate: its label, or else its
       probability under the base rate. Sums by path, then by host, are aggregated before
       each shuffle, so a host with a third of all rows is a few partial sums per task.
    4. Host rates shrink to the base rate, path rates to their host's. The weight of each
       prior is fitted by moments: the less groups differ beyond their own noise, the more
       of their rate comes from above. A host or path of few documents stays near its prior.

    Null hosts and paths are groups of their own. Without labels every rate is one half.
    """
    c = columns
    bins = signals(whole_text(c.text))
    rows = docs.select(
        F.col(c.key).alias("_key"), F.col(c.host).cast("string").alias("_host"), F.col(c.path).cast("string").alias("_path"),
        *[column.alias(name) for name, column in bins.items()],
    )
    known = (
        labels.select(F.col(c.key).alias("_key"), F.col("quality").cast("double").alias("good"))
        .where(F.col("_key").isNotNull() & F.col("good").isNotNull())
        .groupBy("_key").agg((F.avg("good") >= 0.5).cast("double").alias("good"))
    )
    rows = materialize(rows.join(known, "_key", "left"), "signals")

    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("bin")) for n in bins]))
    counted = (
        rows.where(F.col("good").isNotNull()).select("good", cells.alias("cell"))
        .groupBy("cell.signal", "cell.bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect()
    )
    ratios, totals = _ratios(counted)
    base = (totals[0] + SMOOTHING) / (totals[0] + totals[1] + 2 * SMOOTHING)

    own = {n: F.col(n) for n in bins}
    soft = F.coalesce("good", _expit(_evidence(ratios, own) + _logit(F.lit(base))))
    paths = rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum(soft).alias("s"))
    paths = materialize(paths, "path-sums")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    hosts = _shrunk(hosts, F.col("host_n"), F.col("host_s"), F.lit(base), "host_rate")
    rates = _shrunk(
        paths.alias("a").join(hosts.alias("b"), F.col("a._host").eqNullSafe(F.col("b._host")))
        .select("a._host", "a._path", "n", "s", "host_rate"),
        F.col("n"), F.col("s"), F.col("host_rate"), "_rate",
    )
    return Model(ratios, base, materialize(rates.select("_host", "_path", "_rate"), "path-rates"), c)


def _ratios(counted: list) -> tuple[dict[str, dict[int, float]], tuple[float, float]]:
    from math import log

    signals_seen = sorted({r["signal"] for r in counted})
    ratios, totals = {}, (0.0, 0.0)
    for name in signals_seen:
        cells = [r for r in counted if r["signal"] == name]
        good, bad = sum(r["good"] for r in cells), sum(r["bad"] for r in cells)
        totals = (good, bad)
        share = (good + SMOOTHING) / (good + bad + 2 * SMOOTHING)
        ratios[name] = {
            r["bin"]: log((r["good"] + 2 * SMOOTHING * share) / (good + SMOOTHING)) - log((r["bad"] + 2 * SMOOTHING * (1 - share)) / (bad + SMOOTHING))
            for r in cells
        }
    return ratios, totals


def _shrunk(groups: DataFrame, n: Column, s: Column, prior: Column, name: str) -> DataFrame:
    """Each group's rate (weight * prior + s) / (weight + n), with one weight fitted over all groups.

    Moments of beta-binomial groups: E (s/n - prior)^2 = v (1/n + (1 - 1/n) / (weight + 1)) with
    v = prior (1 - prior), summed over groups with weight n.
    """
    v = prior * (1 - prior)
    sums = groups.agg(
        F.sum(n * (s / n - prior) ** 2).alias("spread"), F.sum(v).alias("noise"), F.sum((n - 1) * v).alias("room")
    )
    excess = F.col("spread") - F.col("noise")
    weight = F.when((excess > 0) & (F.col("room") > 0), F.col("room") / excess - 1).otherwise(MOST_WEIGHT)
    fitted = sums.select(F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight")).head()
    weight = F.lit(float(fitted["weight"]) if fitted and fitted["weight"] is not None else MOST_WEIGHT)
    return groups.withColumn(name, (weight * prior + s) / (weight + n))


def classify(docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), threshold: float = 0.5) -> DataFrame:
    """Per row its key, evidence, path_rate, quality (posterior probability of being good) and keep.

    A row goes when its quality is below the threshold. Null and empty texts are judged by
    the bins of an empty text.
    """
    scored = fit(docs, labels, columns).score(docs.select(columns.key, columns.text, columns.host, columns.path))
    quality = F.col("_quality.quality")
    return scored.select(columns.key, "_quality.evidence", "_quality.path_rate", quality.alias("quality"), (quality >= threshold - 1e-9).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, without those of a quality below the threshold."""
    scored = fit(docs, labels, columns).score(docs)
    return scored.where(F.col("_quality.quality") >= threshold - 1e-9).select(*[F.col(f"`{x}`") for x in docs.columns])
