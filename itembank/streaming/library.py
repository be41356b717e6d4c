"""Library totals as a stream: mergeable partial counts, folded into a table that is compacted as it grows.

A batch of answers is reduced to one row per (bank, session, mode, type, topic). Counts add up, so a
batch needs no state of earlier ones, and a hot bank is reduced by all tasks before any shuffle. The
reports read the table as they read answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.operators.reports import measures
from itembank.session import scratch_path

CELL = ["bank", "session_id", "mode", "qtype", "topic"]


def cells(facts: DataFrame) -> DataFrame:
    """Answers, or cells again, summed up per cell; ``correct`` becomes a count."""
    answered, correct = measures(facts)
    return facts.groupBy(*CELL).agg(
        answered.alias("answered"), correct.alias("correct"), F.max("answered_at").alias("answered_at")
    )


class CellTable:
    """A folder of batch parts and, every ``every`` batches, one snapshot of all cells so far.

    A snapshot of batch n holds everything up to n, so parts and snapshots before it are dropped, and
    a batch that is replayed after a failure overwrites its part or is already covered: nothing is
    counted twice. A snapshot counts once it is written whole.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = 16) -> None:
        self.spark, self.root, self.every = spark, root, every

    def _folders(self, kind: str) -> dict[int, str]:
        """Folders written whole, by batch number."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        found = [f.getPath() for f in fs.listStatus(path)]
        whole = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName()): p.toString() for p in whole}

    def _drop(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _live(self, upto: int | None = None) -> list[str]:
        snapshots = self._folders("snapshots")
        base = max(snapshots, default=-1)
        parts = [p for n, p in sorted(self._folders("parts").items()) if n > base and (upto is None or n <= upto)]
        return ([snapshots[base]] if snapshots else []) + parts

    def write(self, batch: DataFrame, number: int) -> None:
        if number <= max(self._folders("snapshots"), default=-1):
            return
        cells(batch).write.mode("overwrite").parquet(f"{self.root}/parts/{number}")
        if (number + 1) % self.every == 0:
            cells(self.spark.read.parquet(*self._live(number))).write.mode("overwrite").parquet(f"{self.root}/snapshots/{number}")
            parts, snapshots = self._folders("parts"), self._folders("snapshots")
            for path in [p for n, p in parts.items() if n <= number] + [p for n, p in snapshots.items() if n < number]:
                self._drop(path)

    def read(self, schema: str) -> DataFrame:
        live = self._live()
        rows = self.spark.read.schema(schema).parquet(*live) if live else self.spark.createDataFrame([], schema)
        return cells(rows)


def drain_cells(facts: DataFrame, every: int = 16) -> DataFrame:
    """Run a stream of answers over what is there now and read its cells back."""
    spark = facts.sparkSession
    sink = CellTable(spark, scratch_path(spark, "cells"), every)
    query = (
        facts.writeStream.option("checkpointLocation", scratch_path(spark, "cells-checkpoint"))
        .trigger(availableNow=True).foreachBatch(sink.write).start()
    )
    query.awaitTermination()
    kind = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    schema = ", ".join([*[f"{c} {kind[c]}" for c in CELL], "answered bigint, correct bigint", f"answered_at {kind['answered_at']}"])
    return sink.read(schema)
