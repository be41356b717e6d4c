"""Streaming forms: keyed review state, running totals, deduplicated intake, sessions, daily activity.

Streams of one key are assumed in event order across micro-batches; rows inside a batch are sorted
by the processor. A record idles until its next answer; state is one small row per key, and keys are
dealt to buckets whose answers are folded together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from itembank.constants import GRADUATE_STREAK, INTERVALS
from itembank.operators.ordering import keep_last
from itembank.operators.reports import right
from itembank.session import scratch_path

STATE = "wrong_count bigint, correct_streak bigint, added_at timestamp, last_wrong_at timestamp, last_answer_at timestamp"
RESULT = (
    "bank string, qid string, seq bigint, status string, wrong_count bigint, correct_streak bigint, stage bigint, next_review date, "
    "added_at timestamp, last_wrong_at timestamp, last_answer_at timestamp"
)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many groups, whatever their number; a checkpoint holds for one number only.
BUCKETS = 2048
STAMPS = ("added_at", "last_wrong_at", "last_answer_at")


def _last(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The index of the last mark up to each row since the start of its key, or -1."""
    at = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1))
    return np.where(at >= starts, at, -1)


def _changes(start: np.ndarray, right: np.ndarray, at: np.ndarray, known: np.ndarray, old: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The record after every answer, and what the answer did to it.

    Rows come by key and in order; ``start`` has the first row of a row's key, ``known`` and ``old``
    the record its key had before the batch.
    """
    i = np.arange(len(start))
    wrong = ~right
    last = _last(wrong, start)
    # an answer that is wrong finds a record unless seven right ones came since the wrong one before it
    before = np.where(i > start, np.append(-1, last[:-1]), -1)
    since = np.where(before >= 0, i - before - 1, old["correct_streak"] + i - start)
    added = wrong & ~(((before >= 0) | known) & (since < GRADUATE_STREAK))
    opened = _last(added, start)
    wrongs = np.cumsum(wrong)
    streak = np.where(last >= 0, i - last, old["correct_streak"] + i - start + 1)
    live = ((last >= 0) | known) & (streak <= GRADUATE_STREAK)
    count = np.where(opened >= 0, wrongs - wrongs[opened] + 1, old["wrong_count"] + wrongs - wrongs[start] + wrong[start])
    status = np.select([added, live & (streak == GRADUATE_STREAK), live], ["added", "graduated", "updated"], "none")
    stage = np.minimum(streak, len(INTERVALS) - 1)
    days = np.asarray(INTERVALS, dtype="timedelta64[D]")[np.where(live, stage, 0)]
    return {
        "status": status, "live": live, "wrong_count": count, "correct_streak": streak, "stage": stage, "next_review": (at + days).astype("datetime64[D]"),
        "added_at": np.where(opened >= 0, at[opened], old["added_at"]), "last_wrong_at": np.where(last >= 0, at[last], old["last_wrong_at"]),
        "last_answer_at": at,
    }


class ReviewProcessor(StatefulProcessor):
    """Keeps the live mistake records of a bucket of (bank, question); emits one row per answer.

    All keys of a bucket are folded by array operations; a record is read and written by itself.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "bank string, qid string", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        answers = pd.concat(list(rows), ignore_index=True)
        # null is a key like any other
        bank, banks = pd.factorize(answers["bank"], use_na_sentinel=False)
        qid, qids = pd.factorize(answers["qid"], use_na_sentinel=False)
        at = answers["answered_at"].to_numpy("datetime64[us]")
        place = np.where(np.isnat(at), np.iinfo("int64").max, at.view("int64"))
        o = np.lexsort((answers["seq"].to_numpy(), place, qid, bank))
        bank, qid, at = bank[o], qid[o], at[o]
        right = answers["correct"].eq(True).to_numpy(bool)[o]
        new = np.append(True, (bank[1:] != bank[:-1]) | (qid[1:] != qid[:-1]))
        heads, of = np.flatnonzero(new), np.cumsum(new) - 1
        name = lambda values, c: None if pd.isna(values[c]) else values[c]
        keys = [(name(banks, b), name(qids, q)) for b, q in zip(bank[heads], qid[heads], strict=True)]

        blank = (0, 0, None, None, None)
        seen = self.records.exists()
        found = [tuple(self.records.getValue(k)) if seen and self.records.containsKey(k) else blank for k in keys]
        known = np.array([r is not blank for r in found])
        old = {
            c: np.array(v, dtype="datetime64[us]" if c in STAMPS else "int64")[of]
            for c, v in zip([f.split()[0] for f in STATE.split(", ")], zip(*found, strict=True), strict=True)
        }
        out = _changes(heads[of], right, at, known[of], old)

        ends = np.append(heads[1:], len(at)) - 1
        live = out["live"][ends] & (out["status"][ends] != "graduated")
        stamps = [out[c][ends].astype(object) for c in STAMPS]
        counts = [out[c][ends].tolist() for c in ("wrong_count", "correct_streak")]
        for k, stays, was, *record in zip(keys, live, known, *counts, *stamps, strict=True):
            if stays:
                self.records.updateValue(k, tuple(record))
            elif was:
                self.records.removeKey(k)

        nothing = ~out["live"]
        df = pd.DataFrame({"bank": banks.take(bank), "qid": qids.take(qid), "seq": answers["seq"].to_numpy()[o], "status": out["status"]})
        for c in ("wrong_count", "correct_streak", "stage"):
            df[c] = pd.arrays.IntegerArray(out[c].astype("int64"), nothing)
        df["next_review"] = pd.Series(out["next_review"].astype(object)).where(~nothing, None)
        for c in STAMPS:
            df[c] = pd.Series(out[c]).where(~nothing)
        yield df

    def close(self) -> None:
        pass


def review_updates(attempts: DataFrame) -> DataFrame:
    """A stream of answers to a stream of record changes."""
    dealt = attempts.withColumn("_bucket", F.pmod(F.xxhash64("bank", "qid"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=ReviewProcessor(), outputStructType=RESULT, outputMode="Update", timeMode="None"
    )


def latest_book(updates: DataFrame) -> DataFrame:
    """The book after a log of changes: the last change of each key unless it graduated."""
    changes = updates.filter("status <> 'none'")
    return keep_last(changes, ["bank", "qid"], ["last_answer_at", "seq"]).filter("status <> 'graduated'").drop("status", "seq")


def running_totals(attempts: DataFrame) -> DataFrame:
    """Answered and correct per bank and type, updated as answers arrive."""
    return attempts.groupBy("bank", "qtype").agg(F.count("*").alias("answered"), F.sum(right()).alias("correct"))


def deduplicated(attempts: DataFrame, key: str = "seq", delay: str = "1 day") -> DataFrame:
    """Drop repeats of an answer id arriving within the delay."""
    return attempts.withWatermark("answered_at", delay).dropDuplicatesWithinWatermark([key])


def sessions(attempts: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a bank cut by inactivity; on a stream they come out once closed (append mode)."""
    w = F.session_window("answered_at", gap)
    return attempts.withWatermark("answered_at", delay).groupBy("bank", w.alias("w")).agg(
        F.count("*").alias("answered"), F.sum(right()).alias("correct")
    ).select("bank", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "answered", "correct")


def daily(attempts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Answers per bank and day."""
    w = F.window("answered_at", "1 day")
    return attempts.withWatermark("answered_at", delay).groupBy("bank", w.alias("w")).agg(
        F.count("*").alias("answered"), F.sum(right()).alias("correct")
    ).select("bank", F.to_date("w.start").alias("day"), "answered", "correct")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events")


def drain(stream: DataFrame, mode: str, upsert_keys: list[str] | None = None, label: str = "stream") -> DataFrame:
    """Run a stream over what is there now and read back its table.

    Append output goes to a Parquet sink with a checkpoint. Update output is written per batch
    with its batch number, and the latest batch of each key is read back (an upsert).
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(_batch_writer(out)).start()
    query.awaitTermination()
    table = spark.read.schema(f"{_ddl(stream)}{', _batch bigint' if mode != 'append' else ''}").parquet(out)
    if mode == "append":
        return table
    table = table.drop("part")
    return (keep_last(table, upsert_keys, ["_batch"]) if upsert_keys else table).drop("_batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        # a replayed batch overwrites its own folder, so nothing is counted twice
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/part={number}")

    return write


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


