"""Canonical views: the engine's tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.constants import QUESTION_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text dealt to one task: its words, each a row many times as long as the word, are sorted in memory.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Documents dealt by id before their texts are taken apart, so many bytes of text to a task.

    The pattern-heavy work then runs on all cores however few files or row groups the table has,
    and the windows over a document's lines and the groups of its pages find their rows together
    without another shuffle. The number of tasks follows from the texts: by their shuffled size
    alone tasks would be merged until the rows taken out of them no longer fit in memory.
    """
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // SPREAD_BYTES))
    return df.repartition(tasks, "doc_id")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _letter(index: Column) -> Column:
    return _pick(index, ["A", "B", "C", "D"])


def _right_answer(key: Column, qtype: Column, name: Column) -> Column:
    pairs = _pick(key % 4, ["AB", "BC", "CD", "AD"])
    return (
        F.when(qtype == "单选", _letter(key % 4))
        .when(qtype == "多选", pairs)
        .when(qtype == "判断", F.when(key % 2 == 0, "正确").otherwise("错误"))
        .otherwise(name)
    )


def _wrong_answer(key: Column, qtype: Column) -> Column:
    return (
        F.when(qtype == "单选", _letter((key + 1) % 4))
        .when(qtype == "多选", _letter(key % 4))
        .when(qtype == "判断", F.when(key % 2 == 0, "错").otherwise("对"))
        .otherwise("?")
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question dimension: one row per part; the bank is the brand."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    qtype = _pick(size % 5, QUESTION_TYPES)
    return p.select(
        F.col("p_brand").alias("bank"),
        key.alias("ord"),
        key.cast("string").alias("qid"),
        F.col("p_name").alias("stem"),
        qtype.alias("qtype"),
        F.create_map(
            F.lit("A"), F.col("p_brand"),
            F.lit("B"), F.col("p_type"),
            F.lit("C"), F.concat(F.lit("size "), size.cast("string")),
            F.lit("D"), F.col("p_name"),
        ).alias("options"),
        _right_answer(key, qtype, F.col("p_name")).alias("answer"),
        F.when(size < 10, "").otherwise(F.concat(F.lit("see "), F.col("p_type"))).alias("explanation"),
        F.when(F.col("p_type") == "PROMO", "manual").otherwise("auto").alias("source"),
        (size % 3).alias("page"),
        (size % 7).alias("line"),
        (size % 2).alias("para"),
        F.when(key % 3 != 0, F.lit(1990) + size).alias("year"),
        F.when(F.col("p_type") == "STANDARD", "").otherwise(F.col("p_type")).alias("topic"),
    )


def attempts(
    spark: SparkSession, sf_dir: str, question_columns: bool = True, session_columns: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Answer facts: one row per line item.

    The order and part joins are plain equi joins left to the optimizer, and a caller that needs
    neither side skips it. ``lines`` stands in for the line items, for example as a stream.
    """
    li = (table(spark, sf_dir, "lineitem") if lines is None else lines).select(
        F.col("l_partkey"),
        F.col("l_partkey").cast("string").alias("qid"),
        F.col("l_orderkey").alias("session_id"),
        F.col("l_shipdate").cast("timestamp").alias("answered_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_suppkey").alias("tie"),
        (F.col("l_returnflag") != "R").alias("correct"),
        (F.col("l_tax") == 0).alias("fav_click"),
    )
    out = li
    if question_columns:
        p = table(spark, sf_dir, "part")
        qtype = _pick(F.col("p_size") % 5, QUESTION_TYPES)
        dim = p.select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_brand").alias("bank"),
            qtype.alias("qtype"),
            F.when(F.col("p_type") == "STANDARD", "").otherwise(F.col("p_type")).alias("topic"),
            F.col("p_name").alias("stem"),
            _right_answer(F.col("p_partkey"), qtype, F.col("p_name")).alias("answer"),
            _wrong_answer(F.col("p_partkey"), qtype).alias("wrong_answer"),
        )
        out = out.join(dim, "l_partkey").withColumn(
            "user_answer", F.when(F.col("correct"), F.col("answer")).otherwise(F.col("wrong_answer"))
        ).drop("wrong_answer")
    if session_columns:
        o = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("session_id"),
            F.col("o_custkey").alias("learner"),
            F.col("o_orderpriority").alias("mode"),
        )
        out = out.join(o, "session_id")
    return out.drop("l_partkey")


def event_attempts(events: DataFrame) -> DataFrame:
    """Answer facts of the event table; works on a batch table and on a stream."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("user_id").cast("string").alias("bank"),
        (k % 5).cast("string").alias("qid"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("answered_at"),
        F.col("event_type").alias("qtype"),
        (F.col("value") < 70).alias("correct"),
    )


def favorite_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourite clicks: the untaxed line items, each a toggle of its question."""
    return attempts(spark, sf_dir).filter("fav_click").select("bank", "qid", "answered_at", "seq", "tie")
