"""Null keys, orphan records, partitioning and odd lexicons lose nothing."""

import time

from itembank.functions.text import strip_bullets, trim_ws
from itembank.operators import generate
from itembank.operators.extraction import ExtractionError, infer, messages
from itembank.operators.ordering import _ranged, ordinal
from itembank.operators.picking import pick_questions
from itembank.operators.segment import Lexicon
from itembank.sources import tables
from pyspark.sql import functions as F


def test_null_keys_and_orders_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, None), (None, 1), ("a", None), ("a", 2), ("a", 5000)], "bank string, ord int")
    found = ordinal(rows, ["bank"], ["ord"]).collect()
    assert sorted(((r.bank, r.ord, r["rank"]) for r in found), key=str) == sorted(
        [(None, None, 1), (None, 1, 2), ("a", None, 1), ("a", 2, 2), ("a", 5000, 3)], key=str
    )


def test_inference_does_not_depend_on_the_partitioning(spark):
    def request(chat):
        number = int(chat[1]["content"].split("\n")[2])
        if number % 10 == 0:
            raise ExtractionError("no", "server")
        return " " if number % 10 == 1 else f"answer {number}"

    chunks = spark.range(40).select(
        F.lit("b").alias("bank"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), messages(F.col("id").cast("string")).alias("messages")
    )
    one, eight = (
        sorted((r.doc_id, r.status, r.attempts, r.response) for r in infer(chunks.repartition(n), request, backoff_s=0).collect()) for n in (1, 8)
    )
    assert one == eight
    assert sum(r[1] == "ok" for r in one) == 32 and all(r[2] == 3 for r in one if r[1] == "failed")


def test_mistakes_outlive_their_questions(spark):
    questions = spark.createDataFrame([("b", "q1", 1)], "bank string, qid string, ord int")
    wrong = spark.createDataFrame(
        [("b", "q1", 0, 3), ("b", "gone", 1, 2)], "bank string, qid string, stage int, wrong_count int"
    ).withColumn("next_review", F.lit(None).cast("date")).withColumn("added_at", F.lit(None).cast("timestamp"))
    picked = pick_questions(questions, "wrong", wrong=wrong).orderBy("position").collect()
    assert [(r.qid, r.position) for r in picked] == [("q1", 1), ("gone", 2)]


def test_lexicon_words_are_taken_literally(spark):
    lex = Lexicon(aliases={"A,B:C'题": "单选", "x.y": "多选"})
    row = spark.createDataFrame([("A,B:C'题",)], "t string").select(lex.type_of(F.col("t")).alias("a"), F.lit("xzy").rlike(lex.alternatives()).alias("b")).head()
    assert (row.a, row.b) == ("单选", False)


def test_hashed_ids_of_one_bank_are_numbered_by_many_tasks(spark):
    """A bank that holds all rows lies in many ranges, and only its counts are placed one after the other."""
    rows = spark.range(20000).select(F.lit("b").alias("bank"), F.sha1(F.col("id").cast("string")).alias("qid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if each range were large
    try:
        parts = _ranged(rows, ["bank"], ["qid"]).groupBy("__part").count().collect()
        found = ordinal(rows, ["bank"], ["qid"], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 8 and max(r["count"] for r in parts) < 5000
    assert [r.qid for r in found.orderBy("n").collect()] == sorted(r.qid for r in rows.collect())
    assert ordinal(rows.limit(0), ["bank"], ["qid"]).count() == 0


def test_favourites_outlive_their_questions(spark):
    questions = spark.createDataFrame([("b", "q1", 1)], "bank string, qid string, ord int")
    marks = spark.createDataFrame([("b", "q1"), ("b", "gone"), ("b", "gone")], "bank string, qid string")
    picked = pick_questions(questions, "favorite", favorites=marks).orderBy("position").collect()
    assert [(r.qid, r.ord, r.position) for r in picked] == [("gone", None, 1), ("q1", 1, 2)]


def test_trimming_looks_at_the_ends_only(spark):
    """A run of blanks inside a text once cost the square of its length."""
    blanks = "\t\n   　﻿"
    rows = [(f"{blanks}a{' ' * 200_000}b{blanks}",), (blanks,), ("",), (None,), ("​x\u0085",)]
    df = spark.createDataFrame(rows, "t string")
    start = time.monotonic()
    got = [r[0] for r in df.select(trim_ws(F.col("t"))).collect()]
    assert got == [f"a{' ' * 200_000}b", "", "", None, "​x\u0085"]
    assert time.monotonic() - start < 20


def test_bullets_and_numbers_go_in_three_rounds(spark):
    rows = ["• 1. （2） 三、 中", "1. 2. 3. 4. x", "1.x", "★①② a", "- ", "（12）（3）《y》", "　➤ 9） "]
    want = ["中", "4. x", "1.x", "a", "", "《y》", "➤ 9）"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(strip_bullets(F.col("t"))).collect()] == want


def test_tasks_follow_the_bytes_of_texts(spark, monkeypatch):
    """By their own size small partitions would be merged, however many rows come out of a text."""
    monkeypatch.setattr(tables, "SPREAD_BYTES", 10_000)
    docs = spark.createDataFrame([(i, "é" * 500) for i in range(400)] + [(None, None)], "doc_id long, text string")
    dealt = tables.spread(docs)
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert dealt.count() == 401 and len(parts) >= 30 and max(r["n"] or 0 for r in parts) <= 60_000


def test_repeated_headers_are_looked_up_among_written_lines(spark):
    """Cleaning ran twice, and all lines were shuffled for the few that repeat."""
    rows = [("b", i, 0, t) for i in range(4) for t in ("页眉", "## x", f"a {i}", "long " * 20)] + [(None, None, 0, "页眉")] * 4 + [("b", 9, 0, "a 0"), ("b", 9, 1, None)]
    lines = generate.prepared_lines(spark.createDataFrame(rows, "bank string, doc_id long, pos int, text string"))
    kept = generate.drop_repeated_headers(lines)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("LeftAnti") == 1 and "isnull(_key" in plan
    got = sorted((r.bank or "", r.text) for r in kept.collect())
    assert got == sorted([("b", "## x")] * 4 + [("b", f"a {i}") for i in range(4)] + [("b", "a 0")] + [("b", ("long " * 20).strip())] * 4 + [("", "页眉")] * 4)


def test_sentences_are_cut_at_any_terminator(spark):
    rows = [" 😀一。 二！？ ab;c é. ", "。。", "x", " 　 ", "", "a😀b ", "12", " P. 3", "page 12"]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "n int, text string")
    cut = lambda ends: [(r.n, r.sent, r.text) for r in generate.sentences(lines, generate.Lexicon(terminators=ends)).orderBy("n", "sent").collect()]
    want = ["😀一。", "二！", "？", "ab;", "c é."]
    assert cut("。！？；!?;.") == [(0, i, t) for i, t in enumerate(want)] + [(1, 0, "。"), (1, 1, "。"), (2, 0, "x"), (5, 0, "a😀b"), (7, 0, "P."), (7, 1, "3")]
    assert cut("😀 ")[:3] == [(0, 0, "😀"), (0, 1, "一。"), (0, 2, "二！？")]


def test_reasons_of_sentences_that_start_with_a_letter(spark):
    rows = {"page 1234567890 of 12": "page", "Page1234567890123/12": "page", "Contents": "heading", "B. 中国的首都是北京，人口很多": "option line", "请扫码加入我们的学习群，谢谢大家。": "promo",
            "Chapter one of it......................12": "contents", "b, a sentence that carries an item.": "", "• 答案：这里是正确的说法，请看上文。": "answer line"}
    sents = spark.createDataFrame([(t,) for t in rows], "text string")
    assert {r.text: r.reason for r in generate.filter_sentences(sents).collect()} == rows
