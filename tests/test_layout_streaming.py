"""Two-column pages, and streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from itembank.operators import layout as Y
from itembank.operators import reports as R
from itembank.operators.review import wrong_book
from itembank.streaming import attempts as S
from itembank.streaming.library import CellTable, cells

ITEM = "doc_id bigint, page int, item_no int, x double, y double, w double, h double, str string"


def page(spark, left=36.0, right=306.0):
    rows, n = [], 0
    for r in range(24):
        for x, words in ((left, "左 单选 题"), (right, "右 多选 题")):
            for i, word in enumerate(words.split()):
                rows.append((1, 1, n, x + i * 30, 800.0 - 16 * r, 20.0, 12.0, word + str(r)))
                n += 1
    return spark.createDataFrame(rows, ITEM).repartition(3)


def test_columns_are_read_one_after_the_other(spark):
    lines = Y.reading_order(page(spark)).orderBy("line").collect()
    assert len(lines) == 48 and [r["line"] for r in lines] == list(range(1, 49))
    assert all("右" not in r["text"] for r in lines[:24]) and all("左" not in r["text"] for r in lines[24:])
    assert lines[0]["text"] == "左0 单选0 题0"


def test_each_split_finds_the_gap(spark):
    framed = Y.framed(page(spark))
    for f in (Y.two_means, Y.blank_band, Y.gap_vote):
        x = f(framed).collect()[0]["split_x"]
        assert 116 < x < 306


def test_rows_follow_a_moving_baseline(spark):
    """Six items drifting by 1.4 points: a mean follows the first two, the third opens the next row."""
    rows = [(1, 1, i, 30.0 * i, 100 - 1.4 * i, 20.0, 10.0, str(i)) for i in range(6)]
    df = spark.createDataFrame(rows, ITEM)
    assert [r["row"] for r in Y.cluster_rows(df).orderBy("item_no").collect()] == [1, 1, 2, 2, 3, 3]
    nearest = spark.createDataFrame([(1, 1, i, 0.0, y, 1.0, 1.0, "a") for i, y in enumerate((10.0, 12.0, 11.4, 10.9, 20.0))], ITEM)
    assert [r["row"] for r in Y.cluster_rows(nearest).orderBy("item_no").collect()] == [3, 2, 2, 2, 1]


def test_rows_equal_a_search_of_all_rows():
    import random

    rng = random.Random(5)
    for moving, tolerance in ((True, 1.5), (False, 2.0)):
        for _ in range(200):
            ys = [rng.choice((rng.uniform(0, 30), rng.randrange(0, 60) / 2)) for _ in range(rng.randrange(1, 60))]
            rows, owner = [], []  # baseline and size of each row, oldest first
            for y in ys:
                fit = [(abs(b - y) if moving else 0, i) for i, (b, _) in enumerate(rows) if abs(b - y) <= tolerance]
                if fit:
                    i = min(fit)[1]
                    b, n = rows[i]
                    rows[i] = (b + (y - b) / (n + 1) if moving else b, n + 1)
                else:
                    i = len(rows)
                    rows.append((y, 1))
                owner.append(i)
            order = sorted(range(len(rows)), key=lambda i: -rows[i][0])
            assert Y._rows_of(ys, tolerance, moving) == [order.index(i) + 1 for i in owner]


def test_groups_side_by_side_equal_each_alone():
    import random

    import numpy as np

    from itembank.operators.pages import row_numbers

    rng = random.Random(7)
    for moving, tolerance in ((True, 1.5), (False, 2.0)):
        groups = [[rng.choice((rng.uniform(0, 60), rng.randrange(0, 40) / 2)) for _ in range(rng.choice((0, 1, 3, 40, 90)))] for _ in range(700)]
        groups = [[y for y in g for _ in range(rng.randrange(1, 4))] for g in groups] + [[]]
        starts = np.append(0, np.cumsum([len(g) for g in groups]))
        got = row_numbers(np.array([y for g in groups for y in g]), starts, tolerance, moving)
        for g, a, b in zip(groups, starts[:-1], starts[1:]):
            assert got[a:b].tolist() == Y._rows_of(g, tolerance, moving)


def test_lines_are_read_in_one_pass_over_pages(spark, capsys):
    """No function is called for every item: one map over pages, many in one call."""
    one = page(spark)
    many = one.crossJoin(spark.range(200).withColumnRenamed("id", "d")).withColumn("doc_id", F.col("d")).drop("d")
    lines = Y.reading_order(many)
    lines.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan and "ArrowEvalPython" not in plan
    want = [(r["line"], r["col"], r["text"]) for r in Y.reading_order(one).orderBy("line").collect()]
    got = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "col", "text"))).alias("ls")).collect()
    assert len(got) == 200 and all([tuple(x) for x in r["ls"]] == want for r in got)


def test_broken_items_and_empty_pages(spark):
    bad = [(1, 1, 0, float("nan"), 1.0, 1.0, 1.0, "a"), (1, 1, 1, 1.0, None, 1.0, 1.0, "b"), (1, 1, 2, 1.0, float("inf"), 1.0, 1.0, "c"),
           (2, 1, 0, 5.0, 5.0, None, None, "x"), (2, 1, 1, 1.0, 5.0, -1.0, 0.0, "y"), (2, 1, 2, 9.0, 5.0, 1.0, 1.0, " ")]
    df = spark.createDataFrame(bad, ITEM)
    assert [(r.doc_id, r.line, r.text) for r in Y.reading_order(df).collect()] == [(2, 1, "yx")]
    assert Y.reading_order(df.limit(0)).count() == 0 and Y.page_source(df).count() == 1


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    S.use_rocksdb(spark)
    src, out, ckpt = (str(tmp_path / d) for d in ("src", "out", "ckpt"))
    start = dt.datetime(2024, 1, 1)
    rows = [("b", str(i % 5), start + dt.timedelta(hours=i), i, (i * 7919) % 10 < 8) for i in range(400)]
    schema = "bank string, qid string, answered_at timestamp, seq bigint, correct boolean"
    for part in (rows[:250], rows[250:]):  # the second run starts from the checkpoint of the first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        updates = S.review_updates(spark.readStream.schema(schema).parquet(src))
        q = updates.writeStream.outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True)
        q.foreachBatch(S._batch_writer(out)).start().awaitTermination()
    updates = spark.read.schema(S.RESULT + ", _batch bigint").parquet(out)
    got = S.latest_book(updates.drop("_batch", "part"))
    want = wrong_book(spark.createDataFrame(rows, schema))
    cols = ["bank", "qid", "wrong_count", "correct_streak", "stage", "next_review", "added_at", "last_wrong_at", "last_answer_at"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_keys_of_a_bucket_are_folded_together():
    """Thousands of keys, null ones too, in one call a batch; every change equals a reading answer by answer."""
    import random

    import pandas as pd

    class Records(dict):
        exists, containsKey, getValue, updateValue, removeKey = (  # noqa: N815
            lambda self: len(self) > 0, dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__)

    rng, start, processor = random.Random(11), dt.datetime(2024, 1, 1), S.ReviewProcessor()
    processor.records, book, seq = Records(), {}, 0
    for batch in range(3):
        rows, want = [], []
        for key in range(3000):
            bank, qid = (None if key % 50 == 0 else str(key // 5)), str(key % 5)
            for _ in range(rng.choice((0, 1, 9, 20)) if key else 40):
                at, right, seq = start + dt.timedelta(days=batch, minutes=seq % 700), rng.random() < 0.85, seq + 1
                rows.append((bank, qid, seq, at, right))
        for bank, qid, n, at, right in sorted(rows, key=lambda r: (r[3], r[2])):
            rec = book.pop((bank, qid), None)
            if not right:
                status, rec = ("updated", (rec[0] + 1, 0, rec[2], at, at)) if rec else ("added", (1, 0, at, at, at))
            elif rec:
                rec = (rec[0], rec[1] + 1, *rec[2:4], at)
                status = "graduated" if rec[1] == 7 else "updated"
            else:
                status = "none"
            if rec and status != "graduated":
                book[bank, qid] = rec
            stage = min(rec[1], len(S.INTERVALS) - 1) if rec else None
            due = (at + dt.timedelta(days=S.INTERVALS[stage])).date() if rec else None
            want.append((bank, qid, n, status, *(rec[:2] if rec else (None, None)), stage, due, *(rec[2:] if rec else (None,) * 3)))
        rng.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["bank", "qid", "seq", "answered_at", "correct"])
        out = pd.concat(list(processor.handleInputRows((0,), iter([frame[:5000], frame[5000:]]), None)))
        assert list(out.columns) == [c.split()[0] for c in S.RESULT.split(", ")]
        got = [tuple(None if pd.isna(v) else v for v in r) for r in out.astype(object).itertuples(index=False)]
        assert sorted(got, key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])
        assert dict(processor.records) == book


def test_closed_sessions_leave_the_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    start = dt.datetime(2024, 1, 1)
    rows = [("b", start + dt.timedelta(minutes=m), m % 2 == 0) for m in (0, 10, 20, 90, 100, 9000)]
    schema = "bank string, answered_at timestamp, correct boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = S.drain(S.sessions(spark.readStream.schema(schema).parquet(src)), "append", label="sessions")
    assert sorted(r["answered"] for r in out.collect()) == [2, 3]
    assert out.filter(F.col("ended_at") == start + dt.timedelta(minutes=50)).count() == 1


def test_library_totals_over_many_batches_equal_one_reading(spark, tmp_path):
    """Five batches with snapshots after the second and fourth; a replayed batch changes nothing; old folders go."""
    start = dt.datetime(2024, 1, 1)
    rows = [
        ("b" if i % 3 else None, i % 7, "order", "单选" if i % 2 else "判断", "t" * (i % 3), start + dt.timedelta(minutes=i), i % 5 > 0)
        for i in range(300)
    ]
    schema = "bank string, session_id int, mode string, qtype string, topic string, answered_at timestamp, correct boolean"
    whole = spark.createDataFrame(rows, schema)
    sink = CellTable(spark, str(tmp_path / "cells"), every=2)
    for n in range(5):
        batch = spark.createDataFrame(rows[n * 60:(n + 1) * 60], schema)
        sink.write(batch, n)
        if n in (1, 4):
            sink.write(batch, n)  # covered by a snapshot, then a part of its own
    assert sorted(p.name for p in (tmp_path / "cells" / "snapshots").iterdir() if p.name.isdigit()) == ["3"]
    assert sorted(p.name for p in (tmp_path / "cells" / "parts").iterdir() if p.name.isdigit()) == ["4"]
    got = sink.read(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells(whole).schema.fields))
    for report in (R.library_totals, R.by_type, R.by_mode, R.library_weak, R.recent_sessions):
        assert sorted(map(str, report(got).collect())) == sorted(map(str, report(whole).collect()))
    assert CellTable(spark, str(tmp_path / "none")).read("bank string, session_id int, mode string, qtype string, topic string, "
                                                         "answered bigint, correct bigint, answered_at timestamp").count() == 0
