"""The practice sheet, its text escaping and its files."""

import os

from pyspark.sql import functions as F

from itembank.operators.sheet import practice_sheet, write_sheet


def test_sheet(spark, tmp_path):
    rows = [
        ("b", 2, "多选", 'x & <y> "z"\nnext', {"B": "乙", "A": "甲"}, "AB", ""), ("b", 1, "单选", "s", {"A": "a"}, "A", "e"), ("b", 3, "判断", "j", {}, "正确", "")]
    df = spark.createDataFrame(rows, "bank string, ord bigint, qtype string, stem string, options map<string,string>, answer string, explanation string")
    sheet = practice_sheet(df)
    html = [r["html"] for r in sheet.orderBy("section", "ord").collect()]
    assert "总题数：3 题" in html[0]
    assert html[1:4] == ["<li>单选题 1 题</li>", "<li>多选题 1 题</li>", "<li>判断题 1 题</li>"]
    assert html[4].startswith('<li class="sheet-item"><p class="sheet-stem">1.【单选题】s</p>')
    assert "x &amp; &lt;y&gt; &quot;z&quot;<br>next" in html[5] and "（无）" in html[5]
    assert html[5].index("A. 甲") < html[5].index("B. 乙")
    write_sheet(sheet, str(tmp_path / "out"))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part-"))
    assert [line for f in files for line in open(f, encoding="utf-8").read().splitlines()] == html
    assert sheet.filter(F.col("section") == 2).count() == 3
