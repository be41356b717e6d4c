"""Knowledge text in, items out."""

import hashlib
import random

from pyspark.sql import functions as F

from itembank.operators import generate as N

SCHEMA = "bank string, doc_id bigint, pos int, page int, line int, para int, text string"
POOL = (
    "1851 年，中国爆发了太平天国运动，沉重打击了清王朝统治。\n1919年五四运动标志着新民主主义革命的开端，意义十分重大。\n"
    "辛亥革命推翻了两千多年的君主专制制度，建立了中华民国。\n光合作用是绿色植物把光能转化为化学能的重要过程。"
)


def lines(spark, text):
    return spark.createDataFrame([("b", 1, i, 0, i + 1, 0, t) for i, t in enumerate(text.split("\n"))], SCHEMA)


def usable(spark, text):
    return N.usable_sentences(lines(spark, text))


def hits(spark, text):
    row = usable(spark, text).collect()[0]
    return {(h["term"], h["kind"], h["index"]) for h in row["hits"]}


def test_terms_and_cloze(spark):
    text = "1851 年，中国爆发了太平天国运动，沉重打击了清王朝统治。"
    got = hits(spark, text)
    assert ("1851 年", "number", 0) in got and ("太平天国运动", "term", 12) in got
    assert any(t == "中国" and k == "name" for t, k, _ in got)
    q = N.cloze_items(usable(spark, text)).collect()[0]
    assert q["stem"] == "1851 年，中国爆发了 ____ 运动，沉重打击了清王朝统治。"
    assert q["options"] == {"A": "太平天国"} and q["year"] is None


def test_quote_numbers_and_acronym(spark):
    got = hits(spark, "鲁迅在《狂人日记》中批判了封建礼教对人的压迫。")
    assert ("狂人日记", "quote", 4) in got
    got = {(t, k) for t, k, _ in hits(spark, "中国于 2001 年加入 WTO，关税水平下降到 9.8%。")}
    assert {("2001 年", "number"), ("9.8%", "number"), ("WTO", "en")} <= got


def test_no_blank_too_large(spark):
    rows = usable(spark, "中国特色社会主义的根本方向。").collect()
    assert all(not r["choices"] for r in rows)


def test_choices(spark):
    u = usable(spark, POOL)
    rows = N.choice_items(u).orderBy("pos").collect()
    assert len(rows) == 4
    first = rows[0]
    assert set(first["options"].values()) == {"五四", "光合作用", "太平天国", "辛亥"} or len(set(first["options"].values())) == 4
    for r in rows:
        assert len(set(r["options"].values())) == 4
        assert r["options"][r["answer"]] not in r["stem"]


def test_no_choice_without_pool(spark):
    assert N.choice_items(usable(spark, "光合作用是绿色植物把光能转化为化学能的重要过程。")).count() == 0


def test_judge_changes(spark):
    text = "中国关税总水平必须逐步下降到一个较低水平。\n2001年以后关税水平逐步下降到 0.6%，贸易规模扩大。\n五四运动是一场伟大的爱国运动，影响深远。\n五四运动不是一场单纯的文化运动，影响深远。"
    rows = N.judge_items(usable(spark, text)).orderBy("pos").collect()
    assert [r["answer"] for r in rows] == ["正确", "错误", "正确", "错误"]
    assert rows[1]["stem"] != rows[1]["raw"]
    assert rows[3]["stem"] == "五四运动是一场单纯的文化运动，影响深远。"


def test_percent_moves_by_ten(spark):
    u = usable(spark, "关税水平多年来逐步下降到 0.6%，贸易规模扩大。")
    assert "10.6%" in N.mutate(u).collect()[0]["mutated"]


def test_noise_gives_nothing(spark):
    text = "第一章 总论\n目录\n关注公众号领取更多学习资料和习题答案。\n答案：这一行不应该被拿来出题的。\n解析：这一行也不应该被拿来出题。\n- 7 -\n太短。"
    filtered = N.filter_sentences(N.sentences(N.drop_repeated_headers(N.prepared_lines(lines(spark, text)))))
    assert filtered.filter("reason = ''").count() == 0


def test_overlap_free_and_reproducible(spark):
    a = N.generate(lines(spark, POOL), 10).orderBy("ord").collect()
    b = N.generate(lines(spark, POOL).repartition(4), 10).orderBy("ord").collect()
    assert [r["qid"] for r in a] == [r["qid"] for r in b] and len(a) == 4
    for r in usable(spark, POOL).collect():
        spans = sorted((h["index"], h["index"] + len(h["term"])) for h in r["hits"])
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def _picks_by_hand(pool, items):
    """Reads the rules one by one: (pos, distractors) of every item that has three."""
    ring = sorted((hashlib.sha1(f"{N.SEED}|{k}".encode()).hexdigest(), k, kind) for k, kind in pool)
    out = {}
    for bank, doc, pos, sent, no, kind, blank, text in items:
        near = [k for _, h, k in sorted((len(k), h, k) for h, k, c in ring if c == kind and abs(len(k) - len(blank)) <= N.LEN_TOLERANCE)]
        names = [str(N.SEED), *([] if bank is None else [bank]), str(doc), str(pos), str(sent), str(no)]
        at = int(hashlib.sha1("|".join(names).encode()).hexdigest()[:8], 16)
        all_ = [k for _, k, _ in ring]
        walk = [near[(at + j) % len(near)] for j in range(len(near))] + [all_[(at + j) % len(all_)] for j in range(len(all_))]
        fit = [k for k in dict.fromkeys(walk) if k not in blank and blank not in k and k not in text]
        if len(fit) >= 3:
            out[pos] = fit[:3]
    return out


def test_distractors_equal_a_plain_reading(spark):
    """Answers that nearly every pool term contains, sentences that hold most terms, a kind without a pool, and a null bank."""
    rnd = random.Random(3)
    terms = sorted({"x" + "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(500)}) + ["q", "rst", "uv", "wyz"]
    pool = [(t, rnd.choice(["term", "name"])) for t in terms]
    for bank in ("b", None):
        items = [(bank, 1, p, 0, 0, rnd.choice(["term", "name", "en"]), rnd.choice(["x", "x", "q", "xa", *terms]), "zz" + "".join(rnd.sample(terms, 3))) for p in range(60)]
        items += [(bank, 1, 60 + p, 0, 0, "term", "x", f"{p}qrstuv") for p in range(20)] + [(bank, 1, 80, 0, 0, "term", "x", "-".join(["q", "rst"]))]
        ranked = N.rank_pool(spark.createDataFrame([(bank, t, t, k, len(t)) for t, k in pool], "bank string, key string, text string, kind string, len int"))
        df = spark.createDataFrame([(*i[:7], len(i[6]), i[7]) for i in items], "bank string, doc_id bigint, pos int, sent int, blank_no int, kind string, blank string, len int, text string")
        found = {r.pos: list(r.distractors) for r in N.pick_distractors(df, ranked, window=4, widest=64).collect()}
        assert found == _picks_by_hand(pool, items)
        assert 60 not in found and len(found) > 40


def test_items_without_distractors_do_not_walk(spark, monkeypatch):
    """200 answers that each of 20,000 terms contains go after the first window."""
    terms = [f"x{k:05d}" for k in range(20_000)]
    ranked = N.rank_pool(spark.createDataFrame([("b", t, t, "term", 6) for t in terms], "bank string, key string, text string, kind string, len int"))
    df = spark.createDataFrame([("b", 1, p, 0, 0, "term", "x", 1, f"sentence {p}") for p in range(200)], "bank string, doc_id bigint, pos int, sent int, blank_no int, kind string, blank string, len int, text string")
    walked, window = [], N._ring_window
    monkeypatch.setattr(N, "_ring_window", lambda todo, *args: walked.append(todo.count()) or window(todo, *args))
    assert N.pick_distractors(df, ranked).count() == 0
    assert [n for n in walked if n] == [200]


def test_detectors_run_once(spark):
    found = N.key_terms(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (found, found.select("doc_id", F.explode("raw")))]
    assert plans[0].count(N.PERSON) == plans[1].count(N.PERSON) > 0


def test_topics_pass_over_noise(spark):
    rows = [(0, 0, "第一章 改革开放的历史背景。", "heading"), (1, 0, "a", "short"), (2, 0, "x", ""), (2, 1, "Two words", "heading"), (2, 2, "y", "page"), (3, 0, "z", "")]
    df = spark.createDataFrame([("b", 1, *r) for r in rows], "bank string, doc_id long, pos int, sent int, text string, reason string")
    got = {r["text"]: r["topic"] for r in N.usable_with_topics(df).collect()}
    every = {r["text"]: r["topic"] for r in N.carry_topics(df).filter("reason = ''").collect()}
    assert got == every == {"x": "改革开放的历史背景。", "z": "Two words"}


def test_word_places(spark):
    texts = ["", "xaa", "国家国", "会议会议😀会议", "the edthe ed", "tionation", "dad dadx"]
    words = ["国", "会议", "the ed", "tion", "dad", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.expr(N._word_hits("text", words)).alias("hits"))
    want = {t: [(w, i) for w in words for i in range(len(t)) if t.startswith(w, i)] for t in texts}
    assert {r["text"]: [tuple(h) for h in r["hits"]] for r in df.collect()} == want


def test_balance_works_out_only_what_is_read(spark):
    """Explanations, topics and texts that nobody reads are not moved through the choice of items."""
    rows = usable(spark, POOL).localCheckpoint()
    items = N.cloze_items(rows).unionByName(N.judge_items(rows))
    chosen = N.balance(items, rows, 10)
    narrow = chosen.select("bank", "doc_id", "pos", "sent", "kind", "qid", "ord")
    told = [df._jdf.queryExecution().optimizedPlan().toString().count("出自原文") for df in (chosen, narrow)]
    assert told[0] > 0 and told[1] == 0
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, chosen.select(narrow.columns).collect()))
    assert set(chosen.columns) == {*items.columns, "ord"}
