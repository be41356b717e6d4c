"""Near duplicates, decontamination, quality and the pipeline against brute force and on odd rows."""

import collections
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from itembank.llm import decontamination, ngram_join, quality
from itembank.llm.common import table
from itembank.llm.secret_scan import RULES, masked, scanner

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    """(doc_id, n, component) by all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for k, own in enumerate(sets):
        common = collections.Counter(j for g in own for j in held[g])
        for j, both in common.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                parent[top(k)] = top(j)
        for g in own:
            held[g].append(k)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None and (top(k) not in least or key < least[top(k)]):
            least[top(k)] = key
    return sorted(((key, len(sets[k]), least.get(top(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)), key=str)


def near_copies(seed, n_groups=6):
    """Chains of edits, exact copies, and documents that share a long passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(n_groups):
        text = [word() for _ in range(rnd.choice([3, 4, 5, 6, 30, 80, 200]))]
        if rnd.random() < 0.5:
            text = text[:30] + passage
        for _ in range(rnd.randint(1, 9)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 60))):
                text[rnd.randrange(len(text))] = word()
    rows += [None, "", " \n ", rows[0].upper(), " ".join(passage), " ".join(passage[:39]), "x"]
    rnd.shuffle(rows)
    return [(k * 13 % 101 - 7, t) for k, t in enumerate(rows)] + [(None, rows[1]), (3, "again " + (rows[2] or "")), (3, "other text with one id")]


@pytest.mark.parametrize("seed,region", [(1, 64), (2, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, region):
    # the second run drives every region through pivots and cells
    monkeypatch.setattr(ngram_join, "SMALL_REGION", region)
    monkeypatch.setattr(ngram_join, "MOST_BITS", 22 if region == 64 else 12)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("key", F.lit(1)).withColumn("id", F.lit(2))
    found = sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str)
    assert found == brute_components(rows)


def test_components_of_an_empty_table(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_keeps_columns_and_unrelated_rows(spark):
    rows = [(5, "a b c d e f g h"), (4, "A b c d e f g h"), (4, "A b c d e f g h"), (9, None), (None, "z"), (10, "a b c d e f g other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["4", "4", "9", "None", "10"])


def brute_contained(docs, items):
    def grams(text):
        words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", (text or "").lower()) if w]
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({" ".join(words)} if words else set())

    found = {}
    for key, text in docs:
        own = grams(text)
        for item, told in items:
            asked = grams(told)
            both = len(own & asked)
            if asked and both * 100 >= len(asked) * 80:
                found[key, item] = max(found.get((key, item), (0, 0)), (both, len(asked)))
    return sorted(((k, i, a, b) for (k, i), (a, b) in found.items()), key=str)


def test_contained_items_equal_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 13, 14, 30, 55, 200])] + [(90, None), (91, ""), (None, "only one item here with no id")]
    docs = [(k, " ".join(word() for _ in range(rnd.choice([0, 4, 50, 3000])))) for k in range(12)] + [(None, items[7][1]), (50, None), (51, "")]
    for k, (item, text) in enumerate(items):
        if text:
            words = text.split()
            docs.append((100 + k, " ".join([word() for _ in range(700)] + words + [word()])))
            words[len(words) // 2] = "changed"
            docs += [(200 + k, "start\n" + "\n ".join(words).upper()), (300 + k, text), (300 + k, text), (300, "x " + text)]
    table_d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hashes", F.lit(1)).withColumn("item_id", F.lit("q"))
    table_i = spark.createDataFrame(items, "item_id long, text string").withColumn("n_item", F.lit(0))
    found = decontamination.contained_items(table_d, table_i)
    assert sorted(map(tuple, found.collect()), key=str) == brute_contained(docs, items)
    bad = {k for k, *_ in brute_contained(docs, items)}
    kept = decontamination.clean(table_d, table_i)
    assert kept.columns == table_d.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - bad
    assert decontamination.contained_items(table_d.limit(0), table_i).count() == 0
    assert decontamination.contained_items(table_d, table_i.limit(0)).count() == 0


def test_decontamination_runs_no_python(spark):
    plan = decontamination.contained_items(table(spark, SF, "documents"), table(spark, SF, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_on_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    found = {r.doc_id: r.keep for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    told = {r.doc_id: r.quality == 1 for r in labels.where("doc_id % 2 = 1").collect()}
    right = sum(found[k] == good for k, good in told.items())
    assert len(found) == 1000 and right >= 0.97 * len(told)
    assert sum(not found[k] for k, good in told.items() if good) <= 0.01 * len(told)


def test_rates_shrink_to_their_priors(spark):
    rows = [(k, "word other text", "big", "p") for k in range(400)] + [(1000, "word other text", "small", "p"), (1001, "word other text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(400)] + [(1000, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rates = {r.source: r.path_rate for r in quality.classify(docs, labels).join(docs, "doc_id").select("source", "path_rate").collect()}
    assert rates["big"] == pytest.approx(0.75, abs=0.02)
    assert 0.3 < rates["small"] < 0.75 and rates[None] == pytest.approx(0.75, abs=0.03)


def test_quality_on_odd_rows(spark):
    rows = [(1, None, None, "en"), (1, None, None, "en"), (2, "", "a", None), (None, "w " * 50_000, "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("_key", F.lit(1)).withColumn("n", F.lit(2))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages_do_what_they_say(spark):
    docs, sf = table(spark, SF, "documents"), SF
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for (name, stage), check in zip(corpus_pipeline.STAGES[:-1], (None, "near", "leaks", "secrets"), strict=True):
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        after = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == docs.columns and after.keys() <= before.keys()
        if check == "near":
            groups = {k: c for k, _, c in brute_components([(r.doc_id, r.text) for r in before.values()])}
            assert set(after) == set(groups.values())
        elif check == "leaks":
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            assert set(before) - set(after) == {k for k, *_ in brute_contained([(r.doc_id, r.text) for r in before.values()], items)}
        elif check == "secrets":
            scan = scanner(RULES)
            for k, r in before.items():
                text = masked(r.text, scan.spans(r.text), "[secret]")
                assert (after[k].text, after[k].n_chars) == (text, len(text) if text != r.text else r.n_chars)
    ids = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert ids.columns == ["doc_id", "n_pieces", "ids"] and ids.count() == kept.count()


def test_a_large_group_of_near_copies_is_exact(spark, monkeypatch):
    """Copies of one text on both sides of the threshold: their large region is joined on differences."""
    monkeypatch.setattr(ngram_join, "SMALL_REGION", 6)
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    text = [word() for _ in range(150)]
    rows = []
    for k in range(160):
        copy, edits = list(text), rnd.choice([1, 2, 3, 4, 5, 6])
        for _ in range(edits):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((k, " ".join(copy)))
        if k % 20 == 0:  # a second edit of a far copy
            copy[rnd.randrange(len(copy))] = word()
            rows.append((1000 + k, " ".join(copy)))
    passed = []
    real = ngram_join.within_cells
    monkeypatch.setattr(ngram_join, "within_cells", lambda *a: passed.append(1) or real(*a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str)
    expected = brute_components(rows)
    assert found == expected and passed
    assert 1 < len({c for *_, c in expected}) < len(rows)


def test_repeated_rows_and_null_ids_do_not_repeat_sets(spark, monkeypatch):
    """Every copy comes in several rows of one id, or in several rows without an id."""
    monkeypatch.setattr(ngram_join, "SMALL_REGION", 6)
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    text, rows = [word() for _ in range(150)], []
    for k in range(60):
        copy = list(text)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            copy[rnd.randrange(len(copy))] = word()
        rows += [(None if k % 3 == 0 else k, " ".join(copy))] * 4
    asked = []
    real = ngram_join.within_cells
    monkeypatch.setattr(ngram_join, "within_cells", lambda cell, sets, roots: asked.append(sets) or real(cell, sets, roots))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str)
    assert found == brute_components(rows)
    assert asked and asked[0].count() == asked[0].select("key").distinct().count()


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "x " + item), (None, "x " + item), (None, "clean text"), (None, "clean text"), (None, None), (1, item), (2, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(1))
    kept = decontamination.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, "clean text"), (None, "clean text"), (None, None), (2, "clean too")], key=str)


def test_one_row_without_an_id_stays_of_each_group(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "a b c d e f g")] * 3 + [(None, "A b  c d e f g"), (None, long), (None, long + " x"), (4, "p q r s t u"), (None, "p q r s t u"), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    kept = ngram_join.one_of_each(docs)
    texts = [(r.doc_id, " ".join(r.text.lower().split())[:9] if r.text else r.text) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(texts, key=str) == sorted([(None, "a b c d e"), (None, long[:9]), (4, "p q r s t"), (None, None), (None, "")], key=str)
