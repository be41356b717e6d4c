"""Filter audit, embedding whitening and quality rules against brute force and on odd rows."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from itembank.llm import filter_audit, quality_rules, whitening

DOCS = "doc_id bigint, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_rows():
    """Failures of every kind; repeated rows, null ids, texts and sources; one part with most rows."""
    long, busy = " ".join(f"w{i}" for i in range(220)), " ".join(["a b"] * 150)
    texts = [long, busy, "HELLO THERE", "x # y", "", None, long + " $", busy.upper(), "  ", long]
    rows = [(i, texts[i % len(texts)], "big" if i % 3 else f"s{i % 5}") for i in range(90)]
    rows += [(None, long, None), (None, long, None), (7, texts[7], "big"), (7, "other", ""), (200, "é " * 201, None)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(3, 0, 1), (None, 1, 1), (999, 1, 1), (4, None, None)]
    return rows, labels


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                  "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[s or ""].append(({f for f in failed if failed[f]}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [d for d in docs if f in d[0] and not d[0] & before]
                shapley[part, f] += len(removed)
                out.append([part, "".join(order), k + 1, sum(not d[0] & {*before, f} for d in docs), len(removed),
                            sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs),
                            sum(d[1] for d in removed), sum(d[2] for d in removed), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 7)
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", part string, Text int").repartition(3)
    told = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, good string")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, told).select(*AUDIT).collect())
    assert got == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty, labels).collect() == []


def test_merges_of_sorted_lists():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        lists = [np.unique(rnd.integers(0, 60, rnd.integers(0, 40))) for _ in range(5)]
        assert filter_audit.merged(lists).tolist() == sorted(set().union(*map(set, map(np.ndarray.tolist, lists))))
        a, b = lists[:2]
        assert a[filter_audit.hits(a, b)].tolist() == sorted({*a.tolist()} & {*b.tolist()})


def brute_rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, duplicates = set(), 0
    for line in lines:
        duplicates += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    base = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicates, len(again), base


def test_rules_equal_brute_force(spark):
    prose = "the cat of the house is in a garden and that was all it did for the day as we know by now "
    texts = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", prose * 3, prose + " ".join(f"n{i} of the" for i in range(60)),
             "# $ % & | < > *" * 20, "é ü z\u0085q r \x0b \x0c end", "w" * 50_000, " ".join(f"k{i % 977}" for i in range(60_000)),
             "\n".join(["- item of the list"] * 40), " ".join(f"the{i} of x{i} to" for i in range(40))]
    rows = [(i, t, 0, "z") for i, t in enumerate(texts)] + [(None, "a b", 0, "z"), (2, texts[2], 0, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, `WORDS` string")
    got = quality_rules.rules_report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            n, chars, symbols, duplicates, again, base = brute_rules(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, duplicates, again, base)
            assert not (base and r["kept"])
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[15]["kept"] and by_id[9]["base_failed"] == brute_rules(texts[9])[-1]
    assert quality_rules.rules_report(df.limit(0)).collect() == []


def test_bounds_are_exact(spark):
    df = spark.range(1).selectExpr("50L AS n_words", "5L AS n_symbols", "1L AS one")
    at, above = (quality_rules.Rule("r", "n_symbols", "n_words", most=m) for m in (100, 99))
    assert df.select(at.fails().alias("a"), above.fails().alias("b")).head() == (False, True)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_numpy(spark, weights):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(60, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    data = [[float(v) for v in row] for row in base] + [[float(v) for v in base[0]]] * 40
    rows = [(i, v) for i, v in enumerate(data)]
    odd = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [1.0])]
    df = spark.createDataFrame([(*r, 1, "k") for r in [*rows, *odd, (None, data[3])]], "vec_id bigint, embedding array<double>, x int, key string")
    got = whitening.whiten(df, components=4, weights=weights).toPandas()
    x = np.floor(64 * np.array([*data, data[3]])).astype(np.int64) + 1_000_000
    fitted = x if weights == "counts" else np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fitted.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    z = ((x - s / n) @ axes) / np.sqrt(values)
    assert len(got) == 4 * len(x) and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    known = got[got["vec_id"].notna()].set_index(["vec_id", "component"]).sort_index()
    found = known["whitened"].unstack().to_numpy()
    sign = np.sign((found * z[: len(data)]).sum(axis=0))
    assert np.allclose(found * sign, z[: len(data)], atol=1e-8)
    assert known["deviation"].unstack()[1].tolist() == ((n * x - s) ** 2).sum(axis=1)[: len(data)].tolist()
    assert np.allclose(known["explained"].unstack().iloc[0], values / np.trace(np.cov(fitted.T, bias=True)))


def test_whitening_without_variance_and_of_nothing(spark):
    kind = "vec_id bigint, embedding array<float>"
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], kind)).collect()
    assert len(same) == 10 and {(r["whitened"], r["explained"], r["deviation"]) for r in same} == {(0.0, 0.0, 0)}
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0])], kind)).collect()
    assert len(huge) == 4 and {r["deviation"] for r in huge} == {None}
