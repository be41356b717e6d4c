"""Extraction, secrets and licenses against brute force and on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from itembank.llm import extraction, licenses, secret_scan
from itembank.llm.automata import compile_rules

ODD = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "x y"), (4, "w " * 40_000), (5, " \n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    # extra columns with the names of results and of inner columns
    return rows.withColumn("spans", F.lit(1)).withColumn("n_words", F.lit("q")).withColumn("low", F.lit(2.5)).withColumn("words", F.lit(0))


def page(body):
    return f"<html><head><title>no</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_main_text_drops_what_is_not_the_article():
    html = page(
        '<header class="top"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>'
        '<div class="notice">We keep small files on your computer to make this place work, please agree to it now.</div>'
        '<article><h1>A heading</h1><p>One &amp; <b>two</b>\n  three&nbsp;four.<p>Half a sentence that goes on for quite a while &lt;here&gt;.</p>'
        '<div class="ad">Buy the best thing that anyone has ever made, today and only here, for half.</div>'
        '<section class="comments"><p>I liked this text very much and want to say so to everyone who reads it.</p></section></article>'
        '<aside><p>Read also what others read today, chosen for you by nobody in particular at all.</p></aside>'
        "<form><p>Leave your address here and we will write to you each and every morning.</p></form>"
        '<script>var a = "<p>no</p>";</script><!-- <p>no</p> --><footer>&copy; 2020 nobody</footer>'
    )
    assert extraction.main_text(html) == "A heading\nOne & two three four.\nHalf a sentence that goes on for quite a while <here>."


@pytest.mark.parametrize("html", ["", "<", "<p", "<!-- open", "<script>open", "</p></div>", "&amp", "<p title='a>b'>", "<a>" * 2000, "<div>" * 500 + "x"])
def test_broken_pages_are_read(html):
    assert isinstance(extraction.main_text(html), str)


def cut_value(side, costs, edges):
    lost = sum(max(-c, 0) for s, c in zip(side, costs) if s) + sum(max(c, 0) for s, c in zip(side, costs) if not s)
    return lost + sum(w for a, b, w in edges if side[a] != side[b])


def test_minimum_cut_is_minimal():
    rnd = random.Random(4)
    for _ in range(60):
        n = rnd.randint(1, 7)
        costs = [rnd.choice([0, 1.5, -1.5, 0.3, -2.5, 4]) for _ in range(n)]
        edges = [(a, b, rnd.choice([0.4, 0.8, 2])) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        best = min(cut_value([bool(m >> k & 1) for k in range(n)], costs, edges) for m in range(1 << n))
        assert cut_value(extraction.minimum_cut(costs, edges), costs, edges) == pytest.approx(best)


def test_extract_keeps_every_row(spark):
    rows = [(1, "u", page("<p>Same text of a page.</p>")), (1, "u", page("<p>Same text of a page.</p>")), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other")).withColumn("n_chars", F.lit(0))
    found = sorted(((r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).collect()), key=str)
    assert found == sorted([(1, "Same text of a page.", 20), (1, "Same text of a page.", 20), (2, "", 0), (None, "", 0)], key=str)
    assert extraction.extract(pages.limit(0)).count() == 0


def brute_spans(text):
    out = []
    for number, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, re.A):
            size = len(m[0]) - (re.match(rule.value, m[0]).end() if rule.value else 0)
            if size >= rule.least:
                out.append((m.start(), m.end(), number))
    return sorted(out, key=lambda s: (s[0], s[2]))


PARTS = ["token", "SECRET", "api_key", "Passwd", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "é", "\n", "ghp_",
         "abcdefghijklmnopqrstuvwxyz0123456789", "xoxb-", "eyJ", ".", "sk_live_", "http", "://", "user", "pw", "@", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "AIza", "_", "日本", "😀"]


def test_spans_equal_regular_expressions():
    rnd, scan = random.Random(7), secret_scan.scanner(secret_scan.RULES)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert scan.spans(text) == brute_spans(text), text


def test_automaton_is_minimal_and_right():
    dfa = compile_rules(["a(?:b|c)*d", "ab{2,3}"])
    for text in ("ad", "abcbd", "abb", "abbb", "abbbb", "a", "", "abd"):
        row = dfa.rows[0]
        for byte in text.encode():
            row = row[byte]
        expected = tuple(k for k, p in enumerate(["a(?:b|c)*d", "ab{2,3}"]) if re.fullmatch(p, text))
        assert row[256] == expected, text
    assert len(compile_rules(["aa|ab|ba|bb"]).accepts) == len(compile_rules(["[ab][ab]"]).accepts)


def test_secret_report_on_odd_rows(spark, odd):
    report = secret_scan.secret_report(odd).collect()
    assert len(report) == len(ODD) and all(r.spans == "" and r.n_hex == 0 for r in report)
    assert secret_scan.secret_report(odd.limit(0)).count() == 0
    text = "é token = 'abcdefghijkl' and token=deadbeefdeadbeef0"
    row = secret_scan.secret_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert row.spans == "assign:2:23,assign:29:52,hex:35:52" and (row.n_assign, row.n_hex) == (2, 1)
    masked = spark.createDataFrame([(text,), (None,)], "text string").select(secret_scan.redact(F.col("text")).alias("t")).collect()
    assert [r.t for r in masked] == ["é [secret]' and [secret]", None]


LICENSES = [
    "", None, "MIT License", "x mit-license mit license. The MIT LICENSE", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: Apache-2.0\nhttps://www.apache.org/licenses/LICENSE-2.0", "général public license GENERAL\nPUBLIC license é mit\x00license",
    "All rights reserved. Copyright (c) 2020 BSD 3-clause license mpl 2.0", "permission is hereby granted, free of charge, without warranty of any kind",
    "mit " * 30_000 + "license",
]


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, low)
    places = sorted(
        (i, label) for label, phrase in licenses.PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase
    )
    found = [
        (r.label, r.priority, n, m.start(), m.end())
        for n, r in enumerate(licenses.rules()) if r.keyword in low for m in re.finditer(r.pattern, low, re.A)
    ]

    def beats(o, s):
        longer = (o[4] - o[3]) - (s[4] - s[3])
        return o[3] <= s[3] and o[4] >= s[4] and (o[1] > s[1] or (o[1] == s[1] and (longer > 0 or (longer == 0 and o[2] < s[2]))))

    return len(words), places, sorted(s for s in found if not any(beats(o, s) for o in found))


def test_licenses_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")
    for r in licenses.license_scan(rows).collect():
        found = sorted((x.label, x.priority, x.number, x.start, x.end) for x in r.found)
        assert (r.n_words, [tuple(p) for p in r.places], found) == brute_licenses(LICENSES[r.doc_id]), LICENSES[r.doc_id]


def test_license_report_on_odd_rows(odd):
    report = licenses.license_report(odd).collect()
    assert len(report) == len(ODD) and all(r.labels == "" and r.score == 0 and r.first_word is None for r in report)
    assert licenses.license_report(odd.limit(0)).count() == 0
    assert len(licenses.rules()) > 300 and "Python" not in licenses.license_report(odd)._jdf.queryExecution().executedPlan().toString()


BODY = "MIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEAAoIBAQC7\nVJTUt9Us8cKjMzEfYyjiWA4R4/M2bS1GB4t7NXp98C3SC6dVMvDuictGeurT8jNb\nvJZHtCSuYEvu=="


@pytest.mark.parametrize("head", ["", "RSA ", "ENCRYPTED "])
@pytest.mark.parametrize("body", [BODY, BODY.replace("\n", "\r\n"), BODY.replace("\n", "\\n"), "Proc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,0123456789ABCDEF\n\n" + BODY])
def test_whole_private_keys_are_masked(spark, head, body):
    key, scan = f"-----BEGIN {head}PRIVATE KEY-----\n{body}\n-----END {head}PRIVATE KEY-----", secret_scan.scanner(secret_scan.RULES)
    open_key = key[: key.index("\n-----END")]
    number = next(n for n, r in enumerate(secret_scan.RULES) if r.kind == "private_key")
    for text in (f"é {key}\nnext. {key}", f"é {open_key}\n\n- next", key, open_key):
        spans = scan.spans(text)
        assert [text[s:e] for s, e, n in spans if n == number] == [key if key in text else open_key] * text.count("-----BEGIN")
        assert spans == brute_spans(text)
    rows = spark.createDataFrame([(f"é {key}\nnext. {key}",), (f"é {open_key}\n\n- next",)], "text string")
    assert [r.t for r in rows.select(secret_scan.redact(F.col("text")).alias("t")).collect()] == ["é [secret]\nnext. [secret]", "é [secret]\n\n- next"]

NAMES = ["the MIT", "Apache 2.0", "Apache License, Version 2.0", "Boost Software", "SIL Open Font", "MPL 2.0", "Mozilla Public License v1.1", "PSF", "Python Software Foundation",
         "Do What the Fuck You Want to Public", "GNU General Public License, version 3", "GNU Lesser General Public", "GNU Affero General Public License", "BSD-3-Clause",
         "new BSD", "CC BY-SA 4.0", "Creative Commons by-nc 2.5", "CC0 1.0", "European Union Public", "open data commons open database", "Eclipse Public License - v 2.0", "Microsoft Reciprocal"]
URLS = ["https://opensource.org/licenses/MIT", "https://unlicense.org", "wtfpl.net", "https://joinup.ec.europa.eu/x/eupl", "docs.python.org/3/license", "postgresql.org/about/licence",
        "creativecommons.org/licenses/by-nc-sa/3.0", "SPDX-License-Identifier: PSF-2.0", "copyright © 2020", "into the public domain", "confidential and proprietary"]


def test_the_gate_loses_nothing(spark):
    wholes = [f"{head} {name}{tail}" for name in NAMES for head in ("released under the", "available under", "Licensed under", "x") for tail in (".", " License")]
    texts = [t for w in wholes for t in (w, w.replace(" ", "\n"), w.replace(" ", " \n "))] + URLS
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every, some = list(enumerate(licenses.rules())), set()
    for r in rows.select("doc_id", licenses.detections(F.lower("text")).alias("found")).collect():
        low = texts[r.doc_id].lower()
        brute = [(x.label, x.priority, n, m.start(), m.end()) for n, x in every for m in re.finditer(x.pattern, low, re.A)]
        assert [(x.label, x.priority, x.number, x.start, x.end) for x in sorted(r.found, key=lambda x: (x.number, x.start))] == brute, texts[r.doc_id]
        some.update(x.label for x in r.found)
    assert {"mpl-2.0", "python-2.0", "wtfpl", "mit", "apache-2.0", "boost-1.0", "ofl-1.1"} <= some
