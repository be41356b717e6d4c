"""Token files, counts, pieces and fingerprints against the libraries, round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itembank.llm import fingerprints, pieces, token_counts, token_files
from itembank.llm.common import slices
from itembank.llm.tokenizer_files import ByteLevelEncoder
from itembank.session import scratch_path

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = [
    "", None, "Hello world", "it's  two  spaces\n\nand lines \n x", " lead and trail ", "a<|endoftext|>b <|startoftext|>", "ÉCOLE été 日本語 😀 ﬁ ①",
    "tab\there\x00nul", "same text", "same text", "don't WON'T 12345 --- ***", "word " * 30_000, "  x", "▁ mark ▁▁",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 7 % 11 - 3, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (5, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x")).withColumn("start", F.lit(0)).withColumn("slice", F.lit(1))


def test_token_files_equal_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(BYTES)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, at = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        expected.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = [tuple(r) for r in token_files.token_digest(docs, BYTES, 2).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert token_files.token_digest(docs.limit(0), BYTES, 2).count() == 0


def test_token_files_decode_to_the_texts(spark, docs):
    root = scratch_path(spark, "token-test")
    manifest = token_files.write_tokens(docs, BYTES, root, 2)
    texts = sorted(((r.doc_id, r.text) for r in token_files.decode_tokens(manifest, root, BYTES).collect()), key=str)
    assert texts == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert {r.width for r in manifest.collect()} == {2}


def test_chunked_encoding_equals_whole_texts():
    tokenizer, rnd = Tokenizer.from_file(BYTES), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "日", "'s", "'", "1", ".", " ", "\x1c", "<|endoftext|>", "<|", "\x00"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    found = ByteLevelEncoder(BYTES, 2).encode(texts)
    for text, ids, e in zip(texts, found, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == e.ids, repr(text)


def test_runs_of_white_space_and_a_full_memo(monkeypatch):
    bits = ["a", "the", "don't", "'s", "12", "é", "中文", "…", "!??", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\x85", "\x1c", "\x0b", "😀", "Hello"]
    rnd, encoder = random.Random(5), ByteLevelEncoder(BYTES, 2)
    monkeypatch.setattr("itembank.llm.tokenizer_files.MEMO_BYTES", 2000)
    for _ in range(300):
        texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(5)]
        expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == expected
    assert encoder.memo.state["size"] < 20_000


def test_slices_are_bounded_in_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(7)), "text": ["x" * n for n in (0, 30, 50, 500, 10, 10, 10)]})
    parts = list(slices([batch, batch.slice(0, 0)], rows=2, size=100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= 2 and (p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 600) for p in parts)
    assert sum(p.num_rows for p in slices([batch.slice(2, 4)], size=100)) == 4


def test_counts_equal_the_library(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for r in docs.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, token_counts.token_counts(docs, WORDS).collect()), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


def test_whole_tokens_are_proved():
    tokenizer = Tokenizer.from_file(WORDS)
    whole = token_counts.whole_tokens(tokenizer)
    assert "the" in whole and all(len(tokenizer.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(whole)[::97])


def test_counter_on_random_chunks():
    tokenizer, rnd, counter = Tokenizer.from_file(WORDS), random.Random(5), token_counts.Counter(WORDS)
    parts = ["The", "don't", "é", "é", "́", "1", "12", "...", "_", "<|endoftext|>", " ", "\n", "\t", "\x85", "Σ", "İ", "ﬁ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 10))) for _ in range(3000)]
    assert counter.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def brute_best(model, text):
    best = [0.0] + [None] * len(text)
    known = {t.decode("utf-8", "surrogatepass"): i for i, t in enumerate(model.spelling) if i > 258}
    scores = {n: s for out in model.automaton.out for _, s, n in out}
    for end in range(1, len(text) + 1):
        options = [best[a] + scores[known[text[a:end]]] for a in range(max(0, end - 24), end) if text[a:end] in known and known[text[a:end]] in scores]
        if text[end - 1] not in known:
            options.append(best[end - 1] + model.unknown)
        best[end] = max(options)
    return best[-1]


def test_viterbi_finds_the_best_sum_and_decodes():
    model, rnd = pieces.pieces(PIECES), random.Random(9)
    scores = {n: s for out in model.automaton.out for _, s, n in out}
    parts = ["the", "ing", " of", "a", "b", "q", " ", "  ", "\n", "é", "日", "▁", "😀", "\x00", "zz"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 10)))
        path = model.automaton.best(text, model.unknown)
        assert sum(scores.get(n, model.unknown) for _, n in path) == brute_best(model, text), repr(text)
        assert model.decode(np.frombuffer(model.encode([text])[0], model.kind).tolist()) == text


def test_pieces_round_trip(docs):
    rows = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert all(len(r.ids) == r.n_pieces for r in rows) and pieces.encode_pieces(docs.limit(0), PIECES).count() == 0


def test_edit_report_equals_a_plain_reading(docs):
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for k, (key, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = fingerprints.edited(text, following)
        a, b, c = (fingerprints.sketches([t])[0] for t in (text, changed, following))
        expected.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.shown(a), fingerprints.shown(b), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    found = [tuple(r) for r in fingerprints.edit_report(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert fingerprints.edit_report(docs.limit(0)).count() == 0


def test_fingerprints_do_not_depend_on_the_batch_or_offset():
    rnd = random.Random(11)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(3000))
    alone = fingerprints.sketches([text])[0]
    assert (fingerprints.sketches(["x", text, "aaaa" * 999, text])[3] == alone).all()
    assert fingerprints.likeness(alone, fingerprints.sketches(["some other words " + text])[0]) > 0.9
    assert 0.3 < fingerprints.likeness(alone, fingerprints.sketches([text[: len(text) // 2] + text[:0:-1][: len(text) // 2]])[0]) < 0.7
    other = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(3000))
    assert fingerprints.likeness(alone, fingerprints.sketches([other])[0]) < 0.2
    assert fingerprints.likeness(*fingerprints.sketches(["", ""])) == 1 and fingerprints.likeness(*fingerprints.sketches(["", "a"])) == 0
