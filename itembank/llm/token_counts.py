"""Token counts by a whole-token shortcut: most pre-tokens are one token and need no merges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import documents, slices, worker_memo
from itembank.llm.tokenizer_files import Memo, load

#: Fixed value: the word pattern of the tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token: their own.

    Each string that ends a word is encoded by the library; it counts only when the answer
    is that single id. Byte-level spellings outside ASCII are left to the library.
    """
    vocab = {t.removesuffix(WORD_END): i for t, i in tokenizer.get_vocab().items() if t.endswith(WORD_END) and t.isascii()}
    words = sorted(vocab)
    found = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, found, strict=True) if e.ids == [vocab[w]])


class Counter:
    """Counts of whole texts, chunk by chunk between blanks.

    The pattern drops white space, so a blank or line feed always ends a pre-token. A chunk
    of ASCII characters whose pre-tokens are all proved whole tokens counts one for each; other
    chunks are merged by the library. Counts of chunks are kept in a
    bounded memo per worker.
    """

    def __init__(self, path: str):
        self.tokenizer, self.memo = load(path), Memo(f"counts:{path}")
        proofs = worker_memo("whole")
        if path not in proofs:
            proofs[path] = whole_tokens(self.tokenizer)
        self.whole, self.words = proofs[path], regex.compile(WORD_PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, chunks: set[str]) -> None:
        rest, proved = [], []
        for chunk in self.memo.missing(chunks):
            if chunk.isascii() and not any(s in chunk for s in self.special):
                words = self.words(chunk.lower())
                if self.whole.issuperset(words):
                    proved.append((chunk, len(words)))
                    continue
            rest.append(chunk)
        self.memo.add([c for c, _ in proved], [n for _, n in proved])
        for start in range(0, len(rest), 10_000):
            part = rest[start : start + 10_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.memo.add(part, [len(e.ids) for e in found])

    def count(self, texts: list[str]) -> list[int]:
        young = self.memo.young()
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        chunks: set[str] = set()
        for parts in cut:
            chunks.update(parts)
        self._learn(chunks)
        of = young.__getitem__
        return [sum(map(of, parts)) for parts in cut]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    Null and empty texts count 0 tokens; repeated rows and null ids are counted like others.
    Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in slices(batches):
            counts = counter.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64()),
            })

    rows = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
