"""SentencePiece encoding by an Aho-Corasick automaton that drives a single-pass Viterbi, and decoding."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.llm.common import documents, slices, worker_memo
from itembank.llm.tokenizer_files import Memo

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Automaton:
    """The pieces of a model (with blanks for their space marks) as an Aho-Corasick automaton.

    Each state lists the pieces that end there, longest first: its own and, by the output
    links, those of its suffixes.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.go: list[dict[str, int]] = [{}]
        own: list[tuple[int, float, int] | None] = [None]
        for text, score, number in pieces:
            state = 0
            for ch in text:
                if ch not in self.go[state]:
                    self.go[state][ch] = len(self.go)
                    self.go.append({})
                    own.append(None)
                state = self.go[state][ch]
            own[state] = (len(text), score, number)
        self.fail = [0] * len(self.go)
        self.out: list[tuple[tuple[int, float, int], ...]] = [()] * len(self.go)
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for ch, nxt in self.go[state].items():
                if state:
                    back = self.fail[state]
                    while back and ch not in self.go[back]:
                        back = self.fail[back]
                    self.fail[nxt] = self.go[back].get(ch, 0)
                self.out[nxt] = ((own[nxt],) if own[nxt] else ()) + self.out[self.fail[nxt]]
                todo.append(nxt)

    def best(self, text: str, unknown: float) -> list[tuple[int, int]]:
        """(start, piece) of the segmentation with the highest sum of scores; piece -1 is one unknown character.

        One pass: at each position the outputs of the state relax the best score of a prefix.
        Of equal scores the one with the longest last piece wins.
        """
        go, fail, out = self.go, self.fail, self.out
        scores, steps, state = [0.0], [(0, 0)], 0
        for at, ch in enumerate(text):
            nxt = go[state].get(ch)
            while nxt is None and state:
                state = fail[state]
                nxt = go[state].get(ch)
            state = nxt or 0
            top, step, single = None, None, False
            for size, score, number in out[state]:
                total = scores[at + 1 - size] + score
                if top is None or total > top:
                    top, step = total, (at + 1 - size, number)
                single = size == 1
            if not single:
                total = scores[at] + unknown
                if top is None or total > top:
                    top, step = total, (at, -1)
            scores.append(top)
            steps.append(step)
        path, at = [], len(text)
        while at:
            path.append(steps[at])
            at = steps[at][0]
        return path[::-1]


class Pieces:
    """Encoder and decoder of a SentencePiece model file with byte fallback.

    Scores come from the file, also where it was trained by merges. A text gets a blank in
    front, and blanks stand for space marks; a space mark in a text is a character like others,
    so that decoding gives every text back exactly. Characters of no piece become the pieces of
    their UTF-8 bytes. No piece goes on over a blank or, if none has it, a line feed: texts are
    cut there, and segments seen before are found in a memo.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        texts = {i: model.id_to_piece(i).replace(SPACE_MARK, " ") for i in normal}
        if any(re.search(r"[^ ] |\n", t) for t in texts.values()):
            raise ValueError("a piece goes on over a blank or line feed; its texts cannot be cut there")
        self.automaton = Automaton([(t, model.get_score(i), i) for i, t in texts.items()])
        self.unknown = min(model.get_score(i) for i in normal) - UNKNOWN_PENALTY
        self.bytes = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.spelling = [b""] * size
        for i, t in texts.items():
            self.spelling[i] = t.encode("utf-8", "surrogatepass")
        for b, i in self.bytes.items():
            self.spelling[i] = bytes([b])
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.memo = Memo(f"pieces:{path}", 24 << 20)
        self.runs = re.compile(r" *[^ \n]+|\n| +")

    def _segment(self, text: str) -> bytes:
        ids = []
        for start, piece in self.automaton.best(text, self.unknown):
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.bytes[b] for b in text[start].encode("utf-8", "surrogatepass")]
        return np.array(ids, self.kind).tobytes()

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text
        if "  " in text or "\x00" in text:
            return self.runs.findall(text)
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of self.kind."""
        young = self.memo.young()
        young[""] = b""
        cut = [self._cut(text) for text in texts]
        segments: set[str] = set()
        for parts in cut:
            segments.update(parts)
        rest = self.memo.missing(segments)
        self.memo.add(rest, [self._segment(segment) for segment in rest])
        of = young.__getitem__
        return [b"".join(map(of, parts)) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids without a spelling (unknown, begin, end) add nothing."""
        return b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def pieces(path: str) -> Pieces:
    memo = worker_memo("pieces")
    if path not in memo:
        memo[path] = Pieces(path)
    return memo[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces and ids of every row.

    Null and empty texts have no ids; repeated rows and null ids are encoded like others.
    Nothing is shuffled, and a batch is bounded in bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in slices(batches):
            rows = model.encode(batch.column("text").to_pylist())
            values = np.frombuffer(b"".join(rows), model.kind).astype(np.int32)
            sizes = np.array([len(r) for r in rows], np.int64) // np.dtype(model.kind).itemsize
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_pieces": pa.array(sizes), "ids": pa.ListArray.from_arrays(offsets, values),
            })

    return documents(docs).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>")


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids in a column of that name; null ids give a null text."""

    @F.pandas_udf("string")
    def spell(column):
        model = pieces(model_path)
        return column.map(lambda x: None if x is None else model.decode(x.tolist()))

    return rows.withColumn(text, spell(F.col(ids)))


def piece_report(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids per document, and the digest of the text that they decode to."""
    decoded = decode_pieces(encode_pieces(docs, model_path), model_path)
    return decoded.select("doc_id", "n_pieces", "ids", F.sha2("text", 256).alias("decoded_sha256"))
