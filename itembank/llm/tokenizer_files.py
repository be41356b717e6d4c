"""Encoding with a tokenizers file: whole texts through a memo of their chunks."""

from __future__ import annotations

import os
import re

import numpy as np

from itembank.llm.common import worker_memo

#: Size of a memo's generation, and what an entry takes beside its characters and bytes, about.
MEMO_BYTES, ENTRY_BYTES = 48 << 20, 160


class Memo:
    """What was found for strings, in two generations: when the young one is full it becomes
    the old one, and entries still in use move over again. A generation is bounded in bytes,
    but for what a single slice of texts adds to it."""

    def __init__(self, name: str, size: int | None = None):
        self.state, self.limit = worker_memo(name), size
        self.state.setdefault("young", {})
        self.state.setdefault("old", {})
        self.state.setdefault("size", 0)

    def young(self) -> dict:
        if self.state["size"] > (self.limit or MEMO_BYTES):
            self.state.update(old=self.state["young"], young={}, size=0)
        return self.state["young"]

    def add(self, keys: list[str], values: list) -> None:
        """New entries, bytes or numbers, for the young generation."""
        self.state["young"].update(zip(keys, values, strict=True))
        spelled = sum(map(len, values)) if values and isinstance(values[0], bytes) else 0
        self.state["size"] += ENTRY_BYTES * len(keys) + sum(map(len, keys)) + spelled

    def missing(self, keys: set[str]) -> list[str]:
        """Those of the keys that neither generation has; the others are in the young one afterwards."""
        young, old = self.state["young"], self.state["old"]
        new = keys.difference(young)
        known = [key for key in new if key in old]
        self.add(known, [old[key] for key in known])
        return list(new.difference(known))


def load(path: str):
    """The tokenizer of a file, one per worker process."""
    memo = worker_memo("tokenizers")
    if path not in memo:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        memo[path] = Tokenizer.from_file(path)
    return memo[path]


class ByteLevelEncoder:
    """Ids of whole texts as bytes of fixed-width little-endian integers.

    In the byte-level pattern white space after another character starts a pre-token, so a text
    is cut before each run of white space (or only before blanks and line feeds, where no run
    is longer than one character), and a chunk seen before is found in a memo. Texts that may
    hold an added token go to the library whole. The ids are the same.

    New chunks go to the library in one text where that parts them again: each must start with
    a blank or line feed and end with another character. Tokens of a byte-level vocabulary
    spell bytes, so their lengths tell where the ids of a chunk end.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer, self.kind, self.size = load(path), f"<u{width}", width
        self.memo = Memo(f"ids:{path}:{width}")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.gaps = re.compile(r"\s\s").search
        # four control characters are white space in Python, but not in the library's pattern
        self.runs = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+").findall
        self.spelled = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.spelled[number] = len(token)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def _ids_and_ends(self, part: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, and how many of them each chunk and those before it have."""
        text = "".join(part)
        if joined and not any(s in text for s in self.special):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            places = np.cumsum(self.spelled[ids])
            wanted = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part])
            ends = np.searchsorted(places, wanted) + 1
            if ends[-1] == len(ids) and np.array_equal(places[ends - 1], wanted):
                return ids, ends
        found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))

    def _learn(self, chunks: set[str], young: dict) -> None:
        young[""] = b""
        rest = self.memo.missing(chunks)
        parts_again = [c[0] in "\n " and not c[-1].isspace() for c in rest]
        for joined in (True, False):
            group = [c for c, fits in zip(rest, parts_again, strict=True) if fits is joined]
            for start in range(0, len(group), 10_000):
                part = group[start : start + 10_000]
                found, ends = self._ids_and_ends(part, joined)
                ids, ends = found.astype(self.kind).tobytes(), (ends * self.size).tolist()
                self.memo.add(part, [ids[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)])

    def _cut(self, text: str) -> list[str] | None:
        if "\x00" in text or any(s in text for s in self.special):
            return None
        if self.gaps(text):
            return self.runs(text)
        return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")

    def encode(self, texts: list[str]) -> list[bytes]:
        young = self.memo.young()
        cut = [self._cut(text) for text in texts]
        chunks: set[str] = set()
        for parts in cut:
            chunks.update(parts or ())
        self._learn(chunks, young)
        of = young.__getitem__
        return [
            self._encode([text])[0] if parts is None else b"".join(map(of, parts))
            for text, parts in zip(texts, cut, strict=True)
        ]
