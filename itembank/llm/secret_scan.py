"""Secret scans: every rule in one automaton, one pass over the bytes of a text."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.llm.automata import Dfa, compile_rules
from itembank.llm.common import documents, slices


@dataclass(frozen=True)
class Rule:
    """kind; pattern, also readable by Python's re; least length of the match, or of what follows its head `value`.

    opening, if given, is a shorter pattern that matches from a byte exactly where pattern does.
    """

    kind: str
    pattern: str
    least: int = 1
    value: str = ""
    opening: str = ""


#: A PEM key: its first line, headers of an encrypted one, and the body with its last line. Line breaks may be escaped, and lines
#: quoted or commented. Where the last line is missing, the key ends with the last byte that can be of a body.
_PEM_OPENING = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_PEM_HEADER = r"[A-Za-z]+(?:-[A-Za-z]+)*:[A-Za-z0-9,/.\x20]*(?:-[A-Za-z0-9,/.\x20]+)*(?:[\r\n]|\\[nr])+"
_PEM_LINES = r"[A-Za-z0-9+/=\s\\\"',;>#*|]*"
_PEM_KEY = (
    _PEM_OPENING + r"(?:\s|\\[nr])*(?:" + _PEM_HEADER + ")*"
    + "(?:" + _PEM_LINES + r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:[A-Za-z0-9+/=\s\\]*[A-Za-z0-9+/=])?)"
)

#: The first three rules are the contract's; the others are public key formats.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 12,
         r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("private_key", _PEM_KEY, opening=_PEM_OPENING),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._~!$&*+,;=%-]+@[A-Za-z0-9.-]+"),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """Leftmost, longest, non-overlapping matches of each rule.

    The combined automaton reads a text backwards, so its accepting states name the rules that
    begin at a byte. From such a start the rule's own automaton runs forward to the longest end.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.starts: Dfa = compile_rules([r.opening or r.pattern for r in rules], reverse=True, anywhere=True)
        self.ends = [compile_rules([r.pattern]) for r in rules]
        self.values = [re.compile(r.value.encode()) if r.value else None for r in rules]

    def _end(self, rule: int, data: bytes, start: int) -> int:
        dfa, end = self.ends[rule], start
        row = dfa.rows[0]
        for at in range(start, len(data)):
            row = row[data[at]]
            if row is dfa.dead:
                break
            if row[256]:
                end = at + 1
        return end

    def _holds(self, rule: int, match: bytes) -> bool:
        head = self.values[rule]
        return len(match) - (head.match(match).end() if head else 0) >= self.rules[rule].least

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and then rule."""
        row, found = self.starts.rows[0], []
        at = len(data)
        for byte in data[::-1]:
            at -= 1
            row = row[byte]
            if row[256]:
                found.append((at, row[256]))
        free, spans = [0] * len(self.rules), []
        for start, rules in reversed(found):
            for rule in rules:
                if start >= free[rule]:
                    end = free[rule] = self._end(rule, data, start)
                    if self._holds(rule, data[start:end]):
                        spans.append((start, end, rule))
        return spans

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """The same in code points."""
        data = text.encode("utf-8", "surrogatepass")
        spans = self.scan(data)
        if not spans or len(data) == len(text):
            return spans
        marks = sorted({x for s in spans for x in s[:2]})
        at, last, points = 0, 0, {}
        for mark in marks:
            at += len(data[last:mark].decode("utf-8", "surrogatepass"))
            last = points[mark] = mark
            points[mark] = at
        return [(points[s], points[e], r) for s, e, r in spans]


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once on the driver; tasks get its arrays."""
    return Scanner(rules)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, last = [], 0
    for start, end, _ in spans:
        if end <= last:
            continue
        if start >= last:
            out += [text[last:start], mask]
        last = end
    return "".join([*out, text[last:]])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end in code points; by start, then rule order) of every row.

    Null and empty texts have no spans; repeated rows and null ids are scanned like others.
    Nothing is shuffled, and a batch is bounded in bytes.
    """

    scan = scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            rows = [
                [{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in scan.spans(text)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, kind)})

    return documents(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(text: Column, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> Column:
    """The text with each secret, or chain of overlapping ones, replaced by the mask; null stays null."""

    scan = scanner(rules)

    @F.pandas_udf("string")
    def cover(texts):
        return texts.map(lambda t: t if t is None else masked(t, scan.spans(t), mask))

    return cover(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests per document; the base kinds apart from the spans of all rules."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    count = [_count(spans, kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return secret_spans(docs, rules).select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
