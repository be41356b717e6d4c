"""Byte automata: small regular expressions to minimal transition arrays by subset construction."""

from __future__ import annotations

import numpy as np

_ALL = frozenset(range(256))
_CLASSES = {
    "d": frozenset(b"0123456789"),
    "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
    "s": frozenset(b" \t\n\r\x0b\x0c"),
}
_CONTROL = {"n": 10, "t": 9, "r": 13}


class _Parser:
    """Trees of ('set', bytes), ('cat', parts), ('or', parts) and ('rep', part, low, high or None)."""

    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def one(self, code: int):
        codes = {code}
        if self.fold and chr(code).isalpha():
            codes = {ord(chr(code).lower()), ord(chr(code).upper())}
        return frozenset(codes)

    def escape(self) -> frozenset[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        return _CLASSES.get(c) or self.one(_CONTROL.get(c, ord(c)))

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escape() if c == "\\" else self.one(ord(c))
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                for code in range(min(low), ord(self.take()) + 1):
                    found |= self.one(code)
            else:
                found |= low
        self.take()
        return _ALL - found if negated else frozenset(found)

    def atom(self):
        c = self.take()
        if c == "(":
            outer = self.fold
            if self.peek() == "?":
                self.take()
                if self.peek() == "i":
                    self.take()
                    self.fold = True
                assert self.take() == ":"
            tree = self.either()
            self.take()
            self.fold = outer
            return tree
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", self.escape())
        return ("set", _ALL - {10} if c == "." else self.one(ord(c)))

    def repeated(self):
        tree = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                tree = ("rep", tree, int(low), (int(high) if high else None) if comma else int(low))
            else:
                tree = ("rep", tree, 1 if c == "+" else 0, 1 if c == "?" else None)
        return tree

    def either(self):
        options = [[]]
        while (c := self.peek()) and c != ")":
            if c == "|":
                self.take()
                options.append([])
            else:
                options[-1].append(self.repeated())
        trees = [("cat", parts) for parts in options]
        return trees[0] if len(trees) == 1 else ("or", trees)


def parse(pattern: str):
    """The tree of a pattern."""
    return _Parser(pattern).either()


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """The end state of tree laid from start; with reverse, of its mirror image."""
        if tree[0] == "set":
            end = self.state()
            step = self.state()
            self.empty[start].append(step)
            self.moves[step] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for part in reversed(tree[1]) if reverse else tree[1]:
                start = self.add(part, start, reverse)
            return start
        end = self.state()
        if tree[0] == "or":
            for part in tree[1]:
                self.empty[self.add(part, start, reverse)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start, reverse)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop, reverse)].append(loop)
            self.empty[loop].append(end)
            return end
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start, reverse)
            self.empty[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


class Dfa:
    """moves[state, byte] is the next state, start state 0; accepts[state] the numbers of the rules that match there."""

    def __init__(self, moves: np.ndarray, accepts: list[tuple[int, ...]]):
        self.moves, self.accepts = moves, accepts
        rows: list[list] = [[None] * 257 for _ in accepts]
        for state, row in enumerate(rows):
            row[:256] = [rows[t] for t in moves[state]]
            row[256] = accepts[state]
        self.rows = rows
        #: a state that nothing leaves and that accepts nothing, if there is one
        dead = [s for s in range(len(accepts)) if not accepts[s] and (moves[s] == s).all()]
        self.dead = rows[dead[0]] if dead else None

    def __reduce__(self):
        # rows refer to each other in cycles; the arrays are small and say the same
        return Dfa, (self.moves.astype(np.int32), self.accepts)


def compile_rules(patterns: list[str], reverse: bool = False, anywhere: bool = False) -> Dfa:
    """One minimal automaton for all patterns; anywhere lets a match begin at each byte."""
    nfa = _Nfa()
    start, finals = nfa.state(), {}
    for number, pattern in enumerate(patterns):
        own = nfa.state()
        nfa.empty[start].append(own)
        finals[nfa.add(_Parser(pattern).either(), own, reverse)] = number
    classes = np.zeros(256, np.int64)
    for codes in {m[0] for m in nfa.moves if m}:
        member = np.isin(np.arange(256), list(codes))
        classes = np.unique(classes * 2 + member, return_inverse=True)[1]
    width = int(classes.max()) + 1
    taken = [m and (sorted({int(classes[c]) for c in m[0]}), m[1]) for m in nfa.moves]

    first = nfa.closure({start})
    numbers, order, table, closures = {first: 0}, [first], [], {}
    for states in order:  # grows while it is walked
        targets: list[set[int]] = [{start} if anywhere else set() for _ in range(width)]
        for state in states:
            if move := taken[state]:
                for k in move[0]:
                    targets[k].add(move[1])
        row = []
        for target in map(frozenset, targets):
            if target not in closures:
                closures[target] = nfa.closure(set(target))
            nxt = closures[target]
            if nxt not in numbers:
                numbers[nxt] = len(order)
                order.append(nxt)
            row.append(numbers[nxt])
        table.append(row)
    moves = np.array(table, np.int64)
    accepts = [tuple(sorted(finals[s] for s in states if s in finals)) for states in order]

    # states are alike until their accepts or the groups they move to differ
    kinds = {a: k for k, a in enumerate(dict.fromkeys(accepts))}
    group = np.array([kinds[a] for a in accepts])
    while True:
        signs = np.column_stack([group, group[moves]])
        finer = np.unique(signs, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # number the groups by their first state, so that state 0 stays the start
    firsts = np.array([np.flatnonzero(group == g)[0] for g in range(group.max() + 1)])
    rank = np.empty_like(firsts)
    rank[np.argsort(firsts)] = np.arange(len(firsts))
    group, heads = rank[group], np.sort(firsts)
    return Dfa(group[moves[heads]][:, classes], [accepts[h] for h in heads])
