"""Regular expressions over bytes compiled to one deterministic automaton: subset construction, minimisation, transition arrays.

Supported: literals, escapes (\\xHH, \\n, \\t, \\. and the like), classes with ranges, groups, ``|`` and ``? * + {n} {n,} {n,m}``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

Node = tuple


class _Parser:
    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def alternatives(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self) -> Node:
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(self.atom()))
        return ("seq", items)

    def atom(self) -> Node:
        if self.peek() == "(":
            self.take()
            inner = self.alternatives()
            self.take()
            return inner
        if self.peek() == "[":
            self.take()
            found: set[int] = set()
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.take()
                    high = self.byte()
                found |= set(range(low, high + 1))
            self.take()
            return ("set", frozenset(found))
        return ("set", frozenset([self.byte()]))

    def repeated(self, node: Node) -> Node:
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.s.index("}", self.i)
                a, comma, b = self.s[self.i : end].partition(",")
                low, high, self.i = int(a), (int(b) if b else None) if comma else int(a), end + 1
            node = ("rep", node, low, high)
        return node


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.steps) - 1

    def add(self, node: Node, a: int) -> int:
        """Builds the node from state a on; gives its end state."""
        if node[0] == "set":
            b = self.state()
            mid = self.state()
            self.empty[a].append(mid)
            self.steps[mid] = (node[1], b)
            return b
        if node[0] == "seq":
            for x in node[1]:
                a = self.add(x, a)
            return a
        if node[0] == "or":
            end = self.state()
            for x in node[1]:
                head = self.state()
                self.empty[a].append(head)
                self.empty[self.add(x, head)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            a = self.add(inner, a)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[a] += [loop]
            self.empty[loop].append(end)
            self.empty[self.add(inner, loop)].append(loop)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[a].append(end)
            a = self.add(inner, a)
        self.empty[a].append(end)
        return end

    def closure(self, states: Sequence[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for b in self.empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``classes[byte]`` is a byte's column, ``table[state, column]`` the next state, ``accepts[state]`` a bit for each rule.

    State 0 is the start. Accepting states are numbered last, from ``first_accept`` on. ``dead`` is a state that
    nothing leaves and that accepts nothing, or -1.
    """

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    first_accept: int
    dead: int


def either_case(word: str) -> str:
    """A pattern for a word's ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def backwards(node: Node) -> Node:
    """What matches a node's texts from their last byte to their first."""
    kind, inner = node[0], node[1]
    if kind == "seq":
        return (kind, [backwards(x) for x in reversed(inner)])
    if kind == "or":
        return (kind, [backwards(x) for x in inner])
    return (kind, backwards(inner), *node[2:]) if kind == "rep" else node


def compiled(patterns: Sequence[str], search: bool, backward: bool = False) -> Automaton:
    """All patterns in one automaton. search: a match may begin anywhere; else only at the first byte.

    backward: for texts read from the end, so that a state accepts where a match starts.
    """
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for k, p in enumerate(patterns):
        head = nfa.state()
        nfa.empty[root].append(head)
        node = _Parser(p).alternatives()
        ends[nfa.add(backwards(node) if backward else node, head)] = 1 << k
    signature = [tuple(b in s[0] for s in nfa.steps if s) for b in range(256)]
    kinds = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    classes = np.array([kinds[x] for x in signature], np.uint8)
    sample = [int(np.flatnonzero(classes == i)[0]) for i in range(len(kinds))]

    start = nfa.closure([root])
    index, todo, table = {start: 0}, [start], []
    while todo:
        here, row = todo.pop(0), []
        for b in sample:
            to = [nfa.steps[s][1] for s in here if nfa.steps[s] and b in nfa.steps[s][0]]
            there = nfa.closure([*to, root] if search else to)
            if there not in index:
                index[there] = len(index)
                todo.append(there)
            row.append(index[there])
        table.append(row)
    full = np.array(table)
    accepts = np.array([sum(ends.get(s, 0) for s in subset) for subset in index], np.int64)

    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # refine until no two states of a block differ in where a byte leads
        finer = np.unique(np.column_stack([block, block[full]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = block.max() + 1
    one = np.array([np.flatnonzero(block == i)[0] for i in range(n)])
    order = sorted(range(n), key=lambda i: (accepts[one[i]] > 0, i != block[0], i))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    small = rank[block[full[one[order]]]]
    marks = accepts[one[order]]
    dead = [i for i in range(n) if not marks[i] and (small[i] == i).all()]
    return Automaton(classes, small.astype(np.int32), marks, int((marks == 0).sum()), dead[0] if dead and not search else -1)
