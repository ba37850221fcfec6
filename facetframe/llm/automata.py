"""Deterministic automata for byte patterns: parse, subset construction, minimisation.

The patterns use literals, escapes (``\\xHH``), character classes, groups, ``|`` and the
quantifiers ``? * + {m} {m,} {m,n}``. Everything is on bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ANY = frozenset(range(256))


class Table(NamedTuple):
    """A minimised automaton: byte classes, transitions (state by class), accept masks (bit i: pattern i). Start is 0."""

    classes: bytes
    moves: np.ndarray
    accepts: np.ndarray

    def rows(self) -> list[list]:
        """States as lists that hold the next state per class and, last, the accept mask: one index a byte."""
        rows: list[list] = [[] for _ in self.accepts]
        for row, targets, mask in zip(rows, self.moves.tolist(), self.accepts.tolist()):
            row.extend(rows[t] for t in targets)
            row.append(mask)
        return rows


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    """The syntax tree: ("set", bytes) | ("cat", parts) | ("alt", parts) | ("rep", part, least, most or None)."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def cased(chars: set[int]) -> frozenset[int]:
        if ignore_case:
            letters = {c for c in chars if 65 <= c <= 90 or 97 <= c <= 122}
            chars = chars | {c ^ 32 for c in letters}
        return frozenset(chars)

    def escape() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return {"n": 10, "t": 9, "r": 13}.get(pattern[at - 1], ord(pattern[at - 1]))

    def one() -> int:
        nonlocal at
        if peek() == "\\":
            return escape()
        at += 1
        return ord(pattern[at - 1])

    def bracket() -> frozenset[int]:
        nonlocal at
        at += 1
        negated = peek() == "^"
        at += negated
        chars: set[int] = set()
        while peek() != "]":
            low = one()
            if peek() == "-" and pattern[at + 1] != "]":
                at += 1
                chars |= set(range(low, one() + 1))
            else:
                chars.add(low)
        at += 1
        return ANY - cased(chars) if negated else cased(chars)

    def item() -> tuple:
        nonlocal at
        c = peek()
        if c == "(":
            at += 1
            tree = alternatives()
            at += 1
            return tree
        if c == "[":
            return ("set", bracket())
        if c == ".":
            at += 1
            return ("set", ANY - {10})
        return ("set", cased({one()}))

    def quantified() -> tuple:
        nonlocal at
        tree = item()
        while peek() and peek() in "?*+{":
            if peek() == "{":
                end = pattern.index("}", at)
                least, comma, most = pattern[at + 1 : end].partition(",")
                tree = ("rep", tree, int(least), int(most) if most else None if comma else int(least))
                at = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[peek()]
                tree = ("rep", tree, least, most)
                at += 1
        return tree

    def sequence() -> tuple:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(quantified())
        return ("cat", parts)

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while peek() == "|":
            at += 1
            parts.append(sequence())
        return ("alt", parts)

    tree = alternatives()
    if at < len(pattern):
        raise ValueError(f"cannot read the pattern at {at}: {pattern}")
    return tree


def reverse(tree: tuple) -> tuple:
    """The tree of the patterns read backwards."""
    if tree[0] == "cat":
        return ("cat", [reverse(t) for t in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(t) for t in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Net:
    """A nondeterministic automaton with empty moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Append ``tree`` after ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.move[start] = (tree[1], end)
            link = self.state()
            self.empty[end].append(link)
            return link
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            back = self.state()
            self.empty[loop] += [back, end]
            self.empty[self.add(part, back)].append(loop)
            return end
        self.empty[start].append(end)
        for _ in range(most - least):
            first = self.state()
            self.empty[start].append(first)
            start = self.add(part, first)
            self.empty[start].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.move[s] or s in self.ends)

    ends: dict[int, int] = {}


def compile_patterns(trees: list[tuple], search: bool = False) -> Table:
    """One automaton for all patterns. ``search``: a match may begin at any byte."""
    net = _Net()
    start, net.ends = net.state(), {}
    for i, tree in enumerate(trees):
        first = net.state()
        net.empty[start].append(first)
        net.ends[net.add(tree, first)] = 1 << i
    sets = list({m[0] for m in net.move if m})
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [classes.index(k) for k in range(len(kinds))]

    begin = net.closure({start})
    numbers, todo, moves = {begin: 0}, [begin], []
    for states in todo:  # grows while it is read
        row = []
        for b in sample:
            reached = {net.move[s][1] for s in states if net.move[s] and b in net.move[s][0]}
            target = net.closure(reached) | begin if search else net.closure(reached)
            if target not in numbers:
                numbers[target] = len(todo)
                todo.append(target)
            row.append(numbers[target])
        moves.append(row)
    table, accepts = np.array(moves, np.int64).reshape(len(todo), -1), np.zeros(len(todo), np.int64)
    for states, n in numbers.items():
        for s in states:
            accepts[n] |= net.ends.get(s, 0)
    return _minimised(classes, table, accepts)


def _minimised(classes: bytes, moves: np.ndarray, accepts: np.ndarray) -> Table:
    """Merge equivalent states: split by accept masks, then by the blocks that moves lead to, until stable."""
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.column_stack([block, block[moves]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = list(dict.fromkeys(block.tolist()))  # the start's block comes first
    number = {b: i for i, b in enumerate(order)}
    block = np.array([number[b] for b in block.tolist()])
    first = [int(np.flatnonzero(block == i)[0]) for i in range(len(order))]
    return Table(classes, block[moves[first]].astype(np.int32), accepts[first])
