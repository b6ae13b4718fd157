"""One deterministic automaton for many regular expressions, as transition arrays.

Rules are compiled to one nondeterministic automaton, made deterministic by subset construction,
minimised by partition refinement, and run over bytes for a whole batch of texts at once: texts are
cut behind bytes that lead back to the start from every state, and all parts advance together, a
byte each step.  The pass tells which rules end somewhere in which part; spans are then read off
with the rule's own expression in the parts that have one.
"""

from __future__ import annotations

import re
from re import _constants as sre, _parser

import numpy as np


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []  # moves without a byte
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, items, start: int, fold: bool) -> int:
        """Adds parsed items behind ``start``; returns the last state."""
        for op, arg in items:
            start = self._one(op, arg, start, fold)
        return start

    def _one(self, op, arg, start: int, fold: bool) -> int:
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                inner = self.state()
                self.empty[start].append(inner)
                self.empty[self.add(branch, inner, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, items = arg
            for _ in range(low):
                start = self.add(items, start, fold)
            if high is sre.MAXREPEAT:
                loop = self.state()
                self.empty[start].append(loop)
                self.empty[self.add(items, loop, fold)].append(loop)
                end = self.state()
                self.empty[loop].append(end)
                return end
            end = self.state()
            self.empty[start].append(end)
            for _ in range(high - low):
                start = self.add(items, start, fold)
                self.empty[start].append(end)
            return end
        chars = self._chars(op, arg)
        if fold:
            chars |= {b ^ 32 for b in chars if chr(b).isalpha() and b < 128}
        end = self.state()
        assert self.moves[start] is None  # one move per state; empty moves may stand beside it
        self.moves[start] = (frozenset(chars), end)
        return end

    @staticmethod
    def _chars(op, arg) -> set[int]:
        if op is sre.LITERAL:
            return {arg}
        if op is sre.NOT_LITERAL:
            return set(range(256)) - {arg}
        if op is not sre.IN:
            raise ValueError(f"not supported in a rule: {op}")
        chars, negated = set(), False
        for kind, value in arg:
            if kind is sre.NEGATE:
                negated = True
            elif kind is sre.LITERAL:
                chars.add(value)
            elif kind is sre.RANGE:
                chars |= set(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {kind}")
        return set(range(256)) - chars if negated else chars


def _shortest(items: list) -> list:
    """The items with a repeat at their end cut to its least count: whether a rule ends somewhere does
    not depend on how far it could go on, and the automaton need not remember that it is inside."""
    op, arg = items[-1]
    if op is sre.MAX_REPEAT and arg[0]:
        items = [*items[:-1], (op, (arg[0], arg[0], arg[2]))]
    elif op is sre.SUBPATTERN:
        items = [*items[:-1], (op, (*arg[:3], _shortest(list(arg[3]))))]
    return items


class Automaton:
    """``step[state * classes + class_of[byte]]`` and ``accepts[state]``, a bit per rule."""

    def __init__(self, rules: list[bytes]):
        if len(rules) > 63:
            raise ValueError("at most 63 rules in one automaton")
        nfa = _Nfa()
        root, ends = nfa.state(), {}
        for bit, rule in enumerate(rules):
            first = nfa.state()
            nfa.empty[root].append(first)
            parsed = _parser.parse(rule)
            ends[nfa.add(_shortest(list(parsed)), first, bool(parsed.state.flags & re.I))] = bit
        closure: dict[int, frozenset] = {}

        def close(state: int) -> frozenset:
            if state not in closure:
                seen, todo = {state}, [state]
                while todo:
                    for x in nfa.empty[todo.pop()]:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                closure[state] = frozenset(seen)
            return closure[state]

        sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
        marks = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {mark: i for i, mark in enumerate(dict.fromkeys(marks))}
        self.class_of = np.array([kinds[mark] for mark in marks], np.int64)
        samples = [marks.index(mark) for mark in kinds]
        begin = close(root)
        found, rows, todo = {begin: 0}, [], [begin]
        for states in todo:  # grows while it is read
            row = []
            for byte in samples:
                target = begin.union(*[close(m[1]) for s in states if (m := nfa.moves[s]) and byte in m[0]])
                if target not in found:
                    found[target] = len(found)
                    todo.append(target)
                row.append(found[target])
            rows.append(row)
        accepts = np.array([sum(1 << b for s, b in ends.items() if s in states) for states in todo], np.int64)
        self._minimise(np.array(rows, np.int64), accepts)

    def _minimise(self, step: np.ndarray, accepts: np.ndarray) -> None:
        """Moore's refinement: states stay together while their classes and their targets' agree."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, first = np.unique(block, return_index=True)
        self.start = int(block[0])
        self.classes = step.shape[1]
        self.table = block[step[first]]
        self.step = (self.table.ravel() * self.classes).astype(np.int32)
        self.accepts = accepts[first]
        self.accepts_at = np.zeros(len(first) * self.classes, np.int64)
        self.accepts_at[:: self.classes] = self.accepts
        #: Bytes that lead to the start from every state: no match can hold one.
        self.resets = (self.table == self.start).all(axis=0)[self.class_of]

    def cut(self, data: np.ndarray, offsets: np.ndarray, size: int = 512) -> np.ndarray:
        """Starts of parts: each row's, and about every ``size`` bytes one behind a reset byte."""
        rows = offsets[:-1][np.diff(offsets) > 0]
        resets = np.flatnonzero(self.resets[data]) + 1
        if len(resets):
            resets = resets[np.unique(np.searchsorted(resets, np.arange(size, len(data) + 1, size))).clip(max=len(resets) - 1)]
        starts = np.union1d(rows, resets)
        return starts[starts < len(data)]

    def scan(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A bit mask for each part of the rules that end somewhere in it, in one pass over the bytes."""
        sizes = np.diff(np.append(starts, len(data)))
        order = np.argsort(-sizes, kind="stable")
        at, ends = starts[order].copy(), -sizes[order]
        kinds = self.class_of.astype(np.int16)[data]
        state = np.full(len(starts), self.start * self.classes, np.int32)
        seen = np.zeros(len(starts), np.int64)
        step, accepts = self.step, self.accepts_at
        n = len(starts)
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(ends[:n], -t, side="left"))  # parts longer than t
            now = step[state[:n] + kinds[at[:n] + t]]
            state[:n] = now
            seen[:n] |= accepts[now]
        masks = np.empty_like(seen)
        masks[order] = seen
        return masks
