"""One deterministic automaton from many token patterns, made state by state as texts ask for it.

Patterns are read with the standard library's own parser; their union becomes a nondeterministic automaton over 130
classes of characters (ASCII, other, other space), and sets of its states become states of the deterministic one the first
time a text reaches them. A state holds its transitions in one list, so a character costs one look-up.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

OTHER, OTHER_SPACE, CLASSES = 128, 129, 130
_ALL = frozenset(range(CLASSES))
_SPACE = frozenset((9, 10, 11, 12, 13, 28, 29, 30, 31, 32, OTHER_SPACE))
_DIGIT = frozenset(range(48, 58))
_WORD = frozenset((*range(48, 58), *range(65, 91), *range(97, 123), 95))


def classify(c: str) -> int:
    o = ord(c)
    return o if o < 128 else OTHER_SPACE if c.isspace() else OTHER


def _members(items: list) -> frozenset[int]:
    out, negated = set(), False
    for op, arg in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        elif op is C.CATEGORY:
            out |= {C.CATEGORY_SPACE: _SPACE, C.CATEGORY_DIGIT: _DIGIT, C.CATEGORY_WORD: _WORD}[arg]
        else:
            raise ValueError(f"not in a class: {op}")
    return _ALL - out if negated else frozenset(out)


class Automaton:
    """``patterns`` is a list of (name, regular expression) without look-around and back references; matches of those
    named in ``whole`` end only where no letter, digit or underscore follows."""

    def __init__(self, patterns: list[tuple[str, str]], whole: tuple[str, ...] = ()):
        self._edges: list[list[tuple[frozenset[int], int]]] = []
        self._free: list[list[int]] = []
        self._names: dict[int, int] = {}
        start = self._node()
        self.names = [n for n, _ in patterns]
        self.whole = [n in whole for n in self.names]
        for k, (_, text) in enumerate(patterns):
            at = self._node()
            self._free[start].append(at)
            self._names[self._sequence(_parser.parse(text), at)] = k
        self._known: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self.steps: list[list[int]] = []  # state -> class -> state, -1: none, -2: not made yet
        self.accepts: list[tuple[int, ...]] = []
        self._state(self._closure({start}))

    def _node(self) -> int:
        self._edges.append([])
        self._free.append([])
        return len(self._edges) - 1

    def _sequence(self, items, at: int) -> int:
        for op, arg in items:
            at = self._one(op, arg, at)
        return at

    def _one(self, op, arg, at: int) -> int:
        if op is C.LITERAL or op is C.NOT_LITERAL or op is C.IN:
            chars = _members(arg) if op is C.IN else frozenset((arg,)) if op is C.LITERAL else _ALL - {arg}
            to = self._node()
            self._edges[at].append((chars, to))
            return to
        if op is C.SUBPATTERN:
            return self._sequence(arg[3], at)
        if op is C.BRANCH:
            end = self._node()
            for option in arg[1]:
                first = self._node()
                self._free[at].append(first)
                self._free[self._sequence(option, first)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                at = self._sequence(inner, at)
            if high is C.MAXREPEAT:
                loop, end = self._node(), self._node()
                self._free[at].append(loop)
                self._free[self._sequence(inner, loop)].append(loop)
                self._free[loop].append(end)
                return end
            end = self._node()
            for _ in range(high - low):
                self._free[at].append(end)
                at = self._sequence(inner, at)
            self._free[at].append(end)
            return end
        raise ValueError(f"not in a pattern: {op}")

    def _closure(self, nodes: set[int]) -> frozenset[int]:
        todo = list(nodes)
        while todo:
            for n in self._free[todo.pop()]:
                if n not in nodes:
                    nodes.add(n)
                    todo.append(n)
        return frozenset(nodes)

    def _state(self, nodes: frozenset[int]) -> int:
        got = self._known.get(nodes)
        if got is None:
            got = self._known[nodes] = len(self._sets)
            self._sets.append(nodes)
            self.steps.append([-2] * CLASSES)
            self.accepts.append(tuple(sorted(self._names[n] for n in nodes if n in self._names)))
        return got

    def step(self, state: int, c: int) -> int:
        to = self.steps[state][c]
        if to == -2:
            nodes = {n for s in self._sets[state] for chars, n in self._edges[s] if c in chars}
            to = self.steps[state][c] = self._state(self._closure(nodes)) if nodes else -1
        return to


class Runner:
    """Runs of the automaton from given places of one text, in ascending order, in time linear in the text.

    A run that comes into a state where an earlier one that found nothing more has been at the same place stops there.
    """

    MARK = 32  # places between the remembered ones

    def __init__(self, machine: Automaton, text: str):
        self.machine, self.text, self.been = machine, text, {}

    def run(self, at: int) -> dict[int, int]:
        """pattern -> end of its longest match from ``at``."""
        m, text, n = self.machine, self.text, len(self.text)
        steps, accepts, found, state, i, mark = m.steps, m.accepts, {}, 0, at, self.MARK
        passed = []
        while i < n:
            c = ord(text[i])
            if c > 127:
                c = classify(text[i])
            to = steps[state][c]
            if to == -2:
                to = m.step(state, c)
            if to < 0:
                break
            state = to
            i += 1
            for k in accepts[state]:
                if not m.whole[k] or i == n or not ((d := text[i]).isascii() and (d.isalnum() or d == "_")):
                    found[k] = i
            if not i % mark:
                ends = self.been.get((i, state))
                if ends is not None:
                    found.update(ends)
                    break
                passed.append((i, state))
        for place, s in passed:  # what a later run through the same place and state will find behind it
            self.been[place, s] = {k: e for k, e in found.items() if e > place}
        return found
