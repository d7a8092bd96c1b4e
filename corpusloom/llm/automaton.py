"""Regular expressions compiled into one deterministic automaton over bytes.

The dialect: literals, escapes of single characters, classes, groups, alternation, and
the quantifiers ? * + {m} {m,n} {m,}. Boundaries (\b) are left out of the automaton, so it
fires wherever the rule without them matches; the rule itself decides then. A long repeat
ends a rule's part of the automaton, as its counters would multiply the states: what is
compiled is each rule's beginning, and repeats may be of any length.

All rules together become one NFA (one loop at the start, so a match may begin anywhere),
subset construction makes it deterministic, partition refinement makes it minimal. The
result is a transition array (states, byte classes) with the accepting states last.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_SETS = {"d": b"0123456789", "s": b" \t\n\r\f\v", "w": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


class _Parser:
    """Recursive descent to ('set', bytes) | ('cat', parts) | ('or', parts) | ('rep', part, least, most)."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.text = pattern[4:] if self.fold else pattern
        self.at = 0

    def parse(self):
        tree = self._either()
        if self.at != len(self.text):
            raise ValueError(f"cannot read {self.text!r} at {self.at}")
        return tree

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _chars(self, chars: bytes) -> tuple:
        return ("set", frozenset(chars) | (frozenset(chars.lower() + chars.upper()) if self.fold else frozenset()))

    def _either(self):
        parts = [self._sequence()]
        while self._peek() == "|":
            self._next()
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            atom = self._atom()
            while self._peek() and self._peek() in "?*+{":
                atom = ("rep", atom, *self._times())
            if atom is not None:
                parts.append(atom)
        return ("cat", parts)

    def _times(self) -> tuple[int, int | None]:
        c = self._next()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.text.index("}", self.at)
        least, comma, most = self.text[self.at : end].partition(",")
        self.at = end + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def _atom(self):
        c = self._next()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            inner = self._either()
            if self._next() != ")":
                raise ValueError("unbalanced group")
            return inner
        if c == "[":
            return self._class()
        if c == "\\":
            e = self._next()
            if e == "b":
                return None
            return self._chars(_SETS[e] if e in _SETS else e.encode())
        if c in ".^$*+?{":
            raise ValueError(f"{c!r} is not in this dialect")
        return self._chars(c.encode())

    def _class(self):
        if self._peek() == "^":
            raise ValueError("negated classes are not in this dialect")
        out = bytearray()
        while (c := self._next()) != "]":
            if c == "\\":
                e = self._next()
                out += _SETS.get(e, e.encode())
            elif self._peek() == "-" and self.text[self.at + 1] != "]":
                self._next()
                out += bytes(range(ord(c), ord(self._next()) + 1))
            else:
                out += c.encode()
        return self._chars(bytes(out))


def longest(tree) -> int | None:
    """Most bytes of a match, None if there is no bound."""
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "rep":
        n = longest(tree[1])
        return None if n is None or tree[3] is None else n * tree[3]
    sizes = [longest(x) for x in tree[1]]
    if None in sizes:
        return None
    return sum(sizes) if kind == "cat" else max(sizes, default=0)


#: A rule fires early, when it has come to a class that must repeat at least LONG times, or may up to WIDE or without limit, and seen REPEATS of them.
LONG, WIDE, REPEATS = 8, 32, 3


def early(tree) -> tuple[tuple, bool]:
    """The tree as far as its first long repeat, and whether it was cut there."""
    kind = tree[0]
    if kind == "rep":
        _, part, least, most = tree
        if part[0] == "set" and (least >= LONG or most is None or most >= WIDE):
            return ("rep", part, min(least, REPEATS), min(least, REPEATS)), True
        if most is None:  # a group without limit: as far as it must go
            return ("cat", [early(part)[0]] if least else []), True
        return tree, False
    if kind == "set":
        return tree, False
    parts, cuts = [], []
    for part in tree[1]:
        part, cut = early(part)
        parts.append(part)
        cuts.append(cut)
        if cut and kind == "cat":
            break
    return (kind, parts), any(cuts)


@dataclass
class _Nfa:
    """Position automaton: moves[s] = (bytes, target); empty[s] = targets without a byte; chain[s] = (run, place) in a repeated class."""

    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    chain: dict[int, tuple[int, int]] = field(default_factory=dict)
    runs: int = 0

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, last: bool) -> int:
        """Build tree from start on; the state at its end. last: nothing follows, so the fewest repeats do."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for k, part in enumerate(tree[1]):
                start = self.add(part, start, last and k == len(tree[1]) - 1)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start, last)].append(end)
            return end
        _, part, least, most = tree
        if part[0] == "set" and (least > 1 and last or most is None or most > least):
            # A thread that is further in such a run can do all that one behind it can, so only the first need live.
            if last and not least:
                return start
            if not least:
                loop = self.state()
                self.empty[start].append(loop)
                self.moves[loop].append((part[1], loop))
                return loop
            self.runs += 1
            for k in range(least):
                start = self.add(part, start, False)
                self.chain[start] = (self.runs, k)
            if not last:
                self.moves[start].append((part[1], start))
            return start
        for _ in range(least):
            start = self.add(part, start, False)
        if last:
            return start
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop, False)].append(loop)
            return loop
        for _ in range(most - least):
            end = self.state()
            self.empty[self.add(part, start, False)].append(end)
            self.empty[start].append(end)
            start = end
        return start


@dataclass
class Automaton:
    """next[state, byte_class[byte]]; states from `accepting` on accept, accepts[state - accepting] are their rules; reach: bytes after which the state depends on nothing earlier."""

    next: np.ndarray
    byte_class: np.ndarray
    accepting: int
    accepts: list[tuple[int, ...]]
    reach: int
    start: int


def _minimal(table: np.ndarray, accept: list[frozenset]) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement: each state's class, and a state of each class."""
    names = {a: k for k, a in enumerate(dict.fromkeys(accept))}
    block = np.array([names[a] for a in accept])
    while True:
        _, first, fresh = np.unique(np.column_stack([block, block[table]]), axis=0, return_index=True, return_inverse=True)
        fresh = fresh.reshape(-1)
        if len(first) == block.max() + 1 and len(first) == len(np.unique(block)):
            return fresh, first
        block = fresh


def compile_rules(patterns: list[str], most_states: int = 20_000) -> Automaton:
    """One automaton for all patterns, each as far as early() has it. That must be of bounded length; the patterns themselves need not."""
    trees = [early(_Parser(p).parse())[0] for p in patterns]
    sizes = [longest(t) for t in trees]
    if None in sizes or not trees:
        raise ValueError("a rule's beginning needs a longest match")
    nfa = _Nfa()
    root = nfa.state()
    final = {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        final.setdefault(nfa.add(tree, begin, True), set()).add(k)

    # Bytes that every set treats alike are one class.
    sets = sorted({s for own in nfa.moves for s, _ in own}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)])
    _, sample, byte_class = np.unique(member, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.reshape(-1).astype(np.uint8)

    closures: dict[int, frozenset] = {}

    def closure(s: int) -> frozenset:
        if s not in closures:
            seen, todo = {s}, [s]
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closures[s] = frozenset(seen)
        return closures[s]

    def settle(states: set[int]) -> frozenset:
        """Without threads that another one makes needless."""
        ahead: dict[int, int] = {}
        for s in states:
            if s in nfa.chain:
                run, place = nfa.chain[s]
                ahead[run] = max(ahead.get(run, -1), place)
        return frozenset(s for s in states if s not in nfa.chain or nfa.chain[s][1] == ahead[nfa.chain[s][0]])

    start = settle(set(closure(root)))
    number, order, rows = {start: 0}, [start], []
    k = 0
    while k < len(order):
        row = []
        for b in sample.tolist():
            to = set(start)
            for s in order[k]:
                for chars, t in nfa.moves[s]:
                    if b in chars:
                        to |= closure(t)
            target = settle(to)
            if target not in number:
                number[target] = len(order)
                order.append(target)
                if len(order) > most_states:
                    raise ValueError("the rules need too many states")
            row.append(number[target])
        rows.append(row)
        k += 1
    accept = [frozenset(r for s in states for r in final.get(s, ())) for states in order]
    block, first = _minimal(np.array(rows), accept)
    rules = [accept[s] for s in first]
    rank = sorted(range(len(first)), key=lambda c: bool(rules[c]))
    place = np.empty(len(first), np.int64)
    place[rank] = np.arange(len(first))
    table = place[block[np.array(rows)[first]]][rank]
    accepting = sum(not r for r in rules)
    return Automaton(table.astype(np.int32), byte_class, accepting, [tuple(sorted(rules[c])) for c in rank[accepting:]], max(sizes), int(place[block[0]]))
