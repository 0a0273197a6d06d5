"""One deterministic automaton for many byte patterns.

The patterns are parsed into syntax trees, the trees are read from right to left into a single NFA, and
subset construction and minimisation turn it into arrays. A right-to-left run of those arrays over a
text reads every byte once and tells, for all patterns together, where matches start. From such a start
the small forward automaton of its pattern gives the longest end. Leftmost-longest matches that don't
overlap follow, per pattern.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ALL = frozenset(range(256))
DIGIT = frozenset(range(48, 58))
WORD = DIGIT | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
SPACE = frozenset(b" \t\n\r\f\v")
NAMED = {"d": DIGIT, "w": WORD, "s": SPACE, "D": ALL - DIGIT, "W": ALL - WORD, "S": ALL - SPACE}
PLAIN = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "0": 0}
#: Lanes below which the rest of a lockstep run goes byte by byte.
FEW_LANES = 24


class _Parser:
    """Syntax: | ( ) (?: ) (?i: ) [ ] . ? * + {m} {m,} {m,n} and the usual escapes; over bytes."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alternatives(False)
        if self.i != len(self.p):
            raise ValueError(f"unbalanced pattern {self.p!r} at {self.i}")
        return node

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern {self.p!r} ends early")
        self.i += 1
        return c

    def alternatives(self, fold: bool):
        found = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence(fold))
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self, fold: bool):
        items = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom(fold)
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                low, high = self.count()
                node = ("rep", node, low, high)
            items.append(node)
        return ("cat", items)

    def count(self) -> tuple[int, int | None]:
        c = self.take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i : end].partition(",")
        self.i = end + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            elif self.p.startswith("?i:", self.i):
                self.i, fold = self.i + 3, True
            node = self.alternatives(fold)
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            return node
        if c == "[":
            return ("set", self.folded(self.members(), fold))
        if c == ".":
            return ("set", ALL - {10})
        if c == "\\":
            return ("set", self.folded(self.escape(), fold))
        return ("cat", [("set", self.folded(frozenset([b]), fold)) for b in c.encode()])

    @staticmethod
    def folded(members: frozenset[int], fold: bool) -> frozenset[int]:
        if not fold:
            return members
        return members | {b ^ 32 for b in members if 65 <= b & 95 <= 90}

    def escape(self) -> frozenset[int]:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return NAMED.get(c) or frozenset([PLAIN.get(c, ord(c))])

    def members(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            c, first = self.take(), False
            one = self.escape() if c == "\\" else frozenset([ord(c)])
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", "") and len(one) == 1:
                self.take()
                c = self.take()
                last = self.escape() if c == "\\" else frozenset([ord(c)])
                one = frozenset(range(min(one), max(last) + 1))
            if max(one) > 255:
                raise ValueError("classes hold single bytes")
            found |= one
        self.take()
        return ALL - found if negated else frozenset(found)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int, backwards: bool) -> int:
        """Adds the tree behind start; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            step = self.state()
            self.empty[start].append(step)
            self.move[step] = (node[1], end)
            return end
        if kind == "cat":
            for child in reversed(node[1]) if backwards else node[1]:
                start = self.add(child, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for child in node[1]:
                begin = self.state()
                self.empty[start].append(begin)
                self.empty[self.add(child, begin, backwards)].append(end)
            return end
        _, child, low, high = node
        for _ in range(low):
            start = self.add(child, start, backwards)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(child, loop, backwards)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(child, start, backwards)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """next_state[state, byte_class[byte]]; accepts[state] is a bit mask of patterns."""

    byte_class: np.ndarray
    next_state: np.ndarray
    accepts: np.ndarray
    _flat: list[int] = field(default_factory=list, repr=False)

    @property
    def resets(self) -> np.ndarray:
        """For each byte: whether every state goes to one and the same state on it."""
        same = (self.next_state == self.next_state[0]).all(axis=0)
        return same[self.byte_class]


def determinise(trees: list, backwards: bool, anywhere: bool) -> Dfa:
    """Subset construction over byte classes, then minimisation."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.add(tree, begin, backwards)] = 1 << k
    sets = sorted({m[0] for m in nfa.move if m}, key=sorted)
    marks = np.array([[b in s for b in range(256)] for s in sets], dtype=np.uint8).T
    _, sample, byte_class = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    # sets of NFA states as bits of an integer; only states that move or accept matter
    keeps = {s for s, m in enumerate(nfa.move) if m} | set(ends)
    closed: dict[int, int] = {}

    def closure_bits(state: int) -> int:
        if state not in closed:
            closed[state] = sum(1 << s for s in nfa.closure([state]) if s in keeps)
        return closed[state]

    moves: dict[int, tuple[list[int], int]] = {}
    for s, m in enumerate(nfa.move):
        if m:
            moves[s] = ([c for c, b in enumerate(sample.tolist()) if b in m[0]], closure_bits(m[1]))
    always = closure_bits(root) if anywhere else 0
    first = closure_bits(root)
    number, order, rows, accepts = {first: 0}, [first], [], []
    for states in order:
        row, accept, rest = [always] * len(sample), 0, states
        while rest:
            low = rest & -rest
            rest ^= low
            s = low.bit_length() - 1
            accept |= ends.get(s, 0)
            if s in moves:
                classes, reached = moves[s]
                for c in classes:
                    row[c] |= reached
        for reached in row:
            if reached not in number:
                number[reached] = len(order)
                order.append(reached)
        rows.append([number[reached] for reached in row])
        accepts.append(accept)
    return minimise(byte_class, np.array(rows, dtype=np.int64), np.array(accepts, dtype=np.int64))


def minimise(byte_class: np.ndarray, rows: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Moore's refinement. State 0 stays the start."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, chosen = np.unique(block, return_index=True)
    order = np.argsort(block[chosen] != block[0], kind="stable")  # the start's block comes first
    place = np.empty(len(chosen), dtype=np.int64)
    place[block[chosen[order]]] = np.arange(len(chosen))
    return Dfa(byte_class.astype(np.uint8), place[block[rows[chosen[order]]]].astype(np.int32), accepts[chosen[order]])


class Scanner:
    """Leftmost-longest matches that don't overlap, for each of the patterns."""

    def __init__(self, patterns: list[str]):
        trees = [_Parser(p).parse() for p in patterns]
        self.starts_dfa = determinise(trees, backwards=True, anywhere=True)
        self.forward = [determinise([t], backwards=False, anywhere=False) for t in trees]
        self._prepare()

    def _prepare(self) -> None:
        d = self.starts_dfa
        self.width = d.next_state.shape[1]
        self.flat = (d.next_state.astype(np.int64) * self.width).reshape(-1)
        self.flat_list = self.flat.tolist()
        self.mask = d.accepts
        self.hit = d.accepts != 0
        self.class_of = bytes(d.byte_class.tolist())
        self.resets = d.resets
        quiet = [b for b in (10, 0, *range(1, 32)) if self.resets[b] and not self.hit[d.next_state[0, d.byte_class[b]]]]
        self.separator = quiet[0] if quiet else None

    def starts(self, data: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions where matches of some pattern start, and the patterns' bit masks.

        The bytes are cut behind which every state is the same: there the run can begin anew, so many
        pieces advance together, one byte of each at a step. Every byte is read once.
        """
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        classes = self.starts_dfa.byte_class[data]
        cuts = np.flatnonzero(self.resets[data])
        wanted = np.arange(lane, n, lane)
        at = np.searchsorted(cuts, wanted)
        # a piece ends with a resetting byte, which it reads first
        ends = np.unique(np.append(cuts[at[at < len(cuts)]] + 1, n))
        begins = np.concatenate([[0], ends[:-1]])
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        sizes = ends - begins
        state = np.zeros(len(ends), dtype=np.int64)
        positions, states = [], []
        step, live = 0, len(ends)
        while live:
            live = int(np.searchsorted(-sizes, -step, side="left"))
            if live < FEW_LANES:
                break
            at = ends[:live] - 1 - step
            state[:live] = self.flat[state[:live] + classes[at]]
            now = state[:live] // self.width
            found = np.flatnonzero(self.hit[now])
            if len(found):
                positions.append(at[found])
                states.append(now[found])
            step += 1
        for k in range(live):
            s, stop = int(state[k]), int(ends[k]) - step
            table, width = self.flat_list, self.width
            accepting = self.hit.tolist()
            own_at, own_state = [], []
            rest = classes[begins[k] : stop][::-1].tobytes()
            for i, c in enumerate(rest, 1):
                s = table[s + c]
                if accepting[s // width]:
                    own_at.append(stop - i)
                    own_state.append(s // width)
            positions.append(np.array(own_at, dtype=np.int64))
            states.append(np.array(own_state, dtype=np.int64))
        if not positions:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, mask = np.concatenate(positions), self.mask[np.concatenate(states)]
        order = np.argsort(found, kind="stable")
        return found[order], mask[order]

    def longest(self, pattern: int, data: bytes, start: int, stop: int) -> int:
        """The end of the longest match of the pattern from start on; -1 if there is none."""
        d = self.forward[pattern]
        table, classes, accepts = d.next_state, d.byte_class, d.accepts
        if not d._flat:
            d._flat = (table.astype(np.int64) * table.shape[1]).reshape(-1).tolist()
        width, flat = table.shape[1], d._flat
        good, dead = (accepts != 0).tolist(), self._dead(pattern)
        s, end = 0, start if good[0] else -1
        for i, c in enumerate(data[start:stop].translate(bytes(classes.tolist())), start + 1):
            s = flat[s + c]
            state = s // width
            if good[state]:
                end = i
            elif dead[state]:
                break
        return end

    def _dead(self, pattern: int) -> list[bool]:
        if not hasattr(self, "_dead_states"):
            self._dead_states: dict[int, list[bool]] = {}
        if pattern not in self._dead_states:
            d = self.forward[pattern]
            own = np.arange(len(d.accepts))
            self._dead_states[pattern] = ((d.next_state == own[:, None]).all(axis=1) & (d.accepts == 0)).tolist()
        return self._dead_states[pattern]

    def _joined(self, texts: list[bytes]):
        """The texts in one buffer where that is exact, else one by one: (indices, buffer, begins, bounds)."""
        if self.separator is None:
            groups = [[k] for k in range(len(texts))]
        else:
            groups = [list(range(len(texts)))]
        sep = bytes([self.separator]) if self.separator is not None else b""
        for group in groups:
            lengths = np.array([len(texts[k]) for k in group], dtype=np.int64)
            bounds = np.cumsum(lengths + len(sep))
            yield group, sep.join(texts[k] for k in group) + sep, bounds - lengths - len(sep), bounds, lengths

    def places(self, texts: list[bytes]) -> dict[int, list[int]]:
        """Of the texts in which some pattern matches: where matches start, ascending."""
        found: dict[int, list[int]] = {}
        for group, joined, first, bounds, _ in self._joined(texts):
            positions, _ = self.starts(np.frombuffer(joined, dtype=np.uint8))
            owner = np.searchsorted(bounds, positions, side="right")
            for k, at in zip(owner.tolist(), (positions - first[owner]).tolist(), strict=True):
                found.setdefault(group[k], []).append(at)
        return found

    def find_all(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (pattern, start, end), in bytes, by pattern and start."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for group, joined, first, bounds, lengths in self._joined(texts):
            positions, masks = self.starts(np.frombuffer(joined, dtype=np.uint8))
            owner = np.searchsorted(bounds, positions, side="right")
            for pattern in range(len(self.forward)):
                mine = np.flatnonzero(masks & (1 << pattern))
                limit, last = -1, -1
                for doc, at in zip(owner[mine].tolist(), positions[mine].tolist(), strict=True):
                    if doc != last:
                        last, limit = doc, -1
                    if at < limit:
                        continue
                    begin = int(first[doc])
                    end = self.longest(pattern, joined, at, begin + int(lengths[doc]))
                    if end > at:
                        out[group[doc]].append((pattern, at - begin, end - begin))
                        limit = end
        return out
