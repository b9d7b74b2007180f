"""Probabilistic automata from example strings, by merging compatible states of their prefix tree.

The tree is walked from its root, a layer at a time. Under each state the branches that look alike become one state: their
next symbols (by class) and the lengths of their examples must agree in a chi-square test, whose least count keeps what few
examples have seen from being told apart. States of one layer only are merged, so an automaton knows how long its strings
are and what stands where, as far as the examples show a difference.

A string is scored by its surprise, the bits of its symbols and its end less what the states expect. Where the symbols of a
class look evenly used in a state, each has the same share of the class; else they have the shares seen, and unseen ones a
little of their class. Unseen symbols go the way of their class. The bounds a string must keep are those of the
examples themselves, each scored without its own counts. A second score compares the classes of the whole string with
what its states expect: a run of digits may be likely symbol by symbol and yet not be of a format that mixes classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

DIGIT, HEX, LOWER, UPPER = range(4)
SIZES = {DIGIT: 10, HEX: 6, LOWER: 20, UPPER: 26}
#: Weight of the class among the counts of unevenly used symbols, and what an unseen class or end counts, in examples.
PRIOR, UNSEEN = 8.0, 0.01
#: Examples below which the test says nothing, symbols ahead that are compared, normal quantiles of the tests of branches
#: and of even use; both are high because most cells hold few examples.
LEAST, AHEAD, NORMAL, EVEN = 5, 6, 4.5, 7.0
#: Examples from which a branch shows what does not occur in it.
MANY = 10
#: Share of examples that may lie beyond a bound, and what is added to the bounds.
BEYOND, SLACK_BITS, SLACK_CLASSES = 0.03, 4.0, 6.0


def class_of(symbol: str) -> int | str:
    """Digits, the letters a-f, other lower and upper case letters; any other symbol is its own class."""
    if "0" <= symbol <= "9":
        return DIGIT
    if "a" <= symbol <= "z":
        return HEX if symbol <= "f" else LOWER
    return UPPER if "A" <= symbol <= "Z" else symbol


@dataclass
class State:
    visits: int = 0
    stops: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    next: dict[str, "State"] = field(default_factory=dict)
    #: Lengths of the examples that pass.
    lengths: Counter = field(default_factory=Counter)

    def settle(self) -> None:
        """Work out what scoring needs, once the state is no longer merged."""
        self.classes: Counter = Counter()
        self.costs: dict[str, float] = {}
        ways: dict[int | str, Counter] = {}
        for symbol, n in self.counts.items():
            kind = class_of(symbol)
            self.classes[kind] += n
            ways.setdefault(kind, Counter())[symbol] = n
        self.even = {kind for kind, seen in ways.items() if _is_even(seen, SIZES.get(kind, 1))}
        self.way = {kind: self.next[max(seen, key=lambda c: (seen[c], c))] for kind, seen in ways.items()}
        self.usual = self.next[max(self.counts, key=lambda c: (self.counts[c], c))] if self.counts else None
        self.expected = -self.stop_share() * math.log2(self.stop_share())
        for kind, seen in ways.items():
            shares = [self.share(symbol) for symbol in seen]
            # of an evenly used class all symbols count, seen or not
            often = SIZES.get(kind, 1) / len(seen) if kind in self.even else 1
            self.expected -= often * sum(p * math.log2(p) for p in shares)

    def share(self, symbol: str, less: int = 0) -> float:
        """Probability of a symbol, with ``less`` examples of it left out."""
        kind = class_of(symbol)
        going = self.visits - less
        of_class = (self.classes.get(kind, 0) - less + UNSEEN) / (going + 1) / SIZES.get(kind, 1)
        if kind in self.even or kind not in self.classes:
            return of_class
        return (self.counts.get(symbol, 0) - less + PRIOR * of_class) / (going + PRIOR)

    def cost(self, symbol: str) -> float:
        """Bits of a symbol."""
        known = self.costs.get(symbol)
        if known is None:
            known = self.costs[symbol] = -math.log2(self.share(symbol))
        return known

    def stop_share(self, less: int = 0) -> float:
        return (self.stops - less + UNSEEN) / (self.visits - less + 1)


@dataclass
class Automaton:
    """States from the root on, and the bounds of surprise and class balance that its strings keep."""

    root: State
    states: list[State]
    most_surprise: float = math.inf
    most_imbalance: float = math.inf

    def scores(self, text: str, less: int = 0, most: float = math.inf) -> tuple[float, float, float] | None:
        """(bits, surprise, imbalance); None as soon as the surprise is far beyond ``most``, and for a string of a length that
        no example has, or that goes on where all examples end or ends where all of many go on."""
        if self.root.lengths[len(text)] <= less:
            return None
        bits, surprise, state = 0.0, 0.0, self.root
        seen: Counter = Counter()
        expected: Counter = Counter()
        for symbol in text:
            if state.usual is None:
                return None
            cost = -math.log2(state.share(symbol, less)) if less else state.cost(symbol)
            bits, surprise = bits + cost, surprise + cost - state.expected
            if surprise > most + 16:
                return None
            kind = class_of(symbol)
            seen[kind] += 1
            for other, n in state.classes.items():
                expected[other] += n / (state.visits - state.stops)
            state = state.next.get(symbol) or state.way.get(kind) or state.usual
        if state.stops <= less and state.visits >= MANY:
            return None
        cost = -math.log2(state.stop_share(less))
        imbalance = sum((seen[k] - expected[k]) ** 2 / (expected[k] + 0.5) for k in seen.keys() | expected.keys())
        return bits + cost, surprise + cost - state.expected, imbalance

    def log2_likelihood(self, text: str) -> float | None:
        """log2 of the probability of a string and its end, if the string keeps the bounds; else None."""
        found = self.scores(text, most=self.most_surprise)
        if found is None or found[1] > self.most_surprise or found[2] > self.most_imbalance:
            return None
        return -found[0]


def infer(examples: Iterable[str]) -> Automaton:
    """The automaton of the examples, merged, with its bounds."""
    examples = list(examples)
    root = State()
    for text in examples:
        state = root
        for symbol in text:
            state.visits += 1
            state.lengths[len(text)] += 1
            state.counts[symbol] = state.counts.get(symbol, 0) + 1
            state = state.next.setdefault(symbol, State())
        state.visits += 1
        state.stops += 1
        state.lengths[len(text)] += 1
    states, layer = [], [root]
    while layer:
        states += layer
        layer = [merged for state in layer for merged in _merge_branches(state)]
    for state in states:
        state.settle()
    found = Automaton(root, states)
    each = [s for s in (found.scores(text, less=1) for text in examples) if s is not None]
    if not each:  # nothing is known about what examples have in common
        found.most_surprise = -math.inf
    else:
        beyond = min(len(each) - 1, math.ceil((1 - BEYOND) * len(each)))
        found.most_surprise = sorted(s[1] for s in each)[beyond] + SLACK_BITS
        found.most_imbalance = sorted(s[2] for s in each)[beyond] + SLACK_CLASSES
    return found


def _merge_branches(state: State) -> list[State]:
    """Make branches that agree one state; the states that are left, those of most examples first."""
    kept: list[tuple[State, list[Counter]]] = []
    for symbol in sorted(state.next, key=lambda c: (-state.counts[c], c)):
        branch = state.next[symbol]
        ahead = _profile(branch)
        alike = [(other, profile) for other, profile in kept if _alike(profile, ahead)]
        if alike:
            other, profile = max(alike, key=lambda x: _nearness(x[1], ahead))
            _fold(other, branch)
            for total, part in zip(profile, ahead):
                total.update(part)
            state.next[symbol] = other
        else:
            kept.append((branch, ahead))
    return [branch for branch, _ in kept]


def _profile(state: State) -> list[Counter]:
    """Lengths of the examples, and the classes at each of the next places (None where a string has ended)."""
    profile = [Counter(state.lengths)]
    layer = [state]
    for _ in range(AHEAD):
        seen: Counter = Counter()
        for s in layer:
            if s.stops:
                seen[None] += s.stops
            for symbol, n in s.counts.items():
                seen[class_of(symbol)] += n
        profile.append(seen)
        layer = [t for s in layer for t in s.next.values()]
    return profile


def _alike(profile: list[Counter], ahead: list[Counter]) -> bool:
    """Whether a branch may belong to another. What a few examples have in common with many shows in their lengths: if none
    occurs there, nor the class at some place, they are of another kind."""
    if not all(_agree(a, b) for a, b in zip(profile, ahead)):
        return False
    if sum(ahead[0].values()) >= LEAST or sum(profile[0].values()) < MANY:
        return True
    strange = [not a.keys() & b.keys() for a, b in zip(profile, ahead) if a or b]
    return not (strange[0] and any(strange[1:]))


def _nearness(profile: list[Counter], ahead: list[Counter]) -> float:
    """Mean log probability of one branch's lengths and classes under those of another."""
    total = 0.0
    for a, b in zip(profile, ahead):
        n = sum(a.values()) + 1
        total += sum(c * math.log((a[k] + 0.1) / n) for k, c in b.items()) / max(1, sum(b.values()))
    return total


def _most(free: int, normal: float) -> float:
    """Upper bound of a chi-square statistic with so many degrees of freedom."""
    return free * (1 - 2 / (9 * free) + normal * math.sqrt(2 / (9 * free))) ** 3


def _is_even(seen: Counter, size: int) -> bool:
    """Whether counts of some symbols of a class could come from equal shares of all."""
    share = sum(seen.values()) / size
    found = sum((n - share) ** 2 for n in seen.values()) / share + (size - len(seen)) * share
    return size > 1 and found <= _most(size - 1, EVEN)


def _agree(a: Counter, b: Counter) -> bool:
    """Chi-square test of two histograms."""
    n, m = sum(a.values()), sum(b.values())
    if min(n, m) < LEAST:
        return True
    kinds = a.keys() | b.keys()
    if len(kinds) < 2:
        return True
    share = n / (n + m)
    found = sum((a[k] - (a[k] + b[k]) * share) ** 2 / ((a[k] + b[k]) * share * (1 - share)) for k in kinds)
    return found <= _most(len(kinds) - 1, NORMAL)


def _fold(into: State, other: State) -> None:
    """Add the tree below ``other`` to that below ``into``."""
    todo = [(into, other)]
    while todo:
        x, y = todo.pop()
        x.visits, x.stops = x.visits + y.visits, x.stops + y.stops
        x.lengths.update(y.lengths)
        for symbol, count in y.counts.items():
            x.counts[symbol] = x.counts.get(symbol, 0) + count
            if symbol in x.next:
                todo.append((x.next[symbol], y.next[symbol]))
            else:
                x.next[symbol] = y.next[symbol]
