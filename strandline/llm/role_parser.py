"""Least-cost repair of a sequence of roles by generalised LR parsing.

The grammar of roles gives an SLR automaton. A stack is a node that knows its state and the node below it; equal
stacks are one node, so stacks share what lies below their tops, and the tops form a graph with a few nodes however
long the sequence is. At every turn each top tries all edits: keep the turn, give it another role, delete it, insert a
turn before it. Where edits lead to the same top, the smallest (cost, audit) stays; the audit has one letter an edit.

What an edit costs doesn't depend on what came before, and of two audits for the same turns with the same cost and top
neither begins with the other, as the rest would be insertions, which cost. So the smallest of the whole sequence is
made of the smallest parts, and a long sequence can be cut: a part is a table from the top before to the top after.
"""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cache

#: Roles by their initials: an optional system turn, then turns of user and assistant in pairs, or nothing.
GRAMMAR = (
    ("dialogue", ()), ("dialogue", ("pairs",)), ("dialogue", ("s", "pairs")),
    ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")),
)
#: What a turn may become, and what may be inserted.
WRITABLE = ("u", "a")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_END = "$"

type Value = tuple[int, str]
type Tops = dict["Stack", Value]


class Stack:
    """A node of the graph. Equal stacks are one object: ``push`` makes each only once."""

    def __init__(self, state: int, below: "Stack | None" = None):
        self.state, self.below, self._above = state, below, {}

    def push(self, state: int) -> "Stack":
        if state not in self._above:
            self._above[state] = Stack(state, self)
        return self._above[state]

    def pop(self, n: int) -> "Stack":
        return self if n == 0 else self.below.pop(n - 1)

    def states(self) -> tuple[int, ...]:
        return (*(self.below.states() if self.below else ()), self.state)


class Automaton:
    """The SLR automaton of a grammar; a state may have several actions for a symbol, and all are followed."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("", (grammar[0][0],)), *grammar)
        self.names = {name for name, _ in self.rules}
        self.states: list[frozenset] = [self._closure({(0, 0)})]
        self.moves: list[dict[str, int]] = []
        while len(self.moves) < len(self.states):
            items = self.states[len(self.moves)]
            nexts: dict[str, set] = {}
            for rule, dot in sorted(items):
                if dot < len(self.rules[rule][1]):
                    nexts.setdefault(self.rules[rule][1][dot], set()).add((rule, dot + 1))
            self.moves.append({symbol: self._number(self._closure(kernel)) for symbol, kernel in nexts.items()})
        follow = self._follow()
        self.reductions = [
            [(rule, follow[self.rules[rule][0]]) for rule, dot in sorted(items) if rule and dot == len(self.rules[rule][1])]
            for items in self.states
        ]
        self.bottom = Stack(0)
        self.after = cache(self._after)
        self.accepts = cache(lambda stack: any(s.states() == (0, self.moves[0][self.rules[0][1][0]]) for s in self._reduced(stack, _END)))

    def _closure(self, items: set) -> frozenset:
        items, open_ = set(items), list(items)
        while open_:
            rule, dot = open_.pop()
            for other, (name, _) in enumerate(self.rules):
                if name in self.rules[rule][1][dot : dot + 1] and (other, 0) not in items:
                    items.add((other, 0))
                    open_.append((other, 0))
        return frozenset(items)

    def _number(self, state: frozenset) -> int:
        if state not in self.states:
            self.states.append(state)
        return self.states.index(state)

    def _follow(self) -> dict[str, set[str]]:
        """The symbols that can stand behind each name."""
        first: dict[str, set[str]] = {name: set() for name in self.names}
        follow: dict[str, set[str]] = {name: {_END} if name == "" else set() for name in self.names}

        def firsts(symbols: Sequence[str]) -> set[str]:  # "" if they can be empty
            found: set[str] = set()
            for symbol in symbols:
                own = first[symbol] if symbol in self.names else {symbol}
                found |= own - {""}
                if "" not in own:
                    return found
            return found | {""}

        for _ in range(len(self.rules) ** 2):
            for name, symbols in self.rules:
                first[name] |= firsts(symbols)
                for i, symbol in enumerate(symbols):
                    if symbol in self.names:
                        rest = firsts(symbols[i + 1 :])
                        follow[symbol] |= (rest - {""}) | (follow[name] if "" in rest else set())
        return follow

    def _reduced(self, stack: Stack, symbol: str) -> set[Stack]:
        """The stack and what its reductions before ``symbol`` lead to."""
        found, open_ = {stack}, [stack]
        while open_:
            top = open_.pop()
            for rule, allowed in self.reductions[top.state]:
                if symbol in allowed:
                    name, symbols = self.rules[rule]
                    low = top.pop(len(symbols))
                    new = low.push(self.moves[low.state][name])
                    if new not in found:
                        found.add(new)
                        open_.append(new)
        return found

    def _after(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        """The stacks once ``symbol`` is read."""
        if symbol in self.names:
            return ()
        tops = self._reduced(stack, symbol)
        return tuple(top.push(self.moves[top.state][symbol]) for top in tops if symbol in self.moves[top.state])

    def stack(self, states: Iterable[int]) -> Stack:
        """The node of the states, from the bottom up."""
        _, *above = states
        node = self.bottom
        for state in above:
            node = node.push(state)
        return node


@dataclass(frozen=True)
class Turn:
    initial: str
    unusable: bool = False  # has to be deleted
    truncated: bool = False


def _keep(tops: Tops, stack: Stack, cost: int, audit: str) -> bool:
    if stack in tops and tops[stack] <= (cost, audit):
        return False
    tops[stack] = cost, audit
    return True


def with_insertions(automaton: Automaton, tops: Tops) -> Tops:
    """The tops, and those that inserted turns lead to."""
    tops, open_ = dict(tops), list(tops)
    while open_:
        top = open_.pop()
        cost, audit = tops[top]
        for role in WRITABLE:
            for new in automaton.after(top, role):
                if _keep(tops, new, cost + INSERT, audit + "I"):
                    open_.append(new)
    return tops


def read(automaton: Automaton, tops: Tops, turns: Iterable[Turn]) -> Tops:
    """The tops after the turns, each with the smallest (cost, audit) that leads there."""
    for turn in turns:
        before, tops = with_insertions(automaton, tops), {}
        extra = TRUNCATED if turn.truncated else 0
        for top, (cost, audit) in before.items():
            _keep(tops, top, cost + DELETE, audit + "D")
            if turn.unusable:
                continue
            for new in automaton.after(top, turn.initial):
                _keep(tops, new, cost + extra, audit + "K")
            for role in WRITABLE:
                for new in automaton.after(top, role):
                    _keep(tops, new, cost + REROLE + extra, audit + "R")
    return tops


def best(automaton: Automaton, tops: Tops) -> Value:
    """The smallest (cost, audit) of a whole sequence."""
    return min(value for top, value in with_insertions(automaton, tops).items() if automaton.accepts(top))


def best_repair(automaton: Automaton, turns: Iterable[Turn]) -> Value:
    return best(automaton, read(automaton, {automaton.bottom: (0, "")}, turns))


def all_tops(automaton: Automaton) -> list[Stack]:
    """Every stack that a sequence can lead to: few, as the grammar repeats to the left."""
    found, open_ = {automaton.bottom: None}, [automaton.bottom]
    while open_:
        top = open_.pop()
        for symbol in {s for _, symbols in automaton.rules for s in symbols} - automaton.names:
            for new in automaton.after(top, symbol):
                if new not in found:
                    found[new] = None
                    open_.append(new)
    return list(found)


def apply(automaton: Automaton, start: Stack, initials: Sequence[str], audit: str) -> tuple[list[tuple[int, str]], Stack]:
    """(place of the turn or -1, initial of its role) of what an audit keeps, reroles or inserts, and the last top.

    The role of a rerole or an insertion is the one that the grammar has room for.
    """
    result, place, top = [], 0, start
    for edit in audit:
        if edit != "D":
            roles = [initials[place]] if edit == "K" else WRITABLE
            role, top = next((role, new) for role in roles for new in automaton.after(top, role))
            result.append((place if edit != "I" else -1, role))
        place += edit != "I"
    return result, top
