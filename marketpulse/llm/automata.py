"""Grammar inference: probabilistic automata from example strings by state merging.

A prefix tree of the examples is folded: two states are merged if the frequencies of
stopping and of each next symbol agree, by Hoeffding's bound, in them and in all states
that the merge would join below them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

END = ""


def symbol(c: str) -> str:
    """Alphabet of credential formats: classes of letters and digits, other signs as such."""
    if "0" <= c <= "9":
        return "9"
    if "a" <= c <= "f":
        return "f"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "F"
    if "G" <= c <= "Z":
        return "Z"
    return c


#: Characters that share a symbol; a symbol's probability is spread over them.
SPREAD = {"9": 10, "f": 6, "z": 20, "F": 6, "Z": 20}


@dataclass(frozen=True)
class Automaton:
    """``edges[state][symbol]`` is (log probability, next state); ``END`` leads nowhere."""

    edges: tuple[dict[str, tuple[float, int]], ...]
    #: Log probability of a symbol that no example had at a state.
    unseen: float

    def log_likelihood(self, text: str) -> float:
        """Mean natural log probability per character, the end included."""
        state, total = 0, 0.0
        for c in text:
            s = symbol(c)
            step = self.edges[state].get(s) if state >= 0 else None
            p, state = step if step else (self.unseen, -1)
            total += p - math.log(SPREAD.get(s, 1))
        last = self.edges[state].get(END) if state >= 0 else None
        return (total + (last[0] if last else self.unseen)) / (len(text) + 1)


class _Tree:
    def __init__(self, examples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.total = [0]
        for text in examples:
            at = 0
            for c in text:
                s = symbol(c)
                self.total[at] += 1
                self.count[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.total.append(0)
                at = self.next[at][s]
            self.total[at] += 1
            self.count[at][END] += 1

    def agree(self, a: int, b: int, alpha: float) -> bool:
        """Whether all frequencies of two states, and of the states below, are compatible."""
        stack = [(a, b)]
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        while stack:
            a, b = stack.pop()
            na, nb = self.total[a], self.total[b]
            limit = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / na - self.count[b].get(s, 0) / nb) > limit:
                    return False
            stack += [(t, self.next[b][s]) for s, t in self.next[a].items() if s in self.next[b]]
        return True

    def distance(self, a: int, b: int) -> float:
        """Sum of the differences of all frequencies of two states."""
        one, two = self.count[a], self.count[b]
        return sum(
            abs(one.get(s, 0) / self.total[a] - two.get(s, 0) / self.total[b])
            for s in one.keys() | two.keys()
        )

    def fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to state ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            for s, n in self.count[b].items():
                self.count[a][s] += n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    stack.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t


def infer(examples: list[str], alpha: float = 0.05, max_states: int = 200) -> Automaton:
    """Automaton of the examples; ``max_states`` bounds it, then the nearest state
    by the frequencies of stopping and of each next symbol absorbs, the oldest of equals.

    Without examples it is one state that has seen nothing.
    """
    if not examples:
        return Automaton(({},), math.log(1e-4))
    tree = _Tree(sorted(examples))
    red, blue = [0], [(0, s) for s in sorted(tree.next[0])]
    while blue:
        blue.sort(key=lambda e: (-tree.total[tree.next[e[0]][e[1]]], e))
        parent, s = blue.pop(0)
        state = tree.next[parent][s]
        into = next((r for r in red if tree.agree(r, state, alpha)), None)
        if into is None and len(red) >= max_states:
            into = min(red, key=lambda r: tree.distance(r, state))
        if into is None:
            red.append(state)
        else:
            tree.next[parent][s] = into
            tree.fold(into, state)
        known = set(red)
        blue = [(r, t) for r in red for t, n in sorted(tree.next[r].items()) if n not in known]
    number = {r: i for i, r in enumerate(red)}
    edges = []
    for r in red:
        out = {}
        kinds = len(tree.count[r]) + 1
        for s, n in tree.count[r].items():
            p = math.log((n + 0.1) / (tree.total[r] + 0.1 * kinds))
            out[s] = (p, number[tree.next[r][s]] if s != END else -1)
        edges.append(out)
    return Automaton(tuple(edges), math.log(1e-4))
