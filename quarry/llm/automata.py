"""Probabilistic automata inferred from strings: a prefix tree whose compatible states are merged (Alergia)."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np

#: Chance of taking two states for different ones by mistake.
ALPHA = 0.01
#: Weight of symbols that a state has never seen, in strings.
UNSEEN = 1.0
#: Strings up to this length are walked side by side; longer ones one by one.
TOGETHER = 512


@dataclass(slots=True)
class State:
    """How many strings came by, ended here, and went on by each symbol, and where to."""

    n: int = 0
    ends: int = 0
    seen: dict[int, int] = field(default_factory=dict)
    to: dict[int, State] = field(default_factory=dict)


def prefix_tree(strings: list[list[int]]) -> State:
    root = State()
    for x in strings:
        at = root
        at.n += 1
        for c in x:
            at.seen[c] = at.seen.get(c, 0) + 1
            at = at.to.setdefault(c, State())
            at.n += 1
        at.ends += 1
    return root


def _alike(a: State, b: State, bound: float) -> bool:
    """Whether two states and all that follows them agree within Hoeffding's bound."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        most = bound * (1 / sqrt(a.n) + 1 / sqrt(b.n))
        if most >= 1 and not (a.to.keys() & b.to.keys()):
            continue
        if abs(a.ends / a.n - b.ends / b.n) > most:
            return False
        for c in a.seen.keys() | b.seen.keys():
            if abs(a.seen.get(c, 0) / a.n - b.seen.get(c, 0) / b.n) > most:
                return False
        todo += [(a.to[c], b.to[c]) for c in a.to.keys() & b.to.keys()]
    return True


def _fit(a: State, b: State) -> float:
    """Log likelihood of how b's strings go on, by the shares of a: a state of few strings is compatible with nearly all."""
    pad = a.n + UNSEEN
    return sum(n * log((a.seen.get(c, 0) + 0.01) / pad) for c, n in b.seen.items()) + (b.ends * log((a.ends + 0.01) / pad) if b.ends else 0)


def _fold(a: State, b: State) -> None:
    """Adds the tree below b to the automaton at a."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        a.n += b.n
        a.ends += b.ends
        for c, n in b.seen.items():
            a.seen[c] = a.seen.get(c, 0) + n
            if c in a.to:
                todo.append((a.to[c], b.to[c]))
            else:
                a.to[c] = b.to[c]


def infer(strings: list[list[int]], alpha: float = ALPHA) -> list[State]:
    """The states of the merged tree, the start first. Nodes are tried in the order of their prefixes: by length, then symbols."""
    red = [prefix_tree(strings)]
    if not strings:
        return red
    bound, known = sqrt(0.5 * log(2 / alpha)), {id(red[0])}
    blue = deque((red[0], c) for c in sorted(red[0].to))
    while blue:
        parent, c = blue.popleft()
        node = parent.to[c]
        if id(node) in known:
            continue
        alike = [state for state in red if _alike(state, node, bound)]
        if alike:
            state = max(alike, key=lambda x: _fit(x, node))  # the first of equals
            parent.to[c] = state
            before = set(state.to)
            _fold(state, node)
            blue.extend((state, s) for s in sorted(state.to.keys() - before))
        else:
            red.append(node)
            known.add(id(node))
            blue.extend((node, s) for s in sorted(node.to))
    # a fold can hang new branches below states that were done
    at = 0
    while at < len(red):
        for c in sorted(red[at].to):
            if id(red[at].to[c]) not in known:
                red.append(red[at].to[c])
                known.add(id(red[at].to[c]))
        at += 1
    return red


class Automaton:
    """A merged tree as tables: next state and log likelihood by state and symbol; the last state takes what was never seen."""

    def __init__(self, strings: list[list[int]], symbols: int, alpha: float = ALPHA) -> None:
        states = infer(strings, alpha)
        number, stray = {id(s): k for k, s in enumerate(states)}, len(states)
        self.to = np.full((stray + 1, symbols), stray, np.int32)
        self.log, self.end = np.zeros((stray + 1, symbols)), np.zeros(stray + 1)
        pad = UNSEEN / (symbols + 1)
        for k, s in enumerate(states):
            self.log[k], self.end[k] = np.log(pad / (s.n + UNSEEN)), np.log((s.ends + pad) / (s.n + UNSEEN))
            for c, n in s.seen.items():
                self.to[k, c], self.log[k, c] = number[id(s.to[c])], np.log((n + pad) / (s.n + UNSEEN))
        self.log[stray], self.end[stray] = np.log(1 / (symbols + 1)), np.log(1 / (symbols + 1))

    def score(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each of the strings codes[start:end]."""
        sizes, state = ends - starts, np.zeros(len(starts), np.int32)
        out = np.zeros(len(starts))
        order = np.argsort(-np.minimum(sizes, TOGETHER), kind="stable")
        live = len(order)
        for k in range(int(min(sizes.max(initial=0), TOGETHER))):
            while live and sizes[order[live - 1]] <= k:
                live -= 1
            own = order[:live]
            c, s = codes[starts[own] + k], state[own]
            out[own] += self.log[s, c]
            state[own] = self.to[s, c]
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            s, total = int(state[i]), 0.0
            for c in codes[starts[i] + TOGETHER : ends[i]].tolist():
                total += self.log[s, c]
                s = int(self.to[s, c])
            out[i] += total
            state[i] = s
        return out + self.end[state]
