"""Small weighted finite-state transducers over word classes, and their composition."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Transducer:
    """`arcs[state, symbol]` is (next state, output symbol, weight).

    A symbol without an arc passes unchanged, with weight one, and keeps the state.
    Weights along a path multiply.
    """

    start: Hashable
    arcs: dict

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def run(self, symbols: Iterable[str]):
        """Output symbol and weight for each input symbol."""
        state = self.start
        for symbol in symbols:
            state, out, weight = self.step(state, symbol)
            yield out, weight


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that passes the output of `first` to `second`."""
    alphabet = tuple(alphabet)
    start = (first.start, second.start)
    arcs, seen, open_states = {}, {start}, [start]
    while open_states:
        state = open_states.pop()
        for symbol in alphabet:
            a, middle, u = first.step(state[0], symbol)
            b, out, v = second.step(state[1], middle)
            arcs[state, symbol] = ((a, b), out, u * v)
            if (a, b) not in seen:
                seen.add((a, b))
                open_states.append((a, b))
    return Transducer(start, arcs)
