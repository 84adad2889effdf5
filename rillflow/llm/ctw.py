"""Context-tree weighting over binary-decomposed bytes, in numpy.

A symbol is a byte or the end mark (256), which is also what stands before a text. It is nine binary decisions, the first
of which tells the end mark from a byte and ends there; a decision is one of 256 nodes, named by the bits before it. For
each such node there is a tree of contexts: the ``depth`` symbols before, the last one nearest to the root. Every context
estimates the decision by Krichevsky-Trofimov counts, and weighting mixes the estimates of all depths:

    P_w(s) = P_e(s) / 2 + (product of P_w over the contexts below s) / 2,    P_w = P_e at the full depth.

A context stops with weight P_e / (P_e + product) and else hands over to the next one down. A context without training
data has the estimate 1/2 of its own counts, by the definition; with ``handed`` it takes the estimate of the context above
it, which is a distribution as well.

A gram is a symbol with its context, packed in 9 bits each as c1 c2 ... c_depth x, c1 the symbol just before. Trees below
two symbols of context are worked out apart from each other, and a tree of many grams again by its third symbol, so that
no more than about ``SLICE`` grams are worked out at once; ``Top`` has the root and the contexts of one symbol.
"""

from __future__ import annotations

import numpy as np

HALF = float(np.log(0.5))
LOG_PI = float(np.log(np.pi))
END, SYMBOLS, NODES, BITS = 256, 257, 512, 9
#: Grams that are worked out at once; only a single context of three symbols may have more.
SLICE = 300_000


def grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """The gram at each place from ``depth`` on."""
    n = len(stream) - depth
    out = np.zeros(n, dtype=np.int64)
    for k in range(1, depth + 1):
        out <<= BITS
        out |= stream[depth - k : depth - k + n]
    out <<= BITS
    out |= stream[depth:]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    less = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        less += np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - less


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - LOG_PI


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The probability of a one that follows from the counts."""
    return (ones + 0.5) / (zeros + ones + 1.0)


class Level:
    """Contexts of one depth for the decisions at one bit."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.up = self.stop = self.weighted = None


def levels(code: np.ndarray, count: np.ndarray, bit: int, steps: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The contexts for one bit from the full depth to ``steps`` above it, which grams decide it, and the deepest one of each.

    code: sorted, distinct.
    """
    some = np.arange(len(code)) if bit == 0 else np.flatnonzero((code & 511) < END)
    code, count = code[some], count[some]
    x = code & 511
    key = (code >> BITS << BITS) | (1 << bit) | (x >> (BITS - bit))
    one = (x >> (BITS - 1 - bit)) & 1
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    ones = np.add.reduceat(count * one, at).astype(np.float64) if len(at) else np.zeros(0)
    zeros = (np.add.reduceat(count, at) if len(at) else np.zeros(0)) - ones
    now = Level(key[at], zeros, ones)
    now.weighted = log_kt(zeros, ones)
    out = [now]
    for _ in range(steps):
        above, now.up = np.unique((now.key >> 2 * BITS << BITS) | (now.key & 511), return_inverse=True)
        size = len(above)
        up = Level(above, np.bincount(now.up, now.zeros, size), np.bincount(now.up, now.ones, size))
        up.weighted, up.stop = weighted(up.zeros, up.ones, np.bincount(now.up, now.weighted, size))
        out.append(up)
        now = up
    return out, some, own


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of stopping) of contexts, from what those below them have."""
    alone = log_kt(zeros, ones)
    both = np.logaddexp(alone, below)
    return both + HALF, np.exp(alone - both)


def cut(code: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Slices of whole contexts (code >> shift) of about SLICE grams; a context of more stands alone."""
    context = code >> shift
    starts = np.append(np.flatnonzero(np.append(True, context[1:] != context[:-1])), len(code))
    out, at = [], 0
    while at < len(starts) - 1:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE, side="right")) - 1)
        out.append((int(starts[at]), int(starts[stop])))
        at = stop
    return out


def slices(code: np.ndarray, depth: int) -> list[tuple[int, int]]:
    return cut(code, BITS * (depth - 1)) if len(code) else []


def large_tree(code: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """(3, NODES) of the one two-symbol context of these grams: zeros, ones, log probability of what is below it."""
    table = np.zeros((3, NODES))
    for a, b in cut(code, BITS * (depth - 2)):
        for bit in range(BITS):
            last = levels(code[a:b], count[a:b], bit, depth - 3)[0][-1]
            for k, v in enumerate((last.zeros, last.ones, last.weighted)):
                table[k] += np.bincount(last.key & 511, v, NODES)
    return table


def is_large(code: np.ndarray, depth: int) -> bool:
    return depth > 2 and len(code) > SLICE and code[0] >> (BITS * (depth - 1)) == code[-1] >> (BITS * (depth - 1))


def summary(code: np.ndarray, count: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """For each last symbol c1: (3, NODES) sums over its two-symbol contexts: zeros, ones, log weighted probability by node."""
    out: dict[int, np.ndarray] = {}
    for a, b in slices(code, depth):
        if is_large(code[a:b], depth):
            zeros, ones, below = large_tree(code[a:b], count[a:b], depth)
            table = out.setdefault(int(code[a] >> (BITS * depth)), np.zeros((3, NODES)))
            table += np.stack([zeros, ones, np.where(zeros + ones > 0, weighted(zeros, ones, below)[0], 0.0)])
            continue
        for bit in range(BITS):
            last = levels(code[a:b], count[a:b], bit, depth - 2)[0][-1]
            c1, node = last.key >> 2 * BITS, last.key & 511
            for c in np.unique(c1).tolist():
                here = c1 == c
                table = out.setdefault(c, np.zeros((3, NODES)))
                for k, v in enumerate((last.zeros, last.ones, last.weighted)):
                    table[k] += np.bincount(node[here], v[here], NODES)
    return out


class Top:
    """What the root and the one-symbol contexts leave for what is below: mixed so far, weight left, estimate; (SYMBOLS, NODES)."""

    def __init__(self, tables: dict[int, np.ndarray], handed: bool = False):
        zeros, ones, below = np.zeros((3, SYMBOLS, NODES))
        for c, t in tables.items():
            zeros[c], ones[c], below[c] = t
        alone, stop = weighted(zeros, ones, below)
        root_zeros, root_ones = zeros.sum(axis=0), ones.sum(axis=0)
        seen = zeros + ones > 0
        root_stop = weighted(root_zeros, root_ones, np.where(seen, alone, 0.0).sum(axis=0))[1]
        self.handed = handed
        self.state = root_stop * kt(root_zeros, root_ones), 1 - root_stop, kt(root_zeros, root_ones)
        self.state = tuple(np.broadcast_to(v, zeros.shape) for v in self.state)
        self.state = self.below(*self.state, zeros, ones, stop)

    def below(self, mixed, left, estimate, zeros, ones, stop):
        """The state one context further down. stop: its weight of stopping; 1 at the full depth."""
        seen, guess = zeros + ones > 0, kt(zeros, ones)
        if self.handed:
            guess = np.where(seen, guess, estimate)
        stop = np.where(seen, stop, 1.0)
        return mixed + left * stop * guess, left * (1 - stop), guess


def log_probabilities(code: np.ndarray, count: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """Natural log of the probability of each gram's symbol in its context. code: sorted, distinct."""
    total = np.zeros(len(code))

    def descend(a: int, b: int, bit: int, steps: int, begin):
        chain, some, own = levels(code[a:b], count[a:b], bit, steps)
        state = begin(chain[-1])
        for k in range(len(chain) - 1, -1, -1):
            now = chain[k]
            if k < len(chain) - 1:
                state = tuple(v[now.up] for v in state)
            state = top.below(*state, now.zeros, now.ones, now.stop if k else 1.0)
        p = np.clip(state[0][own], 1e-12, 1 - 1e-12)
        one = (code[a:b][some] >> (BITS - 1 - bit)) & 1
        total[a:b][some] += np.log(np.where(one == 1, p, 1 - p))

    for a, b in slices(code, depth):
        if is_large(code[a:b], depth):
            zeros, ones, below = large_tree(code[a:b], count[a:b], depth)
            c1 = int(code[a] >> (BITS * depth))
            state = top.below(*(v[c1] for v in top.state), zeros, ones, weighted(zeros, ones, below)[1])
            for x, y in cut(code[a:b], BITS * (depth - 2)):
                for bit in range(BITS):
                    descend(a + x, a + y, bit, depth - 3, lambda last: tuple(v[last.key & 511] for v in state))  # noqa: B023
            continue
        for bit in range(BITS):
            descend(a, b, bit, depth - 2, lambda last: tuple(v[last.key >> 2 * BITS, last.key & 511] for v in top.state))
    return total
