"""Cutting stock by column generation: which piece lengths fill a sequence together.

The linear program has a row for each piece length (how many pieces there are) and
a column for each pattern (how many pieces of each length one sequence takes):
minimise the number of sequences.  Patterns are not listed but priced: knapsack
dynamic programming over the sequence's tokens finds the pattern that the current
dual prices value most, a simplex step takes it in, and the best lower bound
(sequences / best pattern's value) says when to stop.  Whole parts of the solution
are kept; what rounding leaves is packed by largest piece and subset sums, and the
pieces of sequences that would stay too empty are left for cutting.

Everything here depends on the histogram of lengths only: at most ``capacity`` rows,
whatever the number of documents.
"""

from __future__ import annotations

import numpy as np

#: Tokens a length class spans in the linear program, and how full a pattern must be to be used.
UNIT = 4
FULL = 15 / 16


def _price(duals: np.ndarray, lengths: np.ndarray, capacity: int, how_many: int) -> tuple[float, np.ndarray]:
    """(value of the best pattern at these prices, patterns (rows): the best one
    and the best ones that hold each of the lengths of highest value)."""
    worth = np.flatnonzero(duals > 1e-12)
    value, size = duals[worth], lengths[worth]             # lengths ascending
    f = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = upto[room]
        best, chosen = f[room - 1], -1
        if k:
            gain = f[room - size[:k]] + value[:k]
            j = int(gain.argmax())
            if gain[j] > best + 1e-12:
                best, chosen = gain[j], j
        f[room], take[room] = best, chosen
    start = np.argsort(-(value + f[capacity - size]), kind="stable")[:how_many]
    patterns = np.zeros((len(start), len(lengths)), dtype=np.int64)
    for pattern, first in zip(patterns, start):
        pattern[worth[first]] = 1
        room = capacity - size[first]
        while room > 0:
            if take[room] < 0:
                room -= 1
            else:
                pattern[worth[take[room]]] += 1
                room -= size[take[room]]
    return float(f[capacity]), patterns


def relaxed(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3,
            stall: int = 3) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of a solution of the linear program: within ``gap`` of the
    best, or where ``stall`` steps for each length gain less than half of that."""
    m = len(lengths)
    basis = np.diag(capacity // lengths)                    # one pattern a row
    inverse = np.diag(1.0 / np.diag(basis))                 # of the matrix whose columns are the patterns
    x = demand / np.diag(basis)
    bound = float((lengths * demand).sum()) / capacity
    pool = np.zeros((0, m))
    step, reached = 0, np.inf
    while True:
        if step % (stall * m) == 0:
            if x.sum() > reached * (1 - gap / 2):
                break
            reached = x.sum()
        step += 1
        duals = inverse.sum(axis=0)
        known = np.einsum("pm,m->p", pool, duals)
        if not len(pool) or known.max() <= 1 + 1e-7:        # the pool has nothing better: generate columns
            value, new = _price(duals, lengths, capacity, 48)
            total = x.sum()
            bound = max(bound, total / max(value, 1.0))
            if value <= 1 + 1e-7 or total <= bound * (1 + gap) + 1e-9:
                break
            pool = np.concatenate([pool[known > 0.8], new])
            known = np.einsum("pm,m->p", pool, duals)
        pattern = pool[int(known.argmax())]
        d = np.einsum("ij,j->i", inverse, pattern)
        rows = np.flatnonzero(d > 1e-9)
        ratio = x[rows] / d[rows]
        amount = max(0.0, float(ratio.min()))
        ties = rows[ratio <= ratio.min() + 1e-12]
        out = ties[int(d[ties].argmax())]
        x -= amount * d
        x[out] = amount
        pivot = inverse[out] / d[out]
        d[out] = 0
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return [(basis[k], float(x[k])) for k in range(m) if x[k] > 1e-9]


def _fill(left: dict[int, int], room: int) -> dict[int, int]:
    """Pieces from ``left`` (length -> number) whose lengths add up to as much of ``room`` as any can."""
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted((k for k, n in left.items() if n and k <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return taken


def plan(histogram: dict[int, int], capacity: int, unit: int = UNIT, full: float = FULL):
    """How pieces of the lengths 1 ... capacity form sequences.

    Returns (class_patterns, patterns, left): patterns (class -> pieces) over length
    classes (class k: the lengths above (k - 1) * unit up to k * unit; longest pieces
    first), then patterns (length -> pieces) over what these leave, each with its
    number of sequences and filled to ``full`` of the capacity or more; and the
    pieces of the patterns that weren't, length -> number.
    """
    left = {int(k): int(n) for k, n in histogram.items() if n}
    whole = left.pop(capacity, 0)
    classes: dict[int, int] = {}
    for k, n in left.items():
        classes[-(-k // unit)] = classes.get(-(-k // unit), 0) + n
    class_patterns: list[tuple[dict[int, int], int]] = []
    if classes:
        ks = np.array(sorted(classes), dtype=np.int64)
        room = dict(classes)
        solution = relaxed(ks, np.array([classes[k] for k in ks], dtype=float), capacity // unit)
        for pattern, times in sorted(solution, key=lambda s: (-(s[0] * ks).sum(), tuple(s[0]))):
            pieces = {int(k): int(n) for k, n in zip(ks, pattern) if n}
            n = min(int(times + 1e-6), *[room[k] // m for k, m in pieces.items()])
            if n > 0 and (pattern * ks).sum() * unit >= full * capacity:
                class_patterns.append((pieces, n))
                for k, m in pieces.items():
                    room[k] -= m * n
        for k in classes:                                   # the longest pieces of a class have been used
            used = classes[k] - room[k]
            for length in range(min(k * unit, capacity - 1), (k - 1) * unit, -1):
                gone = min(used, left.get(length, 0))
                if gone:
                    left[length] -= gone
                    used -= gone
    patterns: list[tuple[dict[int, int], int]] = [({capacity: 1}, whole)] if whole else []
    loose: dict[int, int] = {}
    while any(left.values()):
        longest = max(k for k, n in left.items() if n)
        left[longest] -= 1
        pieces = _fill(left, capacity - longest)
        left[longest] += 1
        pieces[longest] = pieces.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pieces.items())     # the same pattern as often as it can be had
        for k, n in pieces.items():
            left[k] -= n * times
        if sum(k * n for k, n in pieces.items()) >= full * capacity:
            patterns.append((pieces, times))
        else:
            for k, n in pieces.items():
                loose[k] = loose.get(k, 0) + n * times
    return class_patterns, patterns, loose
