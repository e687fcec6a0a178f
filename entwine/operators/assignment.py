"""Maximum-weight bipartite matching over edges, for the components that have no closed form.

Successive shortest augmenting paths with potentials over lists of neighbours: the work grows with the
edges, not with rows times columns, and the memory with the edges alone.  Every row may stay
unmatched, at a column of its own with weight 0.  The edges of one document must fit one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush


def match(rows: dict[int, list[tuple[int, float]]]) -> dict[int, int]:
    """Row to column of a matching with the largest sum; rows: each row's columns (from 0) with their weights (not negative)."""
    # the row's own column is -1 - row
    costs = {i: [(j, -w) for j, w in near] + [(-1 - i, 0.0)] for i, near in rows.items()}
    u = {i: min(c for _, c in near) for i, near in costs.items()}
    v: dict[int, float] = {}
    owner: dict[int, int] = {}
    for start in costs:
        best: dict[int, float] = {}
        come: dict[int, int] = {}
        done: dict[int, float] = {}
        queue: list[tuple[float, int]] = []
        row, base = start, 0.0
        scanned = [(start, 0.0)]
        while True:
            for j, c in costs[row]:
                if j not in done:
                    d = base + c - u[row] - v.get(j, 0.0)
                    if d < best.get(j, float("inf")):
                        best[j], come[j] = d, row
                        heappush(queue, (d, j))
            while True:
                base, column = heappop(queue)
                if column not in done and base <= best[column]:
                    break
            done[column] = base
            if column not in owner:
                break
            row = owner[column]
            scanned.append((row, base))
        for i, d in scanned:
            u[i] += base - d
        for j, d in done.items():
            v[j] = v.get(j, 0.0) + d - base
        held = {i: j for j, i in owner.items() if j in done}
        while True:
            i = come[column]
            owner[column] = i
            if i == start:
                break
            column = held[i]
    return {i: j for j, i in owner.items() if j >= 0}


def best_assignment(weights: Iterable[Iterable[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching with the largest sum of a matrix's weights."""
    return sorted(match({i: list(enumerate(map(float, row))) for i, row in enumerate(weights)}).items())


def best_total(edges: list[tuple[int, int, float]]) -> float:
    """The largest sum of a matching of weighted edges; each connected component is solved by itself."""
    weight: dict[tuple[int, int], float] = {}
    near: dict[tuple[int, int], list[int]] = {}  # (side, id) to ids of the other side
    for a, b, w in edges:
        if (a, b) not in weight:
            near.setdefault((0, a), []).append(b)
            near.setdefault((1, b), []).append(a)
        weight[a, b] = max(w, weight.get((a, b), 0.0))
    total, seen = 0.0, set()
    for node in near:
        if node in seen:
            continue
        sides: tuple[list, list] = ([], [])
        todo = [node]
        seen.add(node)
        while todo:
            side, x = todo.pop()
            sides[side].append(x)
            for y in near[side, x]:
                if (1 - side, y) not in seen:
                    seen.add((1 - side, y))
                    todo.append((1 - side, y))
        if len(sides[0]) == 1 or len(sides[1]) == 1:
            total += max(weight[a, b] for a in sides[0] for b in near[0, a])
            continue
        column = {b: k for k, b in enumerate(sides[1])}
        rows = {k: [(column[b], weight[a, b]) for b in near[0, a]] for k, a in enumerate(sides[0])}
        total += sum(weight[sides[0][i], sides[1][j]] for i, j in match(rows).items())
    return total
