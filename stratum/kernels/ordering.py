"""Weighted matching with scalings, minimum degree and Cuthill-McKee orderings.

A matrix is a list of rows, each a dict from column to value. Matching is a shortest augmenting path method on the
costs log(row maximum) - log|a| (Duff and Koster, 2001); its dual variables are the scalings, which make every entry
at most 1 in magnitude and those of the matching exactly 1.
"""

from __future__ import annotations

import heapq
import math

from stratum.types import BadInput

Rows = list[dict[int, complex]]


def match(rows: Rows) -> tuple[list[int], list[float], list[float], bool]:
    """(column of each row, row scaling, column scaling, complete). Unmatched rows take the free columns in order."""
    n = len(rows)
    top = [max((abs(v) for v in r.values()), default=0.0) for r in rows]
    cost = [{j: math.log(top[i]) - math.log(abs(v)) for j, v in r.items() if v} for i, r in enumerate(rows)]
    dual_row, dual_col = [0.0] * n, [math.inf] * n
    for row in cost:
        for j, c in row.items():
            dual_col[j] = min(dual_col[j], c)
    dual_col = [0.0 if math.isinf(v) else v for v in dual_col]
    for i, row in enumerate(cost):
        dual_row[i] = min((c - dual_col[j] for j, c in row.items()), default=0.0)
    col_of, row_of = [-1] * n, [-1] * n
    for i, row in enumerate(cost):
        for j, c in row.items():
            if row_of[j] < 0 and c - dual_row[i] - dual_col[j] <= 1e-14:
                col_of[i], row_of[j] = j, i
                break
    complete = True
    for start in range(n):
        if col_of[start] >= 0 or not cost[start]:
            complete &= col_of[start] >= 0
            continue
        dist, came, done, heap = {}, {}, {}, []
        i, base, end = start, 0.0, -1
        while True:
            for j, c in cost[i].items():
                if j in done:
                    continue
                d = base + max(0.0, c - dual_row[i] - dual_col[j])
                if d < dist.get(j, math.inf):
                    dist[j], came[j] = d, i
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                break
            base, j = heapq.heappop(heap)
            done[j] = base
            if row_of[j] < 0:
                end = j
                break
            i = row_of[j]
        if end < 0:
            complete = False
            continue
        for j, d in done.items():
            if row_of[j] >= 0 and j != end:
                dual_row[row_of[j]] += base - d
            dual_col[j] -= base - d
        dual_row[start] += base
        j = end
        while True:
            i = came[j]
            col_of[i], row_of[j], j = j, i, col_of[i]
            if i == start:
                break
    # With rounding or rows left over, the duals may pass a cost by a little: columns give way.
    for i, row in enumerate(cost):
        for j, c in row.items():
            if dual_row[i] + dual_col[j] > c and col_of[i] != j:
                dual_row[i] = c - dual_col[j] if col_of[i] < 0 else dual_row[i]
    free = iter([j for j in range(n) if row_of[j] < 0])
    for i in range(n):
        if col_of[i] < 0:
            col_of[i] = next(free)
    limit = lambda x: math.exp(max(-600.0, min(600.0, x)))
    s = [limit(u) / t if t else 1.0 for u, t in zip(dual_row, top)]
    t = [limit(v) for v in dual_col]
    return col_of, s, t, complete


def pattern(rows: Rows) -> list[set[int]]:
    """Neighbours in A + A', without the diagonal."""
    out = [set() for _ in rows]
    for i, row in enumerate(rows):
        for j in row:
            if i != j:
                out[i].add(j)
                out[j].add(i)
    return out


def minimum_degree(near: list[set[int]]) -> list[int]:
    """An elimination order by approximate external degrees on a quotient graph, elements absorbed (Amestoy et al., 1996)."""
    n = len(near)
    variables = [set(x) for x in near]
    elements: list[set[int]] = [set() for _ in range(n)]  # elements of a variable
    body: dict[int, set[int]] = {}  # variables of an element
    degree = [len(x) for x in near]
    dense = max(16, int(10 * math.sqrt(n)))
    late = [i for i in range(n) if degree[i] > dense]
    gone = [False] * n
    for i in late:
        gone[i] = True
    for i in late:
        for j in variables[i]:
            variables[j].discard(i)
    heap = [(len(variables[i]), i) for i in range(n) if not gone[i]]
    degree = [len(x) for x in variables]
    heapq.heapify(heap)
    order = []
    while heap:
        d, k = heapq.heappop(heap)
        if gone[k] or d != degree[k]:
            continue
        gone[k] = True
        order.append(k)
        front = set(variables[k])
        for e in elements[k]:
            front |= body.pop(e)
        front.discard(k)
        old = elements[k]
        body[k] = front
        for i in front:
            elements[i] -= old
            variables[i] -= front
            variables[i].discard(k)
            elements[i].add(k)
        for i in front:
            bound = len(variables[i]) + sum(len(body[e]) - 1 for e in elements[i])
            degree[i] = min(n - len(order) - 1, bound)
            heapq.heappush(heap, (degree[i], i))
    return order + sorted(late, key=lambda i: (len(near[i]), i))


def cuthill_mckee(near: list[set[int]]) -> list[int]:
    """The reverse Cuthill-McKee order, each component from a pseudo-peripheral node."""
    n, seen, order = len(near), set(), []

    def spread(root: int) -> list[list[int]]:
        levels, known = [[root]], {root}
        while True:
            nxt = sorted({j for i in levels[-1] for j in near[i]} - known)
            if not nxt:
                return levels
            known.update(nxt)
            levels.append(nxt)

    for start in sorted(range(n), key=lambda i: (len(near[i]), i)):
        if start in seen:
            continue
        root, levels = start, spread(start)
        while True:
            far = min(levels[-1], key=lambda i: (len(near[i]), i))
            wider = spread(far)
            if len(wider) <= len(levels):
                break
            root, levels = far, wider
        queue = [root]
        seen.add(root)
        for i in queue:
            fresh = sorted((j for j in near[i] if j not in seen), key=lambda j: (len(near[j]), j))
            seen.update(fresh)
            queue += fresh
        order += queue
    return order[::-1]


def check_order(order: list[int], n: int) -> None:
    if sorted(order) != list(range(n)):
        raise BadInput("not a permutation")
