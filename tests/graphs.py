"""Small graphs and plain-Python versions of the operators."""

import heapq
import random
from collections import defaultdict

TESTER = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 6), (3, 4), (3, 5), (4, 5), (4, 7), (5, 6), (5, 7), (6, 7)]
TEST6 = [(0, 1), (0, 2), (1, 2), (2, 3), (2, 6), (3, 4), (3, 5), (3, 7), (4, 5), (4, 7), (5, 6), (5, 7), (6, 7)]


def random_edges(n, m, seed):
    r = random.Random(seed)
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})


def neighbours(edges, n):
    out = {v: set() for v in range(n)}
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def hops(adj, s):
    dist, front = {s: 0}, [s]
    while front:
        front = [u for v in front for u in adj[v] if u not in dist and not dist.update({u: dist[v] + 1})]
    return dist


def lengths(weighted, s):
    adj = defaultdict(list)
    for a, b, w in weighted:
        adj[a].append((b, w))
        adj[b].append((a, w))
    dist, heap = {}, [(0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for u, w in adj[v]:
                heapq.heappush(heap, (d + w, u))
    return dist


def components(edges, n):
    top = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return dict(enumerate(top))


def cores(adj):
    left, core, k = {v: set(u) for v, u in adj.items()}, {}, 0
    while left:
        low = [v for v, u in left.items() if len(u) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for u in left.pop(v):
                left.get(u, set()).discard(v)
    return core


def colours(adj):
    out = {}
    for v in sorted(adj):
        used = {out[u] for u in adj[v] if u in out}
        out[v] = next(c for c in range(len(adj) + 1) if c not in used)
    return out


def forest_weight(weighted, n):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    total = 0
    for w, a, b in sorted((w, a, b) for a, b, w in weighted):
        if find(a) != find(b):
            top[find(a)] = find(b)
            total += w
    return total


def dependencies(adj, s):
    dist = hops(adj, s)
    order = sorted(dist, key=dist.get)
    sigma, delta = dict.fromkeys(dist, 0.0), dict.fromkeys(dist, 0.0)
    sigma[s] = 1.0
    for v in order:
        for u in adj[v]:
            if dist[u] == dist[v] + 1:
                sigma[u] += sigma[v]
    for v in reversed(order):
        for u in adj[v]:
            if dist[u] == dist[v] + 1:
                delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
    top = max(delta.values()) or 1
    return {v: delta.get(v, 0.0) / top for v in adj}
