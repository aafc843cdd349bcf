"""Clustering kernels.  One group is one request's pool (bounded at a few thousand nodes), solved in one task; groups run side by side."""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Edge = tuple[int, int, float]
Clusters = list[list[int]]


class Union:
    def __init__(self, ids) -> None:
        self.root = {i: i for i in ids}

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True

    def groups(self, least: int = 1) -> Clusters:
        out = defaultdict(list)
        for i in sorted(self.root):
            out[self.top(i)].append(i)
        return [g for _, g in sorted(out.items()) if len(g) >= least]


def neighbours(edges: list[Edge]) -> dict[int, dict[int, float]]:
    adj: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, w in edges:
        adj[a][b] = min(w, adj[a].get(b, np.inf))
        adj[b][a] = min(w, adj[b].get(a, np.inf))
    return adj


def component_clusters(ids: list[int], edges: list[Edge], least: int = 2) -> Clusters:
    u = Union(ids)
    for a, b, _ in edges:
        u.join(a, b)
    return u.groups(least)


def dbscan(ids: list[int], distance: Callable[[int, int], float], eps: float, min_points: int) -> Clusters:
    """Density clusters; a point counts itself, and a border point goes to the first cluster that reaches it."""
    return dbscan_near(ids, {a: [b for b in ids if a == b or distance(a, b) <= eps] for a in ids}, min_points)


def dbscan_near(ids: list[int], near: dict[int, list[int]], min_points: int) -> Clusters:
    """Likewise, from what lies near each point (itself included)."""
    core = {a for a in ids if len(near[a]) >= min_points}
    owner: dict[int, int] = {}
    clusters: Clusters = []
    for a in ids:
        if a in owner or a not in core:
            continue
        number, stack = len(clusters), deque([a])
        clusters.append([])
        owner[a] = number
        while stack:
            v = stack.popleft()
            clusters[number].append(v)
            if v in core:
                for w in near[v]:
                    if w not in owner:
                        owner[w] = number
                        stack.append(w)
    return [sorted(c) for c in clusters]


def dbscan_planar(ids: list[int], place: dict[int, tuple[float, float]], eps: float, min_points: int) -> Clusters:
    """Likewise, of places in metres: what is near a point is sought in the cells around it, and not kept."""
    if not ids:
        return []
    xy = np.array([place[i] for i in ids], float)
    cell = np.floor(xy / eps).astype(np.int64)
    order = np.lexsort(cell.T)
    bounds = np.flatnonzero(np.r_[True, (np.diff(cell[order], axis=0) != 0).any(axis=1), True])
    members = {tuple(cell[order[a]].tolist()): np.sort(order[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)}
    none, around = np.empty(0, np.int64), {}
    for x, y in members:
        own = np.sort(np.concatenate([members.get((x + i, y + j), none) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        around[x, y] = own, xy[own]
    key = list(map(tuple, cell.tolist()))

    def near(v: int) -> np.ndarray:
        own, at = around[key[v]]
        return own[np.hypot(at[:, 0] - xy[v, 0], at[:, 1] - xy[v, 1]) <= eps]

    core = np.array([len(near(v)) >= min_points for v in range(len(ids))])
    owner = np.full(len(ids), -1)
    number = 0
    for a in np.flatnonzero(core).tolist():
        if owner[a] >= 0:
            continue
        owner[a], stack = number, [a]
        while stack:
            found = near(stack.pop())
            found = found[owner[found] < 0]
            owner[found] = number
            stack += found[core[found]].tolist()
        number += 1
    out: Clusters = [[] for _ in range(number)]
    for i, c in sorted(zip(ids, owner.tolist(), strict=True)):
        if c >= 0:
            out[c].append(i)
    return out


def mutual_reach(ids: list[int], edges: list[Edge], k: int) -> list[Edge]:
    adj = neighbours(edges)
    core = {i: (sorted(adj[i].values())[k - 1] if len(adj[i]) >= k else np.inf) for i in ids}
    return [(a, b, w) for a, b, d in edges if np.isfinite(w := max(core[a], core[b], d))]


def spanning_forest(ids: list[int], edges: list[Edge]) -> list[Edge]:
    u = Union(ids)
    return [(a, b, w) for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges) if u.join(a, b)]


def hdbscan_bisect(ids: list[int], reach: list[Edge], least: int) -> Clusters:
    """Cuts the spanning forest at its largest edge while both sides keep ``least`` members.

    Sides only shrink, so an edge that can't be cut once never can: one pass from the largest edge down, which looks at ``least`` members of each side at most.
    """
    tree = spanning_forest(ids, reach)
    adj: dict[int, set[int]] = defaultdict(set)
    for a, b, _ in tree:
        adj[a].add(b)
        adj[b].add(a)

    def enough(start: int, other: int) -> bool:
        seen, stack = 1, [(start, other)]
        while stack and seen < least:
            v, back = stack.pop()
            for w in adj[v]:
                if w != back:
                    seen += 1
                    stack.append((w, v))
        return seen >= least

    kept = []
    for w, a, b in sorted(((w, a, b) for a, b, w in tree), reverse=True):
        if enough(a, b) and enough(b, a):
            adj[a].discard(b)
            adj[b].discard(a)
        else:
            kept.append((a, b, w))
    return sorted(component_clusters(ids, kept, least))


def hdbscan_star(ids: list[int], reach: list[Edge], least: int, leaf: bool = False) -> Clusters:
    """Single linkage, condensed tree, stabilities, and the clusters of greatest excess of mass (or the leaves)."""
    parts = Union(ids)
    # leaves come first, then a number for each merge
    n, node_of, ordered = len(ids), {i: k for k, i in enumerate(ids)}, list(ids)
    size, children, top = [1] * n, {}, [True] * n
    for a, b, w in spanning_forest(ids, reach):
        x, y = node_of[parts.top(a)], node_of[parts.top(b)]
        parts.join(a, b)
        number = len(size)
        children[number] = (x, y, w)
        size.append(size[x] + size[y])
        top[x] = top[y] = False
        top.append(True)
        node_of[parts.top(a)] = number

    def members(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(ordered[v])
            else:
                stack += children[v][:2]
        return sorted(out)

    chosen: Clusters = []
    for root in (r for r, t in enumerate(top) if t and size[r] >= least):
        start: list[int] = []  # condensed cluster -> the merge it begins with
        kids: list[list[int]] = []
        stability: list[float] = []
        todo = [(root, 0.0, -1)]
        while todo:
            at, birth, parent = todo.pop()
            me = len(start)
            start.append(at)
            kids.append([])
            stability.append(0.0)
            if parent >= 0:
                kids[parent].append(me)
            # follows a cluster down; members that fall out leave it, a split into two large sides makes two new clusters
            while at in children:
                x, y, w = children[at]
                lam = 1 / max(w, 1e-9)
                big, small = (x, y) if size[x] >= size[y] else (y, x)
                if size[small] >= least:
                    stability[me] += (lam - birth) * size[at]
                    todo += [(y, lam, me), (x, lam, me)]
                    break
                if size[big] < least:  # the cluster ends here
                    stability[me] += (lam - birth) * size[at]
                    break
                stability[me] += (lam - birth) * size[small]
                at = big
        # a cluster's kids have greater numbers
        best, own = list(stability), [True] * len(start)
        for c in range(len(start) - 1, -1, -1):
            if kids[c] and (leaf or sum(best[k] for k in kids[c]) > stability[c]):
                best[c], own[c] = sum(best[k] for k in kids[c]), False
        stack = [0]
        while stack:
            c = stack.pop()
            if own[c]:
                chosen.append(members(start[c]))
            else:
                stack += kids[c]
    return sorted(chosen)


def _quality_moves(weights: dict[int, dict[int, float]], gamma: float, order: list[int], start: dict[int, int]) -> dict[int, int]:
    """Local moves by modularity gain until none gains."""
    total = sum(sum(x.values()) for x in weights.values()) or 1.0
    strength = {v: sum(weights[v].values()) for v in weights}
    label = dict(start)
    mass: dict[int, float] = defaultdict(float)
    for v in weights:
        mass[label[v]] += strength[v]
    moved, rounds = True, 0
    while moved and rounds < 64:
        moved, rounds = False, rounds + 1
        for v in order:
            links: dict[int, float] = defaultdict(float)
            for w, x in weights[v].items():
                if w != v:
                    links[label[w]] += x
            old = label[v]
            mass[old] -= strength[v]
            pull = gamma * strength[v]
            best, most = old, round(links.get(old, 0.0) - pull * mass[old] / total, 12)
            for c, x in links.items():
                gain = round(x - pull * mass[c] / total, 12)
                if gain > most or gain == most and best != old and c < best:
                    best, most = c, gain
            mass[best] += strength[v]
            if best != old:
                label[v], moved = best, True
    return label


def _aggregate(weights: dict[int, dict[int, float]], label: dict[int, int]) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for v, ws in weights.items():
        out[label[v]]
        for w, x in ws.items():
            out[label[v]][label[w]] += x
    return {k: dict(x) for k, x in out.items()}


def mulberry32(seed: int) -> Callable[[], float]:
    """A 32-bit generator of numbers in [0, 1)."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ state >> 15) * (1 | state)) & 0xFFFFFFFF
        t = (t + (((t ^ t >> 7) * (61 | t)) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw


def louvain(ids: list[int], edges: list[Edge], gamma: float, sigma: float, seed: int = 1, refine: bool = False) -> dict[int, int]:
    """Communities by modularity with weights exp(-m / sigma); ``refine`` splits each community into its connected well-bound parts
    before graphs are aggregated (Leiden), so that no community is disconnected."""
    weights: dict[int, dict[int, float]] = {i: {} for i in ids}
    for a, b, m in edges:
        w = float(np.exp(-m / sigma))
        weights[a][b] = weights[a].get(b, 0.0) + w
        weights[b][a] = weights[b].get(a, 0.0) + w
    draw = mulberry32(seed ^ int(gamma * 1000))
    whole = {i: i for i in ids}
    for _ in range(64):
        nodes = sorted(weights)
        order = sorted(nodes, key=lambda _: draw())
        label = _quality_moves(weights, gamma, order, {v: v for v in nodes})
        parts = label
        if refine:
            inner = {v: {w: x for w, x in weights[v].items() if label[w] == label[v]} for v in nodes}
            parts = _quality_moves(inner, gamma, order, {v: v for v in nodes})
            u = Union(nodes)
            for v in nodes:
                for w in inner[v]:
                    if parts[v] == parts[w]:
                        u.join(v, w)
            parts = {v: u.top(v) for v in nodes}
        if len(set(parts.values())) == len(nodes):
            return {i: label[c] for i, c in whole.items()}
        whole = {i: parts[c] for i, c in whole.items()}
        weights = _aggregate(weights, parts)
    return whole


def communities(ids: list[int], edges: list[Edge], most_link: float, least: int, leiden: bool = False, seed: int = 1) -> Clusters:
    """A sweep over resolutions; of communities alike by 0.8 the larger stays."""
    found: Clusters = []
    for gamma in (0.4, 0.7, 1.0, 1.4):
        label = louvain(ids, edges, gamma, most_link / 3, seed, leiden)
        groups = defaultdict(list)
        for i in sorted(ids):
            groups[label[i]].append(i)
        found += [g for g in groups.values() if len(g) >= least]
    return dedupe(sorted(found, key=lambda g: (-len(g), g)))


def jaccard(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def dedupe(clusters: Clusters, alike: float = 0.8) -> Clusters:
    """Without clusters alike to one kept before."""
    kept: Clusters = []
    holds: dict[int, list[int]] = defaultdict(list)  # member -> kept clusters
    sizes: list[int] = []
    for c in clusters:
        own = set(c)
        shared = Counter(k for m in own for k in holds[m])
        if any(n / (len(own) + sizes[k] - n) >= alike for k, n in shared.items()) or not own and 0 in sizes:
            continue
        for m in own:
            holds[m].append(len(kept))
        kept.append(c)
        sizes.append(len(own))
    return kept


def tree_length_planar(xy: np.ndarray) -> float:
    """Length of the least spanning tree of places in metres."""
    if len(xy) < 2:
        return 0.0
    rest, total = np.asarray(xy[1:], float), 0.0
    d = np.hypot(rest[:, 0] - xy[0][0], rest[:, 1] - xy[0][1])
    while len(d):
        k = int(np.argmin(d))
        total += float(d[k])
        x, y = rest[k]
        rest, d = np.delete(rest, k, axis=0), np.delete(d, k)
        d = np.minimum(d, np.hypot(rest[:, 0] - x, rest[:, 1] - y))
    return total


def tree_length(n: int, distance: Callable[[int, int], float]) -> float:
    """Length of the least spanning tree of n points, all pairs linked."""
    if n < 2:
        return 0.0
    left = {i: distance(0, i) for i in range(1, n)}
    total = 0.0
    while left:
        v = min(left, key=lambda i: (left[i], i))
        total += left.pop(v)
        for i in left:
            left[i] = min(left[i], distance(v, i))
    return total


def least_tree(members: list[int], distance: Callable[[int, int], float]) -> list[Edge]:
    """The edges of ``spanning_forest`` over all finite distances, without a list of all pairs."""
    at = {m: n for n, m in enumerate(members)}
    left = {m: (np.inf, m, m) for m in members}
    tree = []
    while left:
        v = min(left, key=left.__getitem__)
        w, a, b = left.pop(v)
        if np.isfinite(w):
            tree.append((w, a, b))
        for m, best in left.items():
            d = distance(v, m) if at[v] < at[m] else distance(m, v)
            if d <= best[0] and np.isfinite(d) and (near := (d, min(v, m), max(v, m))) < best:
                left[m] = near
    return [(a, b, w) for w, a, b in sorted(tree)]


def least_tree_planar(members: list[int], place: dict[int, tuple[float, float]], factor: float, adj: dict[int, dict[int, float]]) -> list[Edge]:
    """Likewise, of ``factor`` times the distance of places in metres, or the walk (``adj``) where it is shorter; a row of distances at a time."""
    at, ids = {m: n for n, m in enumerate(members)}, np.array(members, np.int64)
    xy = np.array([place[m] for m in members], float).reshape(-1, 2)
    # of those left: the shortest link to the tree and its ends
    w, a, b = np.full(len(ids), np.inf), ids.copy(), ids.copy()
    left = np.arange(len(ids))
    tree = []
    while len(left):
        tied = np.flatnonzero(w[left] == w[left].min())
        k = int(tied[np.lexsort((b[left[tied]], a[left[tied]]))[0]])
        n = int(left[k])
        v = int(ids[n])
        if np.isfinite(w[n]):
            tree.append((float(w[n]), int(a[n]), int(b[n])))
        left = np.delete(left, k)
        d = np.full(len(ids), np.inf)
        d[left] = np.hypot(xy[left, 0] - xy[n, 0], xy[left, 1] - xy[n, 1]) * factor
        for m, walk in adj.get(v, {}).items():
            if m in at:
                d[at[m]] = min(d[at[m]], walk)
        d, low, high = d[left], np.minimum(ids[left], v), np.maximum(ids[left], v)
        old_w, old_a, old_b = w[left], a[left], b[left]
        better = np.isfinite(d) & ((d < old_w) | (d == old_w) & ((low < old_a) | (low == old_a) & (high < old_b)))
        w[left[better]], a[left[better]], b[left[better]] = d[better], low[better], high[better]
    return [(x, y, z) for z, x, y in sorted(tree)]


def split_by_tree(members: list[int], distance: Callable[[int, int], float], budget: float, least: int, depth: int = 64, tree: Callable[[list[int]], list[Edge]] | None = None) -> Clusters:
    """Cut at the tree's longest edge while twice its length is over the budget; parts below ``least`` go.

    What a cut leaves of a least spanning tree is that of each side, so the tree is made once, by ``tree`` or from all distances.
    """
    return _split(members, tree(members) if tree else least_tree(members, distance), budget, least, depth) if len(members) >= least else []


def _split(members: list[int], tree: list[Edge], budget: float, least: int, depth: int) -> Clusters:
    if len(members) < least:
        return []
    if 2 * sum(w for _, _, w in tree) <= budget or depth == 0 or not tree:
        return [sorted(members)]
    longest = max(tree, key=lambda e: (e[2], -e[0], -e[1]))
    rest = [e for e in tree if e != longest]
    sides = component_clusters(members, rest, 1)
    side_of = {m: n for n, side in enumerate(sides) for m in side}
    trees: list[list[Edge]] = [[] for _ in sides]
    for e in rest:
        trees[side_of[e[0]]].append(e)
    return [c for side, t in zip(sides, trees, strict=True) for c in _split(side, t, budget, least, depth - 1)]


def trim_walking(members: list[int], adj: dict[int, dict[int, float]]) -> list[int]:
    own = set(members)
    return [m for m in members if own & adj.get(m, {}).keys()]


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def trim_far(members: list[int], place: dict[int, tuple[float, float]], least: int, cap: float, factor: float = 2.0) -> list[int]:
    """Drops what lies beyond min(factor x upper median, cap) of the centre, again until nothing does; never below ``least``."""
    kept = list(members)
    while len(kept) > least:
        xy = np.array([place[m] for m in kept])
        d = np.hypot(*(xy - xy.mean(axis=0)).T)
        limit = min(factor * upper_median(d.tolist()), cap)
        good = [m for m, x in zip(kept, d, strict=True) if x <= limit]
        if len(good) == len(kept) or len(good) < least:
            break
        kept = good
    return kept


def refine(clusters: Clusters, adj, place, distance, budget: float, least: int, skip: frozenset[str] = frozenset(), tree: Callable[[list[int]], list[Edge]] | None = None) -> Clusters:
    """Walking trim, distance trim, tree split, likeness; then the least size."""
    out: Clusters = []
    for c in clusters:
        if "walking" not in skip:
            c = trim_walking(c, adj)
        if "far" not in skip and c:
            c = trim_far(c, place, least, budget / 4)
        out += split_by_tree(c, distance, budget, least, tree=tree) if "split" not in skip else [c]
    out = sorted(out, key=lambda c: (-len(c), c))
    return [c for c in (dedupe(out) if "alike" not in skip else out) if len(c) >= least]


STRATEGIES = ("hdbscan-star", "hdbscan", "dbscan", "components", "louvain", "leiden")
DEFAULT_STRATEGY = "hdbscan-star"


def cluster(ids: list[int], edges: list[Edge], strategy: str | None, most_link: float, least: int) -> Clusters:
    name = strategy if strategy in STRATEGIES else DEFAULT_STRATEGY
    if name == "components":
        return component_clusters(ids, edges, max(2, least))
    if name in ("louvain", "leiden"):
        return communities(ids, edges, most_link, least, name == "leiden")
    if name == "dbscan":
        adj = neighbours(edges)
        near = {a: sorted({a, *(b for b, w in adj.get(a, {}).items() if w <= most_link)}) for a in ids}
        return [c for c in dbscan_near(sorted(ids), near, max(3, least // 2)) if len(c) >= least]
    reach = mutual_reach(ids, edges, max(1, min(3, least - 1)))
    return hdbscan_bisect(ids, reach, least) if name == "hdbscan" else hdbscan_star(ids, reach, least)


def cluster_groups(nodes: DataFrame, edges: DataFrame, group: str, strategy: str | None, most_link: float, least: int) -> DataFrame:
    """(group, cluster, id) of every group's graph; nodes (group, id), edges (group, from_id, to_id, meters)."""
    kind = nodes.schema[group].dataType.simpleString()

    def run(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({group: [], "cluster": [], "id": []})
        es = list(zip(graph["from_id"].tolist(), graph["to_id"].tolist(), graph["meters"].tolist(), strict=True))
        found = cluster(sorted(own["id"].tolist()), es, strategy, most_link, least)
        return pd.DataFrame([(own[group].iloc[0], n, i) for n, c in enumerate(found) for i in c], columns=[group, "cluster", "id"])

    return nodes.groupBy(group).cogroup(edges.groupBy(group)).applyInPandas(run, f"{group} {kind}, cluster long, id long")


def pixel_groups(points: list[tuple[int, float, float]], threshold: float = 20.0) -> list[list[int]]:
    """The first point takes all within the threshold, the next one left does so in turn."""
    left, out = list(points), []
    while left:
        i, x, y = left[0]
        near = [p for p in left if np.hypot(p[1] - x, p[2] - y) <= threshold]
        taken = {p[0] for p in near}
        out.append([p[0] for p in near])
        left = [p for p in left if p[0] not in taken]
    return out


def colocated(ids: list[int], distance: Callable[[int, int], float], order: dict[int, int], threshold: float) -> dict[int, list[int]]:
    """Groups of nodes within the threshold in either direction, by the member that is first in (order, id)."""
    u = Union(ids)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(distance(a, b), distance(b, a)) <= threshold:
                u.join(a, b)
    out = {}
    for g in u.groups():
        rep = min(g, key=lambda m: (order.get(m, 1 << 30), m))
        out[rep] = sorted(g, key=lambda m: (order.get(m, 1 << 30), m))
    return out


def agreement(a: Clusters, b: Clusters) -> float:
    """Mean best likeness of a's clusters to b's."""
    return float(np.mean([max((jaccard(x, y) for y in b), default=0.0) for x in a])) if a else 0.0


def sweep_metrics(clusters: Clusters, pool: int, distance: Callable[[int, int], float], budget: float, place: dict[int, tuple[float, float]] | None = None) -> dict[str, float]:
    """``place`` (in metres) stands for the distance where it is given."""
    trees = [tree_length_planar(np.array([place[i] for i in c])) if place else tree_length(len(c), lambda i, j, c=c: distance(c[i], c[j])) for c in clusters]
    assigned = Counter(i for c in clusters for i in c)
    return {
        "coverage": len(assigned) / pool if pool else 0.0, "tightness": float(np.mean([t / len(c) for t, c in zip(trees, clusters, strict=True)])) if clusters else 0.0,
        "feasible": float(np.mean([2 * t <= budget for t in trees])) if clusters else 0.0,
    }
