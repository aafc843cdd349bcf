"""Tour optimisation kernels on one instance's matrix, and their grouped DataFrame forms.  An instance has at most a few hundred stops."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_closure(m: np.ndarray, most_link: float) -> np.ndarray:
    """Missing cells (NaN) get the shortest way over links of at most ``most_link``; others stay as they are."""
    d = np.where(np.isnan(m) | (m > most_link), np.inf, m)
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    return np.where(np.isnan(m), np.where(np.isfinite(d), d, np.nan), m)


def tour_length(order: list[int], d: np.ndarray, closed: bool = True) -> float:
    if len(order) < 2:
        return 0.0
    pairs = zip(order, order[1:] + (order[:1] if closed else []), strict=False)
    return float(sum(d[a, b] for a, b in pairs))


def nearest_first(d: np.ndarray, start: int) -> list[int]:
    order, left = [start], set(range(len(d))) - {start}
    while left:
        nxt = min(left, key=lambda j: (d[order[-1], j], j))
        order.append(nxt)
        left.remove(nxt)
    return order


def shorter_paths(path: list[int], d: np.ndarray, reversals: bool = True, chains: tuple[int, ...] = ()) -> Iterator[list[int]]:
    """Paths with the same ends that are shorter by their edges, the best first: stretches reversed, and chains of stops moved, either way round.

    What a move changes is reckoned for all moves at once from the edges it cuts and makes; d needn't be symmetric.
    """
    m = len(path)
    if m < 4:
        return
    with np.errstate(invalid="ignore"):
        c = d[np.ix_(path, path)]
        ahead, back = c.diagonal(1), c.diagonal(-1)
        turned = np.concatenate([[0.0], np.cumsum(back - ahead)])  # what reversing 0..j adds inside
        found = []
        if reversals:
            i, j = np.triu_indices(m - 2, 1)
            i, j = i + 1, j + 1
            change = c[i - 1, j] + c[i, j + 1] - ahead[i - 1] - ahead[j] + turned[j] - turned[i]
            found += [(change, np.zeros_like(i), i, j, np.zeros_like(i))]
        k = np.arange(m - 1)
        for size in chains:
            i = np.arange(1, m - size)
            if not len(i):
                continue
            last = i + size - 1
            gone = (ahead[i - 1] + ahead[last] - c[i - 1, last + 1])[:, None] + ahead[None]
            inside = (k[None] >= i[:, None] - 1) & (k[None] <= last[:, None])
            ways = (c[:, i].T[:, :-1] + c[last, 1:], c[:, last].T[:, :-1] + c[i, 1:] + (turned[last] - turned[i])[:, None])
            for way, made in enumerate(ways):
                change = np.where(inside, np.inf, made - gone)
                found += [(change.ravel(), np.full(change.size, size), np.repeat(i, m - 1), np.tile(k, len(i)), np.full(change.size, way))]
    if not found:
        return
    change, size, i, j, way = (np.concatenate(x) for x in zip(*found, strict=True))
    good = np.flatnonzero(change < -1e-9)
    for x in good[np.argsort(change[good], kind="stable")]:
        s, a, b = int(size[x]), int(i[x]), int(j[x])
        if s == 0:
            yield path[:a] + path[a : b + 1][::-1] + path[b + 1 :]
        else:
            chain, rest = path[a : a + s], path[:a] + path[a + s :]
            at = b + 1 if b < a else b + 1 - s
            yield rest[:at] + (chain[::-1] if way[x] else chain) + rest[at:]


def improve_tour(order: list[int], d: np.ndarray, rounds: int = 4096, until: float | None = None) -> list[int]:
    """Variable neighbourhood descent: the best reversal, and the best move of a chain of one to three stops, until neither helps.

    Raises TimeoutError beyond ``until`` on the monotonic clock.
    """
    best, length = list(order), tour_length(order, d)
    for _ in range(rounds):
        if until is not None and time.monotonic() > until:
            raise TimeoutError("the search took too long")
        for moves in ({"reversals": True}, {"reversals": False, "chains": (1, 2, 3)}):
            new = next((p[:-1] for p in shorter_paths(best + best[:1], d, **moves) if tour_length(p[:-1], d) < length - 1e-9), None)
            if new is not None:
                best, length = new, tour_length(new, d)
                break
        else:
            break
    return best


def solve_tour(d: np.ndarray, start: int = 0) -> tuple[list[int], float]:
    if len(d) == 0:
        return [], 0.0
    order = improve_tour(nearest_first(d, start), d)
    return order, tour_length(order, d)


TOUR_FACTOR = 1.4  # from straight lines to walking


def estimate_length(d: np.ndarray) -> float:
    if len(d) < 2:
        return 0.0
    return TOUR_FACTOR * (2 * float(d[0, 1]) if len(d) == 2 else solve_tour(d)[1])


# ---- orienteering ----------------------------------------------------------------------------------------------------


#: Of the exchanges of a round that help, as many are followed up; the next round looks at all exchanges again.
TRIES = 8


@dataclass
class Problem:
    """Stops with prizes between a start and an end, within a budget of seconds."""

    prize: list[float]
    visit: list[float]
    travel: np.ndarray
    from_start: list[float]
    to_end: list[float]
    start_to_end: float
    budget: float
    types: list[str] = field(default_factory=list)
    adventure: list[str | None] = field(default_factory=list)
    sequence: list[int | None] = field(default_factory=list)
    sequential: list[bool] = field(default_factory=list)
    keep_together: bool = False
    variety_weight: float = 0.0
    interleave: bool = True

    @cached_property
    def ways(self) -> np.ndarray:
        """Seconds between all stops, the start (row n) and the end (column n + 1)."""
        n = len(self.prize)
        w = np.full((n + 2, n + 2), np.inf)
        w[:n, :n], w[n, :n], w[:n, n + 1], w[n, n + 1] = self.travel, self.from_start, self.to_end, self.start_to_end
        return w

    def units(self) -> list[list[int]]:
        """What is inserted and removed at once: whole adventures where they stay together, else single stops."""
        if not self.keep_together or not self.adventure:
            return [[i] for i in range(len(self.prize))]
        groups: dict[str, list[int]] = {}
        out = []
        for i, a in enumerate(self.adventure):
            if a is None:
                out.append([i])
            else:
                groups.setdefault(a, []).append(i)
        for g in groups.values():
            if self.sequence:
                g.sort(key=lambda i: (self.sequence[i] if self.sequence[i] is not None else 1 << 30, i))
            out.append(g)
        return sorted(out)


def path_seconds(order: list[int], p: Problem) -> float:
    n = len(p.prize)
    path = [n, *order, n + 1]
    return float(p.ways[path[:-1], path[1:]].sum() + sum(p.visit[i] for i in order))


def path_score(order: list[int], p: Problem) -> float:
    """Prizes; with a variety weight, each type's k-th best (from 0) counts 1 / (1 + k * weight / 2), in whatever order they are visited."""
    if not p.variety_weight or not p.types:
        return float(sum(p.prize[i] for i in order))
    kinds = {p.types[i] for i in order}
    best = [sorted((p.prize[i] for i in order if p.types[i] == t), reverse=True) for t in sorted(kinds)]
    return float(sum(x / (1 + k * p.variety_weight / 2) for prizes in best for k, x in enumerate(prizes)))


def keeps_rules(order: list[int], p: Problem) -> bool:
    """Stages in order where that counts, adventures in one piece where they don't interleave, and whole where they stay together."""
    if len(set(order)) != len(order):
        return False
    if not p.adventure:
        return True
    places: dict[str, list[int]] = {}
    for k, i in enumerate(order):
        if p.adventure[i] is not None:
            places.setdefault(p.adventure[i], []).append(k)
    for own in places.values():
        if not p.interleave and own[-1] - own[0] != len(own) - 1:
            return False
        if p.sequential:
            stages = [p.sequence[order[k]] for k in own if p.sequential[order[k]] and p.sequence[order[k]] is not None]
            if stages != sorted(stages):
                return False
    return not p.keep_together or all(len(places.get(a, ())) in (0, n) for a, n in Counter(a for a in p.adventure if a is not None).items())


def valid(order: list[int], p: Problem) -> bool:
    """Within the budget, and by the rules of adventures."""
    return path_seconds(order, p) <= p.budget + 1e-9 and keeps_rules(order, p)


def shorten(order: list[int], p: Problem) -> list[int]:
    """Reversals and single moves that cut seconds and keep the rules."""
    n = len(p.prize)
    best, value = list(order), path_seconds(order, p)
    for _ in range(50):
        for path in shorter_paths([n, *best, n + 1], p.ways, chains=(1,)):
            new = path[1:-1]
            if path_seconds(new, p) < value - 1e-9 and keeps_rules(new, p):
                best, value = new, path_seconds(new, p)
                break
        else:
            break
    return best


def _insert(order: list[int], unit: list[int], p: Problem) -> list[int] | None:
    """The cheapest valid way to take a unit in: its stops next to each other, or each where it costs least (a fixed order of stages kept)."""
    n = len(p.prize)
    left = p.budget + 1e-9 - path_seconds(order, p) - sum(p.visit[i] for i in unit)
    path = np.array([n, *order, n + 1])
    skipped = p.ways[path[:-1], path[1:]]
    ordered = bool(p.sequential and p.sequential[unit[0]])
    found = []
    for u in [unit] if len(unit) == 1 or ordered else [unit, unit[::-1]]:
        inner = sum(p.ways[a, b] for a, b in zip(u, u[1:], strict=False))
        cost = p.ways[path[:-1], u[0]] + p.ways[u[-1], path[1:]] - skipped + inner
        for k in np.argsort(cost, kind="stable"):
            if not cost[k] <= left:
                break
            new = order[:k] + u + order[k:]
            if keeps_rules(new, p):
                found.append((float(cost[k]), new))
                break
    if len(unit) > 1 and p.interleave:
        new, first = list(order), 0
        for i in unit:
            path = np.array([n, *new, n + 1])[first:]
            k = first + int(np.argmin(p.ways[path[:-1], i] + p.ways[i, path[1:]] - p.ways[path[:-1], path[1:]]))
            new.insert(k, i)
            first = k + 1 if ordered else 0
        cost = path_seconds(new, p) - path_seconds(order, p) - sum(p.visit[i] for i in unit)
        if cost <= left and keeps_rules(new, p):
            found.append((cost, new))
    return min(found)[1] if found else None


def solve_orienteering(p: Problem, first: list[int] | None = None, rounds: int = 50) -> list[int]:
    """Greedy by gain for each second, then shortening, insertions and exchanges of units while the score grows, or the seconds shrink at the same score."""
    units = p.units()

    def worth(order: list[int]) -> tuple[float, float]:
        return round(path_score(order, p), 9), -round(path_seconds(order, p), 6)

    def greedy(order: list[int]) -> list[int]:
        while True:
            best, value = None, 0.0
            score, seconds = path_score(order, p), path_seconds(order, p)
            for u in units:
                if u[0] not in order and (new := _insert(order, u, p)) is not None:
                    gain = path_score(new, p) - score
                    rate = gain / max(1.0, path_seconds(new, p) - seconds)
                    if gain > 0 and rate > value:
                        best, value = new, rate
            if best is None:
                return order
            order = best

    best = greedy(shorten(repair(list(first or []), p), p))
    for _ in range(rounds):
        best = greedy(shorten(best, p))
        swaps = []
        for out in units:
            if out[0] in best:
                rest = shorten([i for i in best if i not in out], p)
                # what else fits there, the more worthwhile of two first; the same unit may come back elsewhere
                swaps += [new for u in units if u[0] not in best or u == out if (new := _insert(rest, u, p)) is not None]
        better = sorted((s for s in swaps if worth(s) > worth(best)), key=worth, reverse=True)[:TRIES]
        grown = max((greedy(shorten(s, p)) for s in better), key=worth, default=best)
        if worth(grown) <= worth(best):
            break
        best = grown
    return best


def repair(order: list[int], p: Problem) -> list[int]:
    """Drops the unit with the least score for each second until the path is valid."""
    while order and not valid(order, p):
        inside = [u for u in p.units() if set(u) & set(order)]

        def worth(u: list[int]) -> tuple[float, int]:
            rest = [i for i in order if i not in u]
            saved = path_seconds(order, p) - path_seconds(rest, p)
            return (path_score(order, p) - path_score(rest, p)) / max(1e-9, saved), u[0]

        gone = min(inside, key=worth)
        order = [i for i in order if i not in gone]
    return order


# ---- closed tours with a start -------------------------------------------------------------------------------------------


def closed_length(order: list[int], d: np.ndarray, out: np.ndarray, back: np.ndarray) -> float:
    if not order:
        return 0.0
    return float(out[order[0]]) + tour_length(order, d, closed=False) + float(back[order[-1]])


def insert_parking(order: list[int], out: np.ndarray, back: np.ndarray, d: np.ndarray) -> tuple[list[int], float]:
    """The cycle turned so that it starts behind the edge where the start fits best (the first of several), and what that adds."""
    n = len(order)
    if n == 0:
        return [], 0.0
    cost = [float(out[order[k]] + back[order[k - 1]] - (d[order[k - 1], order[k]] if n > 1 else 0.0)) for k in range(n)]
    k = int(np.argmin(cost))
    return order[k:] + order[:k], cost[k]


def marginal(order: list[int], k: int, d: np.ndarray, out: np.ndarray, back: np.ndarray) -> float:
    """What a stop adds to a closed tour."""
    v = order[k]
    a = out[v] if k == 0 else d[order[k - 1], v]
    b = back[v] if k == len(order) - 1 else d[v, order[k + 1]]
    if len(order) == 1:
        skip = 0.0
    elif k == 0:
        skip = out[order[1]]
    elif k == len(order) - 1:
        skip = back[order[k - 1]]
    else:
        skip = d[order[k - 1], order[k + 1]]
    return float(a + b - skip)


def trim_to_budget(order: list[int], d: np.ndarray, out: np.ndarray, back: np.ndarray, budget_m: float, budget_s: float | None = None, visit_s: float = 0.0,
                   mps: float = 1.4, most_link: float = 0.0, again: Callable[[list[int]], list[int]] | None = None) -> tuple[list[int], list[tuple[int, str]]]:
    """Drops the stop that adds most until the tour fits; then outliers that add more than twice the longest link.  (order, [(stop, reason)])."""
    order, dropped = list(order), []

    def over() -> str | None:
        length = closed_length(order, d, out, back)
        if length > budget_m:
            return "distance-budget"
        if budget_s is not None and length / mps + visit_s * len(order) > budget_s:
            return "time-budget"
        return None

    while order and (why := over()):
        k = max(range(len(order)), key=lambda k: (marginal(order, k, d, out, back), -order[k]))
        dropped.append((order.pop(k), why))
        if again and len(order) > 2:
            order = again(order)
    while most_link and len(order) > 1:
        k = max(range(len(order)), key=lambda k: (marginal(order, k, d, out, back), -order[k]))
        if marginal(order, k, d, out, back) <= 2 * most_link:
            break
        dropped.append((order.pop(k), "outlier"))
    return order, dropped


# ---- grouped forms -----------------------------------------------------------------------------------------------------


def matrix_of(pdf: pd.DataFrame, value: str = "meters") -> np.ndarray:
    n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
    m = np.full((n, n), np.nan)
    m[pdf["i"].to_numpy(), pdf["j"].to_numpy()] = pdf[value].to_numpy(dtype=float)
    np.fill_diagonal(m, 0)
    return m


def close_matrices(matrix: DataFrame, most_link: float) -> DataFrame:
    """(instance, i, j, meters) with gaps filled where links lead there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = metric_closure(matrix_of(pdf), most_link)
        i, j = np.meshgrid(range(len(m)), range(len(m)), indexing="ij")
        return pd.DataFrame({"instance": pdf["instance"].iloc[0], "i": i.ravel(), "j": j.ravel(), "meters": m.ravel()})

    return matrix.groupBy("instance").applyInPandas(run, "instance long, i int, j int, meters double")


def solve_tours(matrix: DataFrame) -> DataFrame:
    """(instance, seq, stop, total_m) of a short closed tour from stop 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.nan_to_num(matrix_of(pdf), nan=1e12)
        order, total = solve_tour(m)
        return pd.DataFrame({"instance": pdf["instance"].iloc[0], "seq": range(len(order)), "stop": order, "total_m": total})

    return matrix.groupBy("instance").applyInPandas(run, "instance long, seq int, stop int, total_m double")


def solver_plans(matrix: DataFrame, limit_s: float = 10.0) -> DataFrame:
    """(instance, status, detail, seq, stop, total_m): a closed tour from stop 0 for each request; "unavailable", with the reason and no stops, where the search fails or takes too long.

    A request that fails isn't solved in another way instead, and doesn't stop the others.
    """
    schema = "instance long, status string, detail string, seq int, stop int, total_m double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["instance"].iloc[0]
        try:
            m = matrix_of(pdf)
            if not np.isfinite(m).all():
                raise ValueError("no way between some stops")
            order = improve_tour(nearest_first(m, 0), m, until=time.monotonic() + limit_s)
        except (ValueError, TimeoutError) as problem:
            return pd.DataFrame({"instance": [one], "status": ["unavailable"], "detail": [str(problem)], "seq": [None], "stop": [None], "total_m": [None]})
        return pd.DataFrame({"instance": one, "status": "ok", "detail": None, "seq": range(len(order)), "stop": order, "total_m": tour_length(order, m)})

    return matrix.groupBy("instance").applyInPandas(run, schema)


def _problem(own: pd.DataFrame, cells: pd.DataFrame, start_to_end: float, budget_s: float, **rules) -> Problem:
    none = lambda x: None if x is None or x != x else x
    m = np.nan_to_num(matrix_of(cells), nan=1e12) if len(cells) else np.zeros((len(own), len(own)))
    return Problem(own["prize"].tolist(), own["visit_seconds"].tolist(), m, own["from_start"].tolist(), own["to_end"].tolist(), start_to_end, budget_s,
                   own["type"].tolist(), [none(a) for a in own["adventure_id"]], [None] * len(own), [False] * len(own), **rules)


def _with_cells(nodes: DataFrame, matrix: DataFrame):
    # both sides may come from one table, so the matrix gets names of its own
    cells = matrix.select(F.col("instance").alias("of"), F.col("i").alias("i"), F.col("j").alias("j"), F.col("meters").alias("meters"))
    return nodes.groupBy("instance").cogroup(cells.groupBy("of"))


def solve_orienteerings(nodes: DataFrame, matrix: DataFrame, budget_s: float, start_to_end: float, keep_together: bool = False, variety_weight: float = 0.0, interleave: bool = True) -> DataFrame:
    """(instance, seq, stop, score, seconds).  nodes: instance, i, prize, visit_seconds, type, adventure_id, from_start, to_end; matrix in seconds."""

    def run(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"instance": [], "seq": [], "stop": [], "score": [], "seconds": []})
        own = own.sort_values("i")
        p = _problem(own, cells, start_to_end, budget_s, keep_together=keep_together, variety_weight=variety_weight, interleave=interleave)
        order = solve_orienteering(p)
        return pd.DataFrame({"instance": own["instance"].iloc[0], "seq": range(len(order)), "stop": order, "score": path_score(order, p), "seconds": path_seconds(order, p)})

    return _with_cells(nodes, matrix).applyInPandas(run, "instance long, seq int, stop int, score double, seconds double")


def evaluate_paths(nodes: DataFrame, matrix: DataFrame, budget_s: float, start_to_end: float, keep_together: bool = False, variety_weight: float = 0.0, interleave: bool = True) -> DataFrame:
    """(instance, score, seconds, feasible, valid) of each instance's path through the nodes with a ``seq``, in its order; columns as for solving."""

    def run(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"instance": [], "score": [], "seconds": [], "feasible": [], "valid": []})
        own = own.sort_values("i").reset_index(drop=True)
        p = _problem(own, cells, start_to_end, budget_s, keep_together=keep_together, variety_weight=variety_weight, interleave=interleave)
        order = own[own["seq"].notna()].sort_values("seq").index.tolist()
        seconds = path_seconds(order, p)
        return pd.DataFrame({"instance": own["instance"].iloc[:1], "score": [path_score(order, p)], "seconds": [seconds], "feasible": [seconds <= budget_s + 1e-9], "valid": [keeps_rules(order, p)]})

    return _with_cells(nodes, matrix).applyInPandas(run, "instance long, score double, seconds double, feasible boolean, valid boolean")
