"""Candidates of one partition, and the whole search of one run, in arrays inside of a task.

The same moves as in moves, parts and mean_only, for panels whose units one task holds: a sweep is then no Spark job. What
a candidate is worth depends on the clusters that it touches alone, so numbers, cuts and candidates are kept by the units of these
clusters and made once a run, whichever particles and sweeps meet them.

Units are places 0, 1, ... in the order of their ids; a partition has a cluster id for each place, null (NONE) where it lacks the unit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce
from operator import xor

import numpy as np
import pandas as pd

from .compare import _cuts, spectral_part, spectral_vectors
from .kernel import cluster_numbers, precision_of
from .parts import narrow, wide_down, wide_up
from .trial import TURN, Prior, log_posterior, mark, turns

#: The cluster of units that a partition lacks; candidates that a run's search keeps.
NONE, KEPT = np.iinfo(np.int64).min, 200_000


class Graph:
    """Units, ascending, and the places of each one's neighbours; neighbours that are not among the units are left out."""

    def __init__(self, units: Iterable[int], near: Iterable):
        self.units = np.asarray(units, np.int64)
        place = {int(u): i for i, u in enumerate(self.units)}
        self.ids = self.units.tolist()
        self.near = [sorted({place[int(v)] for v in (other if other is not None else ()) if int(v) in place} - {i}) for i, other in enumerate(near)]

    def matrix(self, at: list[int]) -> np.ndarray:
        """Adjacency among some places."""
        own = {p: i for i, p in enumerate(at)}
        a = np.zeros((len(at), len(at)))
        for i, p in enumerate(at):
            for q in self.near[p]:
                if q in own:
                    a[i, own[q]] = 1.0
        return a

    def pieces(self, at: list[int], part: list[int]) -> list[int]:
        """Minus the least unit of each place's component within its part; places ascend."""
        left, label = dict(zip(at, part)), {}
        for i in at:
            if i in left:
                own, todo, name = left.pop(i), [i], -self.ids[i]
                label[i] = name
                while todo:
                    for k in self.near[todo.pop()]:
                        if left.get(k, NONE) == own:
                            del left[k]
                            label[k] = name
                            todo.append(k)
        return [label[i] for i in at]


class Partition:
    """Clusters of places, with what touches them. value: by place, NaN where there is none."""

    def __init__(self, graph: Graph, label: np.ndarray):
        self.graph, self.label = graph, label.tolist()
        self.clusters: dict[int, list[int]] = {}
        for i, c in enumerate(self.label):
            if c != NONE:
                self.clusters.setdefault(c, []).append(i)
        self.outside = [{self.label[k] for k in near} - {self.label[i], NONE} for i, near in enumerate(graph.near)]

    def adjacent(self, c: int) -> set[int]:
        """The clusters that touch a cluster."""
        return set().union(*(self.outside[i] for i in self.clusters[c]))

    def means(self, value: np.ndarray) -> dict[int, float]:
        """The mean of each cluster that has values."""
        out = {}
        for c, at in self.clusters.items():
            v = value[at]
            v = v[~np.isnan(v)]
            if len(v):
                out[c] = float(v.mean())
        return out

    def nearest(self, at: list[int], label: list[int], value: np.ndarray, means: dict[int, float], has: np.ndarray | None = None) -> dict[int, int]:
        """For each piece of a cut cluster the other cluster that touches it and whose mean is nearest; the least id of equals. has: places with a row of values, by default all; a piece without any has none."""
        pieces: dict[int, list[int]] = {}
        for i, p in zip(at, label):
            pieces.setdefault(p, []).append(i)
        out = {}
        for p, own in pieces.items():
            to = [c for c in set().union(*(self.outside[i] for i in own)) if c in means]
            if to and (has is None or has[own].any()):
                v = value[own]
                v = v[~np.isnan(v)]
                mean = float(v.mean()) if len(v) else math.nan
                out[p] = min((-1.0 if math.isnan(mean) else abs(mean - means[c]), c) for c in to)[1]
        return out

    def joined(self, at: list[int], label: list[int], to: dict[int, int]) -> tuple[list[int], list[int]]:
        """(places, labels) of a cut whose pieces belong to the clusters they join, which it then touches as well."""
        names = {c: -self.graph.ids[self.clusters[c][0]] for c in to.values()}
        rows = [(i, names[to[p]] if p in to else p) for i, p in zip(at, label)]
        rows += [(i, names[c]) for c in names for i in self.clusters[c]]
        rows.sort()
        return [i for i, _ in rows], [p for _, p in rows]


def far(at: list[int], value: np.ndarray, share: float, ids: list[int]) -> list[int]:
    """The ceil(share · n) places of a cluster of over one unit whose value is farthest from its mean; of equals the lower first, those without a value last."""
    if len(at) < 2:
        return []
    v = value[at]
    off = np.abs(v - (v[~np.isnan(v)].mean() if (~np.isnan(v)).any() else np.nan))
    return [at[i] for i in sorted(range(len(at)), key=lambda i: (-off[i] if off[i] == off[i] else math.inf, ids[at[i]]))[: math.ceil(len(at) * share)]]


def local_islands(graph: Graph, label: np.ndarray, value: np.ndarray, has: np.ndarray) -> Iterable[tuple[str, list[int], list[int]]]:
    """mean_only.local_candidates of one partition: (name, places, labels), one after the other."""
    whole = Partition(graph, label)
    means = whole.means(value)
    for at in whole.clusters.values():
        for alone in far([i for i in at if has[i]], value, 1.0, graph.ids):
            name = f"island:{graph.ids[alone]}"
            cut = graph.pieces(at, [int(i == alone) for i in at])
            yield name, at, cut
            to = whole.nearest(at, cut, value, means, has)
            if to:
                yield (f"{name}>>all", *whole.joined(at, cut, to))


class Run:
    """What does not change in the search of one run, and what it has learnt of clusters. sides: side -> ((b, w) by term and place, ((c1, c2) by term)); values: side -> least squares by place."""

    def __init__(self, graph: Graph, sides: dict, values: dict[str, np.ndarray], law: pd.Series, prior: Prior, rho: float, levels: bool, families: tuple[str, ...]):
        self.graph, self.sides, self.values, self.law, self.prior, self.rho, self.levels, self.families = graph, sides, values, law, prior, rho, levels, families
        self.known: dict = {}
        self.kept: dict = {}

    def cluster(self, side: str, at: tuple[int, ...]) -> tuple:
        """(quad, log_det, means, inner prior, mark) of a cluster."""
        if (side, at) not in self.known:
            own = list(at)
            a, (data, laws), quad, det, means = self.graph.matrix(own), self.sides[side], 0.0, 0.0, None
            for (b, w), (c1, c2) in zip(data, laws):
                q, d, mean = cluster_numbers(precision_of(a, self.rho, c1, c2), b[own], w[own])
                quad, det, means = quad + q, det + d, mean if means is None else means
            units = self.graph.units[own]
            self.known[side, at] = quad, det, means, self.prior.inner(len(own)), mark(units, np.full(len(own), units[0]))
        return self.known[side, at]

    def numbers(self, side: str, news: list[tuple], olds: list[tuple]) -> tuple:
        """The differences SUMS of clusters that take the place of others."""
        new, old = [self.cluster(side, c) for c in news], [self.cluster(side, c) for c in olds]
        total = lambda i: sum(x[i] for x in new) - sum(x[i] for x in old)
        return total(0), total(1), len(new) - len(old), total(3), reduce(xor, [x[4] for x in new + old], 0)

    def entry(self, side: str, name: str, at: list[int], label: list[int], olds: list[tuple]) -> tuple:
        """(name, new clusters, old clusters, differences)."""
        made: dict[int, list[int]] = {}
        for i, p in zip(at, label):
            made.setdefault(p, []).append(i)
        news = [tuple(c) for c in made.values()]
        return name, news, olds, self.numbers(side, news, olds)

    def _kept(self, key: tuple, make: Callable[[], object]):
        if key not in self.kept:
            if len(self.kept) > KEPT:
                self.kept.clear()
            self.kept[key] = make()
        return self.kept[key]

    def _classes(self, name: str, at: list[int], v: np.ndarray, most: Callable[[int], int], kmeans: bool) -> list[tuple[str, list[int], list[int]]]:
        """Parts of a cluster in its best or its spectral classes: (name, places, part)."""
        there = [(i, x) for i, x in zip(at, v.tolist()) if x == x]
        own, v = [i for i, _ in there], np.array([x for _, x in there])
        if kmeans:
            if len(own) < 3 or not v.max() > v.min():
                return []
            order = np.lexsort((own, v))
            made = _cuts(v[order], min(most(len(own)), len(own) - 1))
            part = np.empty(len(own), int)
            out = []
            for k, starts in enumerate(made, 1):
                if k > 1:
                    part[order] = np.searchsorted(starts, np.arange(len(own)), side="right")
                    out.append((f"{name}:{k}", own, part.tolist()))
            return out
        ks = [k for k in range(2, most(len(own)) + 1) if k < len(own)] if len(own) > 1 and v.var() > 0 else []
        if not ks:
            return []
        found = spectral_vectors(np.array(own), v, [self.graph.near[i] for i in own])
        return [(f"{name}:{k}", own, spectral_part(found[:, :k], k).tolist()) for k in ks]

    def _inner(self, side: str, c: int, at: list[int], share: float | None) -> list[tuple]:
        """Candidates that touch a single cluster: (entry, places, labels, peeled pieces or None). share: islands alone, of this share."""
        ids, means, values = self.graph.ids, self.cluster(side, tuple(at))[2], self.values[side][at]
        n, out = len(at), []
        by = sorted(range(n), key=lambda i: (means[i], at[i]))
        down = sorted(range(n), key=lambda i: (-means[i], at[i]))
        alone = lambda i: (f"island:{ids[at[i]]}", at, [int(j == i) for j in range(n)], None)
        if self.levels:
            value = np.full(len(ids), np.nan)
            value[at] = means
            out += [alone(at.index(i)) for i in far(at, value, 0.05 if share is None else share, ids)]
            if share is None:
                out += [(*p, None) for p in self._classes(f"spectral:{c}", at, means, wide_up, False) + self._classes(f"kmeans:{c}", at, means, wide_down, True)]
                if n > 1:
                    few = math.ceil(n * 0.025)
                    low, high = set(by[:few]), set(by[n - few :])
                    for end, part in (("left", [int(j in low) for j in range(n)]), ("right", [int(j in high) for j in range(n)]), ("both", [int(j in low) + 2 * int(j in high) for j in range(n)])):
                        out.append((f"ends:{c}:{end}", at, part, None))
        else:
            few = math.ceil(n * (0.05 if share is None else share))
            if n > 1 and "island" in self.families:
                out += [alone(i) for i in dict.fromkeys(by[:few] + down[:few])]
            if share is None:
                for kind, v in (("", values), (":now", means)):
                    if "split" in self.families:
                        out += [(f"{name}{kind}", *p, None) for name, *p in self._classes(f"kmeans:{c}", at, v, narrow, True)]
                    if "spectral" in self.families:
                        out += [(f"{name}{kind}", *p, None) for name, *p in self._classes(f"spectral:{c}", at, v, narrow, False)]
                if "tail" in self.families:
                    for end, order in (("left", by), ("right", down)):
                        for size in range(2, math.ceil(n * 0.1) + 1):
                            tail = set(order[:size])
                            out.append((f"tail:{c}:{end}:{size}", at, [int(j in tail) for j in range(n)], tail))
        rows = []
        for name, own, part, tail in out:
            label = self.graph.pieces(own, part)
            peeled = None if tail is None else {p for j, p in enumerate(label) if j in tail}
            rows.append((self.entry(side, name, own, label, [tuple(at)]), own, label, peeled))
        return rows

    def _pairs(self, side: str, whole: Partition, c: int, keys: dict[int, tuple]) -> list[tuple]:
        """Merges with clusters of greater ids, and units of cluster c that go to an adjacent one."""
        out, own = [], whole.clusters[c]
        for d in whole.adjacent(c):
            def made(d: int = d) -> list[tuple]:
                both, rows = sorted(own + whole.clusters[d]), []
                if "merge" in self.families and c < d:
                    rows.append(self.entry(side, f"merge:{c}:{d}", both, self.graph.pieces(both, [1] * len(both)), [keys[c], keys[d]]))
                if "border" in self.families and len(own) > 1:
                    other = set(whole.clusters[d])
                    for i in own:
                        if d in whole.outside[i]:
                            label = self.graph.pieces(both, [int(j == i or j in other) for j in both])
                            rows.append(self.entry(side, f"border:{self.graph.ids[i]}:{d}", both, label, [keys[c], keys[d]]))
                return rows

            out += self._kept((side, "pair", keys[c], keys[d]), made)
        return out

    def _joins(self, side: str, whole: Partition, name: str, at: list[int], label: list[int], to: dict[int, int], old: tuple, keys: dict[int, tuple]) -> tuple:
        """The entry of a cut some of whose pieces join clusters outside."""
        key = (side, name, old, *((p, keys[c]) for p, c in to.items()))
        return self._kept(key, lambda: self.entry(side, name, *whole.joined(at, label, to), [old, *(keys[c] for c in dict.fromkeys(to.values()))]))

    def options(self, side: str, label: np.ndarray, kind: str) -> dict[str, tuple]:
        """All candidates of a partition by name. kind: all, local (levels: every unit as an island), islands (every unit of the model with slopes)."""
        whole = Partition(self.graph, label)
        keys = {c: tuple(at) for c, at in whole.clusters.items()}
        value = np.full(len(self.graph.ids), np.nan)
        for at in keys.values():
            value[list(at)] = self.cluster(side, at)[2]
        means, out = whole.means(value), []
        share = None if kind == "all" else 1.0
        for c, at in whole.clusters.items():
            inner = self._kept((side, kind, keys[c]), lambda c=c, at=at: self._inner(side, c, at, share))
            out += [x[0] for x in inner]
            for (name, *_), own, cut, peeled in inner:
                ways = {} if not self.levels and (name.startswith("island:") or "onward" not in self.families) else whole.nearest(own, cut, value, means)
                if not self.levels:
                    out += [self._joins(side, whole, f"{name}>{p}", own, cut, {p: d}, keys[c], keys) for p, d in ways.items() if peeled is None or p in peeled]
                elif name.startswith("island:"):
                    out += [self._joins(side, whole, f"{name}>>all", own, cut, ways, keys[c], keys)] if ways else []
                else:
                    turn = sorted(ways, reverse=True)
                    out += [self._joins(side, whole, f"{name}>>{i}", own, cut, {p: ways[p] for p in turn[:i]}, keys[c], keys) for i in range(1, len(turn) + 1)]
            if kind == "all" and not self.levels:
                out += self._pairs(side, whole, c, keys)
            elif kind == "all":
                out += self._blocks(side, whole, c, keys, means)
        return {x[0]: x for x in out}

    def _blocks(self, side: str, whole: Partition, c: int, keys: dict[int, tuple], means: dict[int, float]) -> list[tuple]:
        """The nearest merge and the border block of a cluster."""
        near, out = whole.adjacent(c), []
        best = lambda some: min((abs(means[c] - means[d]), d) for d in some)[1]
        if greater := [d for d in near if d > c]:
            d = best(greater)
            both = sorted(keys[c] + keys[d])
            out.append(self.entry(side, f"merge:{c}:{d}", both, self.graph.pieces(both, [1] * len(both)), [keys[c], keys[d]]))
        if near:
            d = best(near)
            takes = {i for i in keys[d] if c in whole.outside[i]}
            if len(takes) < len(keys[d]):
                both, own = sorted(keys[c] + keys[d]), set(keys[c])
                out.append(self.entry(side, f"block:{c}:{d}", both, self.graph.pieces(both, [int(i in own or i in takes) for i in both]), [keys[c], keys[d]]))
        return out


def _weights(sums: pd.DataFrame, sides: str, prior: Prior, law: pd.Series, temper: float) -> dict[int, float]:
    """weights.tempered_weights of one run's particles."""
    own = sums["inner"] + [float(prior.outer(int(k), int(n))) for k, n in zip(sums["k"], sums["units"])]
    by = sums.assign(prior=own).groupby("particle_id")[["quad", "log_det", "prior"]].sum()
    post = log_posterior(by["quad"].to_numpy(), by["log_det"].to_numpy(), by["prior"].to_numpy(), law)
    p = np.exp((post - post.max()) / temper)
    sigs = sums.sort_values("side").groupby("particle_id")["sig"].apply(tuple)
    p = p / sigs.map(sigs.value_counts()).to_numpy()
    return dict(zip(by.index.tolist(), (p / p.sum()).tolist()))


def searched(run: Run, starts: list[tuple[int, str, np.ndarray]], run_id: int, temper: float, most_sweeps: int, last_islands: bool) -> tuple[pd.DataFrame, dict, int, bool]:
    """(sums of the particles, label by (side, signature), sweeps, settled): plans.search.ensemble_fit for one run. starts: particle_id, side, cluster id (its least unit) by place."""
    sides, labels, rows = "".join(sorted({s for _, s, _ in starts})), {}, []
    for particle, side, label in starts:
        keys = [tuple(at) for at in Partition(run.graph, label).clusters.values()]
        quad, det, k, inner, sig = run.numbers(side, keys, [])
        labels[side, sig] = label
        rows.append([run_id, particle, side, quad, det, k, inner, sig, int((label != NONE).sum()), 0.0, run.law.a, run.law.d, run.law.c])
    sums = pd.DataFrame(rows, columns=TURN)
    sums["w"] = 1 / sums["particle_id"].nunique()
    made: dict = {}

    def turn(kind: str) -> bool:
        nonlocal sums, made
        now = set(zip(sums["side"], sums["sig"].tolist()))
        made = {at: x for at, x in made.items() if at[1:] in now}
        tables = []
        for side, sig in sorted(now):
            if (kind, side, sig) not in made:
                options = run.options(side, labels[side, sig], kind)
                table = pd.DataFrame([x[3] for x in options.values()], columns=["quad", "log_det", "k", "inner", "sig"])
                made[kind, side, sig] = options, table.assign(side=side, of=sig, cand=list(options))
            tables.append(made[kind, side, sig][1])
        cands = pd.concat(tables).astype({"quad": float, "log_det": float, "k": int, "inner": float, "sig": np.int64})
        moved = turns(sums, cands, sides, run.prior, temper)
        taken = moved[moved["cand"].notna()]
        for r in taken.itertuples(index=False):
            if (r.side, r.sig) not in labels:
                label = labels[r.side, r.was].copy()
                for at in made[kind, r.side, r.was][0][r.cand][1]:
                    label[list(at)] = run.graph.ids[at[0]]
                labels[r.side, r.sig] = label
        sums = moved[TURN]
        return bool(len(taken))

    def reweighed() -> bool:
        w = sums["particle_id"].map(_weights(sums, sides, run.prior, run.law, temper or 1.0))
        changed = not np.allclose(w, sums["w"], rtol=0, atol=1e-12)
        sums["w"] = w
        return changed

    sweeps, settled = 0, False
    while sweeps < most_sweeps and not settled:
        sweeps += 1
        changed = turn("all")
        if not changed and run.levels:
            changed = turn("local")
        if temper:  # where the first sweep changes nothing, the weights it leaves may still make something better
            changed = reweighed() and sweeps == 1 or changed
        settled = not changed
    if last_islands and not run.levels:
        turn("islands")
        reweighed()
    return sums, labels, sweeps, settled
