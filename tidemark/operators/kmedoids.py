"""Weighted k-medoids over compressed profiles.

Rows are first reduced to their distinct class vectors with weights (levels.compress): at most 3**features points, whatever the input's
size. Distances depend on the vectors alone, so the result is that of all rows. Only those points reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .levels import compress

#: More profiles than this aren't class vectors.
MAX_PROFILES = 4096


@dataclass
class Clustering:
    medoids: list[int]
    labels: np.ndarray
    cost: float
    silhouette: float

    @property
    def k(self) -> int:
        return len(self.medoids)


def manhattan(points: np.ndarray) -> np.ndarray:
    return np.abs(points[:, None, :] - points[None, :, :]).sum(axis=2)


def build(dist: np.ndarray, w: np.ndarray, k: int, slack: float = 1e-12) -> list[int]:
    """Greedy start: each medoid lowers the weighted cost most, the first on a tie."""
    chosen: list[int] = []
    near = np.full(len(w), np.inf)
    for _ in range(k):
        best, at = np.inf, -1
        for c in range(len(w)):
            if c not in chosen and (cost := float((np.minimum(near, dist[c]) * w).sum())) < best - slack:
                best, at = cost, c
        chosen.append(at)
        near = np.minimum(near, dist[at])
    return chosen


def swap(dist: np.ndarray, w: np.ndarray, medoids: list[int], slack: float = 1e-12) -> list[int]:
    """Exchange a medoid for another point while the best exchange lowers the cost."""
    medoids = sorted(medoids)
    cost = float((dist[medoids].min(axis=0) * w).sum())
    while True:
        best, found = cost, None
        for i in range(len(medoids)):
            rest = medoids[:i] + medoids[i + 1 :]
            near = dist[rest].min(axis=0) if rest else np.full(len(w), np.inf)
            for c in range(len(w)):
                if c not in medoids and (new := float((np.minimum(near, dist[c]) * w).sum())) < best - slack:
                    best, found = new, sorted([*rest, c])
        if found is None:
            return medoids
        medoids, cost = found, best


def silhouette(dist: np.ndarray, w: np.ndarray, labels: np.ndarray, lone: float | None = 0.0) -> float:
    """Weighted: a point of weight w stands for w equal ones. lone: the value for a cluster of weight 1 or less; None takes a = 0 there."""
    ks = np.unique(labels)
    if len(ks) < 2:
        return 0.0
    sums = np.stack([(dist * (w * (labels == c))[None, :]).sum(axis=1) for c in ks], axis=1)
    mass = np.array([w[labels == c].sum() for c in ks])
    own = np.searchsorted(ks, labels)
    alone = mass[own] <= 1
    a = np.where(alone, 0.0, sums[np.arange(len(w)), own] / np.where(alone, 1, mass[own] - 1))
    others = sums / mass
    others[np.arange(len(w)), own] = np.inf
    b = others.min(axis=1)
    top = np.maximum(a, b)
    s = np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0)
    if lone is not None:
        s = np.where(alone, lone, s)
    return float((s * w).sum() / w.sum())


def pam(points: np.ndarray, w: np.ndarray, k: int, slack: float = 1e-12) -> Clustering:
    """BUILD, then SWAP; ties go to the lowest index."""
    dist = manhattan(np.asarray(points, float))
    w = np.asarray(w, float)
    medoids = swap(dist, w, build(dist, w, k, slack), slack)
    labels = dist[medoids].argmin(axis=0)
    return Clustering(medoids, labels, float((dist[medoids].min(axis=0) * w).sum()), silhouette(dist, w, labels))


def alternating(points: np.ndarray, w: np.ndarray, k: int, restarts: int = 100, rounds: int = 100, seed: int = 42) -> Clustering:
    """Medoids seeded by weighted k-means++, then assignment and medoid updates in turn; the best of the restarts."""
    dist, w = manhattan(np.asarray(points, float)), np.asarray(w, float)
    rng, best = np.random.default_rng(seed), None
    for _ in range(restarts):
        medoids = [int(rng.choice(len(w), p=w / w.sum()))]
        while len(medoids) < k:
            p = dist[medoids].min(axis=0) ** 2 * w
            medoids.append(int(rng.choice(len(w), p=p / p.sum())) if p.sum() > 0 else int(next(i for i in range(len(w)) if i not in medoids)))
        for _ in range(rounds):
            labels = dist[medoids].argmin(axis=0)
            new = []
            for c in range(k):
                inside = np.flatnonzero(labels == c)
                if len(inside):
                    new.append(int(inside[(dist[np.ix_(inside, inside)] * w[inside][None, :]).sum(axis=1).argmin()]))
                else:  # an empty cluster takes the point farthest from all medoids
                    new.append(int((dist[medoids].min(axis=0) * w).argmax()))
            if new == medoids:
                break
            medoids = new
        cost = float((dist[medoids].min(axis=0) * w).sum())
        if best is None or cost < best[0] - 1e-12:
            best = (cost, medoids)
    labels = dist[best[1]].argmin(axis=0)
    return Clustering(best[1], labels, best[0], silhouette(dist, w, labels, None))


def k_search(points: np.ndarray, w: np.ndarray, ks: Sequence[int], slack: float = 1e-12) -> dict[int, Clustering]:
    return {k: pam(points, w, k, slack) for k in ks if k <= len(w)}


def choose(found: dict[int, Clustering], w: np.ndarray, least_share: float = 0.0) -> Clustering:
    """By silhouette (10 decimals), then lower cost, then smaller k, among those whose smallest cluster has least_share."""
    smallest = lambda c: min(w[c.labels == i].sum() for i in range(c.k)) / w.sum()
    fair = [c for c in found.values() if smallest(c) >= least_share] or list(found.values())
    return max(fair, key=lambda c: (round(c.silhouette, 10), -c.cost / w.sum(), -c.k))


def relabel(points: np.ndarray, found: Clustering) -> np.ndarray:
    """Labels from 1, in the lexicographic order of the medoids."""
    order = sorted(range(found.k), key=lambda i: tuple(points[found.medoids[i]]))
    rank = {c: i + 1 for i, c in enumerate(order)}
    return np.array([rank[c] for c in found.labels])


def cluster_rows(df: DataFrame, features: Sequence[str], ks: Sequence[int], least_share: float = 0.0, weight: DataFrame | None = None) -> DataFrame:
    """df with `cluster`: profiles are clustered on the driver, their labels joined back. weight: profiles with their own weights (column 1)."""
    profiles = (compress(df, features) if weight is None else weight).orderBy(*features).limit(MAX_PROFILES + 1).collect()
    if len(profiles) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles: classify the features first")
    points = np.array([[float(r[f]) for f in features] for r in profiles])
    w = np.array([float(r["weight" if weight is None else "balanced_weight"]) for r in profiles])
    best = choose(k_search(points, w, ks), w, least_share)
    labels = relabel(points, best)
    rows = [(*[r[f] for f in features], int(c)) for r, c in zip(profiles, labels)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    table = df.sparkSession.createDataFrame(rows, ", ".join([*[f"km_{f} {kinds[f]}" for f in features], "cluster int"]))
    same = F.lit(True)
    for f in features:
        same &= F.col(f).eqNullSafe(F.col(f"km_{f}"))
    return df.join(F.broadcast(table), same).drop(*[f"km_{f}" for f in features])
