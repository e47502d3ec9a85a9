"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Fit: a tree with ``leaves`` leaves, by default 4 * sqrt(rows), over a sample of FIT_PER_LEAF vectors a leaf, at most FIT_ROWS in all (those of the smallest
hash of the id; a fixed bound, so leaves are at most FIT_ROWS / FIT_PER_LEAF). For inner products every vector gets one
more coordinate, sqrt(M*M - |x|*|x|) with M the largest norm, and a query a zero there: the nearest by distance are then those of the largest
product. Index: every row goes to one leaf. Search: a priority queue holds tree nodes by the query's distance to their
centres; the best is opened, its children queued, until ``visits`` leaves are reached and they hold k candidates. Calibration: for at
most CALIBRATE queries (a fixed bound) the true neighbours among all rows are found by brute force, and
the visits are widened until their mean recall reaches ``recall``; the search then visits SPARE times as many.

A query's FIRST leaves give it a k-th best score; the others return only what reaches that. Rows and queries of a leaf are cut into
blocks of at most BLOCK each, so a vector that a third of the rows share
costs many small groups, not a large one. A matrix product picks the rows that can be among the k best, within its error; their scores are
sums in double precision over the coordinates in order, so equal vectors score equally, and ties go to the smaller id.

Defined cases: vectors that are null or zero, hold null or non-finite numbers, or differ in length from most of the rows (ties: the shorter length) take
no part, as query or as candidate, and neither do rows without id. Rows that repeat an id are candidates each; as a query an id asks
once, with the smallest of its vectors, and never meets rows of its own id.
With fewer candidates than k all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, Window as W

from .common import checkpointed, read

FIT_ROWS, FIT_PER_LEAF, BRANCH = 100_000, 16, 16
CALIBRATE, RECALL, SPARE, FIRST, BLOCK = 200, 0.95, 1.05, 8, 4096
K, EVERY = 20, 20


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>): the rows that take part, but for their length."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull()).filter(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vec"))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed over the coordinates in order."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * rows[:, d]
    return out


def best(who: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query by (-score, id), none of its own id: places of queries and of rows, scores. least: lower scores aren't wanted."""
    found = []
    for at in range(0, len(queries), 256):
        q, own = queries[at : at + 256], ids == who[at : at + 256, None]
        rough = np.where(own, -np.inf, q @ rows.T)
        slack = 1e-12 * q.shape[1] * np.sqrt(np.square(q).sum(axis=1) * np.square(rows).sum(axis=1).max(initial=0))
        low = np.full(len(q), -np.inf) if least is None else least[at : at + 256]
        if least is None and rough.shape[1] > k:
            low = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
        i, j = np.nonzero((rough >= (low - slack)[:, None]) & ~own)
        score = np.concatenate([scores(q[i[x : x + 50_000]], rows[j[x : x + 50_000]]) for x in range(0, len(i), 50_000)]) if len(i) else np.zeros(0)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        near = rank < k
        found.append((i[near] + at, j[near], score[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class Tree:
    """Centres by node; children[n] are node numbers, leaf[n] the leaf's number or -1."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf, self.leaves = [sample.mean(axis=0)], [[]], [-1], 1
        heap, at = [(-len(sample), 0, sample)], 1
        while heap and self.leaves < leaves:
            size, node, rows = heapq.heappop(heap)
            kinds = min(branch, leaves - self.leaves + 1, -size)
            centres, labels = self._split(rows, kinds, rng) if kinds > 1 else (None, None)
            if centres is None or len(centres) < 2:
                continue
            self.leaves += len(centres) - 1
            for c in range(len(centres)):
                self.centres.append(centres[c])
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(at)
                heapq.heappush(heap, (-int((labels == c).sum()), at, rows[labels == c]))
                at += 1
        self.centres = np.array(self.centres)
        self.leaves = 0
        for n, kids in enumerate(self.children):
            if not kids:
                self.leaf[n] = self.leaves
                self.leaves += 1

    @staticmethod
    def _split(rows: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(rows, axis=0)
        centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        labels = np.zeros(len(rows), int)
        for _ in range(12):
            labels = (np.square(centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
            used = np.unique(labels)
            centres, labels = np.stack([rows[labels == c].mean(axis=0) for c in used]), np.searchsorted(used, labels)
        return centres, labels

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.square(self.centres).sum(axis=1) - 2 * x @ self.centres.T

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest child."""
        far, leaf = self.distances(x), np.array(self.leaf)
        node = np.zeros(len(x), int)
        while len(todo := np.flatnonzero(leaf[node] < 0)):
            for n in np.unique(node[todo]):
                here, kids = todo[node[todo] == n], np.array(self.children[n])
                node[here] = kids[far[np.ix_(here, kids)].argmin(axis=1)]
        return leaf[node]

    def search(self, far: np.ndarray, visits: int, sizes: np.ndarray | None = None, need: int = 0) -> list[int]:
        """Leaves in best-bin-first order; far: the query's distances to all nodes. At least visits, and such as hold need rows."""
        heap, out, rows = [(0.0, 0)], [], 0
        while heap and (len(out) < visits or rows < need):
            _, n = heapq.heappop(heap)
            if self.leaf[n] >= 0:
                out.append(self.leaf[n])
                rows += sizes[self.leaf[n]] if sizes is not None else 0
            for c in self.children[n]:
                heapq.heappush(heap, (far[c], c))
        return out


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    rows = list(column)
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - np.square(x).sum(axis=1), 0))[:, None]])


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, leaves: int | None = None, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where the column expression is_query(id) holds."""
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, id_col, vec_col))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, longest = rows.filter(F.size("vec") == sizes["d"]), float(np.sqrt(sizes["sq"]))
    wanted = max(1, min(leaves or int(4 * np.sqrt(sizes["n"])), min(fit_rows, sizes["n"]) // FIT_PER_LEAF))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(wanted * FIT_PER_LEAF).select("vec").toArrow()
    tree = spark.sparkContext.broadcast(Tree(_lifted(_matrix(sample.column(0).combine_chunks()), longest), wanted))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                leaf = tree.value.assign(_lifted(_matrix(part.column(1)), longest))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(leaf, pa.int32())], names=["id", "vec", "leaf"])

    index = checkpointed(rows.mapInArrow(place, "id long, vec array<double>, leaf int"))
    queries = index.filter(is_query(F.col("id"))).groupBy(F.col("id").alias("q")).agg(F.min("vec").alias("qvec"), F.count(F.lit(1)).alias("own"))
    visits = _calibrate(index, queries, tree, k, recall)
    held = np.zeros(tree.value.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # a row a leaf
        held[r["leaf"]] = r["count"]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = _matrix(part.column(1))
                far = tree.value.distances(np.hstack([x, np.zeros((len(x), 1))]))
                met = [tree.value.search(f, visits, held, k + own) for f, own in zip(far, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(met, pa.list_(pa.int32()))], names=["q", "qvec", "met"])

    routed = checkpointed(queries.mapInArrow(route, "q long, qvec array<double>, met array<int>"))
    asked = routed.select("q", "qvec", F.lit(None).cast("double").alias("least"), F.explode(F.slice("met", 1, FIRST)).alias("leaf"))
    first = checkpointed(_meet(index, asked, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    least = first.select("query_id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("least"))
    rest = routed.filter(F.size("met") > FIRST).join(least, "q", "left").select("q", "qvec", "least", F.explode(F.slice("met", FIRST + 1, tree.value.leaves)).alias("leaf"))
    near = first.unionByName(_meet(index, rest, k))
    return near.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _meet(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query (q, qvec, least) in each block of each leaf that it visits."""
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))  # noqa: E731  a row a leaf, and leaves are bounded
    grid = F.broadcast(blocks(index.select("leaf"), "nx").join(blocks(asked.select("leaf"), "ny"), "leaf"))
    x = index.join(grid, "leaf").select("leaf", "id", "vec", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "nx").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"))
    y = asked.join(grid, "leaf").select("leaf", "q", "qvec", "least", F.pmod(F.xxhash64("q"), "ny").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"))

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids, who, least = rows["id"].to_numpy(), asks["q"].to_numpy(), asks["least"].to_numpy(np.float64)
        known = np.isfinite(least)
        out = []
        for some in (known, ~known):
            if some.any():
                i, j, score = best(who[some], _matrix(asks["qvec"][some]), ids, _matrix(rows["vec"]), k, least[some] if some is known else None)
                out.append(pd.DataFrame({"query_id": who[some][i], "vec_id": ids[j], "score": score}))
        return pd.concat(out)

    return x.groupBy("leaf", "x", "y").cogroup(y.groupBy("leaf", "x", "y")).applyInPandas(meet, "query_id long, vec_id long, score double")


def _calibrate(index: DataFrame, queries: DataFrame, tree, k: int, recall: float) -> int:
    """How many leaves to visit; brute force for at most CALIBRATE queries against all rows."""
    # Checkpointed, as a limit that is collected directly sends so many rows of every partition to the driver.
    picked = checkpointed(queries.select("q", "qvec").orderBy(F.xxhash64("q"), "q").limit(CALIBRATE)).collect()
    if not picked:
        return 1
    qs, qm = np.array([r["q"] for r in picked]), _matrix([r["qvec"] for r in picked])
    shared = index.sparkSession.sparkContext.broadcast((qs, qm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, ask = shared.value
        held = np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)  # query, score, id, leaf
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, leaf = part.column(0).to_numpy(), part.column(2).to_numpy()
                i, j, s = best(who, ask, ids, _matrix(part.column(1)), k)
                i, s, v, where = (np.concatenate(x) for x in zip(held, (i, s, ids[j], leaf[j])))
                order = np.lexsort((v, -s, i))
                order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
                held = i[order], s[order], v[order], where[order]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], names=["i", "s", "v", "leaf"])

    order = W.partitionBy("i").orderBy(F.desc("s"), "v")
    truth = index.mapInArrow(run, "i int, s double, v long, leaf int").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("i", "leaf").collect()
    leaves: dict[int, list[int]] = {}
    for r in truth:  # at most CALIBRATE * k rows
        leaves.setdefault(r["i"], []).append(r["leaf"])
    t = tree.value
    found = np.zeros(t.leaves)
    for i, far in enumerate(t.distances(np.hstack([qm, np.zeros((len(qm), 1))]))):
        place = {leaf: n for n, leaf in enumerate(t.search(far, t.leaves))}
        for leaf in leaves.get(i, []):
            found[place[leaf]] += 1
    need = recall * max(found.sum(), 1)
    visits = int(np.searchsorted(np.cumsum(found), need)) + 1
    return min(t.leaves, int(np.ceil(visits * SPARE)))


def op10_vector_tree(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)
