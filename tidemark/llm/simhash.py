"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two that differ in at most ``radius`` bits link, and so do all that are reachable.
If the bits are dealt to m partitions with thresholds t_i whose (t_i + 1) sum to radius + 1, linked
fingerprints differ by at most t_i in some partition i. Correlated bits go into the same partition, as
they tell less apart, and dynamic programming allots unequal thresholds (-1 leaves a partition
out) for the least expected work: signatures to send and candidates to verify, from the bits'
agreement over all distinct fingerprints. Each fingerprint is sent to the values within t_i of its own;
what meets in a value is verified on all 64 bits.

A fingerprint of several words of 64 bits (``words``) tells similarities apart more finely. With ``similarity``, two texts link if their
fingerprints of WIDE words over distinct shingles of five words differ in no more bits than is usual, plus one standard deviation, for sets of shingles of that Jaccard
similarity: a bit differs with probability acos(2s / (1 + s)) / pi. So many bits can't be covered by thresholds that sum to radius + 1;
instead the dynamic programming allots the least expected work by which a pair at the radius meets in some partition with
probability RECALL, and nearer pairs more often.

Only distinct fingerprints take part, so exact copies never multiply. Within a value a breadth-first
search takes out what it has reached, and emits one link for each member but the first of a component: a
dense group of n near copies costs about n links, never n * n. Values of more than BLOCK fingerprints are
cut into blocks, and every pair of blocks meets in a group of its own. Links are merged by
alternating large-star and small-star steps over checkpointed tables.

Defined cases: ids are longs, and an id column of another type must be convertible to that or the query stops. A text without words (null, empty) has fingerprint zero, which links like any other. Fewer
words than a shingle make one shingle. Rows that repeat a doc_id are fingerprinted each; rows without doc_id
link but lend no name to a component, so a component of such rows alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, checkpointed, read

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
WIDE, WIDE_SHINGLE, RECALL = 8, 5, 0.95
#: Relative work: to send one signature, to verify one candidate pair.
SEND, VERIFY = 1.0, 0.004
#: Fingerprints that one search holds.
BLOCK = 1 << 15
#: Groups of so few are compared pair by pair.
SMALL = 32
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def shingle_digests(text: str | None, shingle: int = SHINGLE) -> bytes:
    """XXH64 of each shingle, big-endian, one after another."""
    import xxhash

    words = (text or "").encode().translate(LOWER_BYTES).split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    if n == 0:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts, ends = [0, *(ends[: n - shingle] + 1).tolist()], ends[shingle - 1 :].tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)])


def _majority(digests: np.ndarray) -> int:
    """digests: the bytes, big-endian, of 64-bit hashes. Bits that are set in over half of them."""
    counts, n = np.zeros(BITS, np.int64), len(digests) // 8
    for i in range(0, n, 1 << 16):
        at = digests[8 * i : 8 * (i + (1 << 16))].reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
        counts += (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned: bit set if more than half of the shingles' XXH64 values have it."""
    return _majority(np.frombuffer(shingle_digests(text, shingle), np.uint8))


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> list[int]:
    """Words of 64 bits each, from the distinct shingles' hashes and further hashes of those."""
    h = np.unique(np.frombuffer(shingle_digests(text, shingle), ">u8").astype(np.uint64))
    out = []
    for k in range(words):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)  # one step of splitmix64, as published
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority((x ^ (x >> np.uint64(31))).astype(">u8").view(np.uint8)))
    return out


def radius_of(similarity: float, bits: int = WIDE * BITS) -> int:
    p = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * p + sqrt(bits * p * (1 - p)))


def _store(v: np.ndarray) -> pa.Array:
    """v: rows of words. One word as a signed long, more as their bytes."""
    if v.shape[1] == 1:
        return pa.array(np.ascontiguousarray(v[:, 0]).view(np.int64))
    at = np.arange(len(v) + 1, dtype=np.int32) * (8 * v.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def _load(column: pa.Array, words: int) -> np.ndarray:
    if words == 1:
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _type(words: int) -> str:
    return "long" if words == 1 else "binary"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, fp (a signed long, or the bytes of several words) and row_hash (of the text), a row for each of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fps = np.array([[fingerprint(t, shingle)] if words == 1 else wide_fingerprint(t, shingle, words) for t in texts], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0), _store(fps), b.column(2)], names=["doc_id", "fp", "row_hash"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(run, f"doc_id long, fp {_type(words)}, row_hash long")


def bit_counts(fps: DataFrame, words: int = 1) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each word how many have bits i and j set both; words x 64 x 64 sums reach the driver."""
    names = [f"b{j}" for j in range(BITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((words, BITS, BITS))
        for b in batches:
            v = _load(b.column(0), words)
            for w in range(words):
                bits = ((v[:, w : w + 1] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                both[w] += bits.T @ bits
            n += len(v)
        if n:
            rows = both.reshape(-1, BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), n)), *map(pa.array, np.ascontiguousarray(rows.T))], names=["k", "n", *names])

    sums = fps.select("fp").mapInArrow(run, "k long, n long, " + ", ".join(f"{x} double" for x in names)).groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).orderBy("k").collect()
    if not sums:
        return 0, np.zeros((words, BITS, BITS))
    return int(sums[0]["n"]), np.array([[r[x] for x in names] for r in sums]).reshape(words, BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows by the bit most correlated with those it has."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        pick = [max(left, key=lambda b: corr[b, left].max())]
        left.remove(pick[0])
        while len(pick) < size:
            pick.append(max(left, key=lambda b: corr[b, pick].mean()))
            left.remove(pick[-1])
        out.append(sorted(pick))
    return out


def expected_pairs(n: int, both: np.ndarray, bits: list[int], radius: int) -> list[float]:
    """Estimated pairs of n fingerprints that differ in at most 0, 1, ... radius of these bits."""
    p = both.diagonal()[bits] / max(n, 1)
    dist = np.array([1.0])
    for q in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - q, q])
    return (np.cumsum(dist)[: radius + 1] * n * n / 2).tolist()


def allot(costs: list[list[float]], gains: list[list[int]], need: int) -> tuple[float, list[int]]:
    """costs[i][t + 1] and gains[i][t + 1] are partition i's at threshold t >= -1; the thresholds of least cost whose gains sum to need or more."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for cost, gain in zip(costs, gains):
        now: list[tuple[float, list[int]]] = [(float("inf"), [])] * (need + 1)
        for had, (spent, limits) in enumerate(best):
            for t in range(len(cost)) if spent < float("inf") else ():
                at = min(need, had + gain[t])
                if spent + cost[t] < now[at][0]:
                    now[at] = (spent + cost[t], [*limits, t - 1])
        best = now
    return best[need]


def meeting(width: int, limit: int, differs: float) -> float:
    """Probability that at most limit of width bits differ, each with probability differs."""
    return sum(comb(width, k) * differs**k * (1 - differs) ** (width - k) for k in range(limit + 1))


def plan(n: int, both: np.ndarray, radius: int = RADIUS, recall: float | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use. Without recall no pair within radius is missed; else one at the radius with probability 1 - recall."""
    both = both.reshape(-1, BITS, BITS)
    words, found = len(both), []
    for m in range(2, (radius + 3 if recall is None else 7)):
        parts = [[BITS * w + b for b in bits] for w in range(words) for bits in group_bits(n, both[w], m)]
        costs, gains = [], []
        for bits in parts:
            pairs = expected_pairs(n, both[bits[0] // BITS], [b % BITS for b in bits], radius)
            most = radius if recall is None else 2
            costs.append([0.0] + [n * SEND * sum(comb(len(bits), k) for k in range(t + 1)) + VERIFY * words * pairs[t] for t in range(most + 1)])
            gains.append([t + 1 for t in range(-1, most + 1)] if recall is None else [0] + [int(-200 * log(max(1e-9, 1 - meeting(len(bits), t, radius / (BITS * words))))) for t in range(most + 1)])
        cost, limits = allot(costs, gains, radius + 1 if recall is None else ceil(-200 * log(1 - recall)))
        found.append((cost, [(b, t) for b, t in zip(parts, limits) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]], words: int = 1) -> DataFrame:
    """key, fp: each fingerprint at every value within its partitions' thresholds. key: partition in the upper bits, value below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for b in batches:
            fp = b.column(0)
            v = _load(fp, words)
            for i, (bits, limit) in enumerate(parts):
                value = np.zeros(len(v), np.uint64)
                for k, bit in enumerate(bits):
                    value |= ((v[:, bit // BITS] >> np.uint64(bit % BITS)) & one) << np.uint64(k)
                for flips in range(limit + 1):
                    for which in combinations(range(len(bits)), flips):
                        mask = np.uint64(sum(1 << k for k in which))
                        yield pa.RecordBatch.from_arrays([pa.array(((value ^ mask) | np.uint64(i << 40)).view(np.int64)), fp], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, f"key long, fp {_type(words)}")


def forest(v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """v: distinct rows of words. Links that connect what is connected by links of at most radius bits, one less than members."""
    a, b = [], []
    while len(v) > 1:
        todo, v = [v[0]], v[1:]
        while todo and len(v):
            x = todo.pop()
            near = np.bitwise_count(v ^ x).sum(axis=1) <= radius
            if near.any():
                met = v[near]
                a.append(np.broadcast_to(x, met.shape))
                b.append(met)
                todo.extend(met)
                v = v[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (v[:0], v[:0])


def small_links(v: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links inside small groups that lie one after another; left: how many rows of its group follow a row."""
    for d in range(1, int(left.max(initial=0)) + 1):
        i = np.flatnonzero(left >= d)
        i = i[np.bitwise_count(v[i] ^ v[i + d]).sum(axis=1) <= radius]
        if len(i):
            yield v[i], v[i + d]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, words: int = 1, recall: float | None = None) -> DataFrame:
    """a, b: pairs of distinct fingerprints within radius; together they connect what is connected."""
    parts = plan(*bit_counts(fps, words), radius, recall)
    signed = signatures(fps, parts, words)
    full = signed.groupBy("key").count().filter(F.col("count") > block).select(F.col("key").alias("f_key"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    met = signed.join(full, F.col("key") == F.col("f_key"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(own, x).alias("x"), F.greatest(own, x).alias("y")))
    nowhere = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    dealt = met.select("key", "fp", F.explode(F.when(F.col("blocks").isNull(), nowhere).otherwise(pairs)).alias("p")).select("key", "p.x", "p.y", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]

        def found(keys: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            """keys, v: rows of whole groups."""
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
            sizes = np.diff(np.append(starts, len(keys)))
            left = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1
            left[np.repeat(sizes > SMALL, sizes)] = 0
            for a, b in small_links(v, left, radius):
                yield pa.RecordBatch.from_arrays([_store(a), _store(b)], names=names)
            for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                a, b = forest(v[s : s + n], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([_store(a), _store(b)], names=names)

        held: list[tuple[np.ndarray, np.ndarray]] = []  # a group's rows lie together, perhaps over several batches
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, v = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1), _load(batch.column(3), words)
            cut = len(keys) - 1
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or (held[-1][0][-1] != keys[-1]).any()):
                keys, v, cut = np.concatenate([*(k for k, _ in held), keys]), np.concatenate([*(x for _, x in held), v]), cut + sum(len(k) for k, _ in held)
                held = []
            if cut:
                yield from found(keys[:cut], v[:cut])
            held.append((keys[cut:], v[cut:]))
        if held:
            yield from found(np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]))

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, f"a {_type(words)}, b {_type(words)}")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node with an edge."""
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = checkpointed(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int | None = None, radius: int | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, row_hash, root (a fingerprint that names the component) and component_id (its smallest doc_id), a row for each of docs.

    similarity: link texts whose five-word shingles are so similar (Jaccard), by fingerprints of WIDE words; else fingerprints of one word link within radius.
    """
    words, recall = (1, None) if similarity is None else (WIDE, RECALL)
    radius = radius if radius is not None else RADIUS if similarity is None else radius_of(similarity)
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle or (SHINGLE if similarity is None else WIDE_SHINGLE), words))
    fps = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, radius, words=words, recall=recall))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    # Roots of many members are few and broadcast; their members leave the join by root, and spread by their own fingerprint.
    hot = names.filter(F.col("members") > BLOCK).select(F.col("root").alias("h_root"), F.col("component_id").alias("h_id"), F.lit(True).alias("h_hot"))
    cold = names.filter(F.col("members") <= BLOCK).select(F.col("root").alias("c_root"), F.col("component_id").alias("c_id"))
    met = rooted.join(F.broadcast(hot), F.col("root") == F.col("h_root"), "left").withColumn("key", F.when(F.col("h_hot"), F.col("fp")).otherwise(F.col("root")))
    named = met.join(cold, F.col("key") == F.col("c_root"), "left").select("fp", "root", F.when(F.col("h_hot"), F.col("h_id")).otherwise(F.col("c_id")).alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "row_hash", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (rows without id come last, ties by the text's hash)."""
    prints = near_duplicates(docs, id_col, text_col, **options)
    kept = prints.groupBy("root", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("rows")).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row_hash"), F.col("rows"))).alias("k"))
    kept = checkpointed(kept.select(F.col("k.doc_id").alias("nd_id"), F.col("k.row_hash").alias("nd_hash"), F.col("k.rows").alias("nd_rows")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("nd_in"), F.col(f"`{id_col}`").cast("long").alias("nd_doc"), F.xxhash64(f"`{text_col}`").alias("nd_row"))
    same = F.col("nd_doc").eqNullSafe(F.col("nd_id")) & (F.col("nd_row") == F.col("nd_hash"))
    # Only rows that are there more than once need to be compared; the texts are moved once, and not sorted.
    once = rows.join(kept.filter("nd_rows = 1").hint("shuffle_hash"), same, "left_semi")
    more = rows.join(kept.filter("nd_rows > 1").hint("shuffle_hash"), same, "left_semi").dropDuplicates(["nd_doc", "nd_row"])
    return once.unionByName(more).select("nd_in.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
