"""Approximate nearest neighbours by largest inner product: a forest of sorted arrays of long hash strings.

A tree sorts the vectors of a shard by a string of SYMBOLS symbols of BITS bits; a symbol names the nearest vertex of
a randomly turned cross-polytope. A query descends every tree to the longest prefix that it shares with any string
there, and then all trees ascend together, one bit at a time, until the ranges of the sorted arrays that share the
query's prefix hold enough candidates. Those that enough trees agree on are scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORKER_CACHES, filesystem, fresh_dir, pack, publish, unpack, written
from .vectors import best_of, common_length, matrix, only_vectors, ranked

TREES, SYMBOLS, BITS = 96, 6, 5
SHARD_ROWS, QUERY_ROWS = 16_384, 4_096
#: Where ascent stops and how many trees must agree is tuned on samples of at most so many rows and queries.
TUNE_ROWS, TUNE_QUERIES, TARGET_RECALL = 16_384, 200, 0.96
#: Stopping sizes to choose from, as shares of all (tree, vector) pairs.
SHARES = (0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.024, 0.032, 0.048, 0.064, 0.09, 0.125, 0.18, 0.25, 0.5, 1.0)


@dataclass(frozen=True)
class Hashes:
    """Random cross-polytopes in one dimension more, which makes inner products comparable as angles.

    A vector x is hashed as (x - centre, sqrt(R^2 - |x - centre|^2)), a query q as (q, 0): the angle between them then
    falls as their inner product grows, and the centre shifts every inner product of a query alike.
    """

    centre: np.ndarray
    radius: float
    seed: int
    trees: int = TREES
    symbols: int = SYMBOLS
    bits: int = BITS

    def strings(self, v: np.ndarray, *, query: bool) -> np.ndarray:
        """Rows of unsigned numbers, one column per tree, whose leading bits are the hash string."""
        v = v if query else v - self.centre
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.radius**2 - (v * v).sum(1), 0.0))
        scale = np.sqrt((v * v).sum(1) + last * last)  # only the direction matters; float32 holds that at any length
        turned = (np.column_stack([v, last]) / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.float32)
        rng, axes = np.random.default_rng(self.seed), 1 << (self.bits - 1)
        out = np.zeros((len(v), self.trees), np.uint64)
        for s in range(self.symbols):
            planes = rng.standard_normal((v.shape[1] + 1, self.trees * axes), np.float32)
            for a in range(0, len(v), 4096):
                p = (turned[a : a + 4096] @ planes).reshape(-1, self.trees, axes)
                far = np.abs(p).argmax(2)
                symbol = far * 2 + (np.take_along_axis(p, far[:, :, None], 2)[:, :, 0] > 0)
                out[a : a + 4096] |= symbol.astype(np.uint64) << np.uint64(64 - self.bits * (s + 1))
        return out

    @property
    def length(self) -> int:
        return self.symbols * self.bits


class Forest:
    """The trees over one shard: for each the sorted strings and the order that sorts them."""

    def __init__(self, strings: np.ndarray, length: int, orders: np.ndarray | None = None):
        """From strings per vector and tree; or, with orders, from the strings per tree as sorted before."""
        if orders is None:
            orders = np.argsort(strings.T, axis=1, kind="stable").astype(np.int32)
            strings = np.take_along_axis(strings.T, orders, 1)
        self.orders, self.sorted, self.length = orders, strings, length
        self.trees, self.n = orders.shape

    def _at(self, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the ranges, per query and tree, that share the first level[query] bits."""
        tail = np.where(level < 64, np.uint64(0xFFFFFFFFFFFFFFFF) >> level.astype(np.uint64) % np.uint64(64), np.uint64(0))
        low, high = np.empty(asked.shape, np.int64), np.empty(asked.shape, np.int64)
        for t in range(self.trees):
            low[:, t] = np.searchsorted(self.sorted[t], asked[:, t] & ~tail, "left")
            high[:, t] = np.searchsorted(self.sorted[t], asked[:, t] | tail, "right")
        return low, high

    def ranges(self, asked: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the range of the sorted array to look at: bounds of the level where ascent stops.

        All trees are at one level, the deepest whose ranges hold `enough` vectors in sum (or the root). The sum
        only grows on the way up, so that level is found by halving the way from the leaves to the root.
        """
        deep, up = np.full(len(asked), self.length, np.int64), np.zeros(len(asked), np.int64)
        while (up < deep).any():
            level = (up + deep + 1) // 2
            low, high = self._at(asked, level)
            ok = (high - low).sum(1) >= enough
            up, deep = np.where(ok, level, up), np.where(ok, deep, level - 1)
        return self._at(asked, up)

    def votes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For every vector the number of trees in whose range it lies."""
        found = [o[a:b] for o, a, b in zip(self.orders, low.tolist(), high.tolist(), strict=True)]
        return np.bincount(np.concatenate(found), minlength=self.n)


def agreed(votes: np.ndarray, least: int, k: int) -> np.ndarray:
    """Places with at least `least` votes; fewer votes do where not even 4 k places have so many."""
    held = np.bincount(votes)[::-1].cumsum()[::-1]  # held[v]: places with v votes or more
    enough = np.flatnonzero(held >= min(4 * k, len(votes)))
    return np.flatnonzero(votes >= min(least, int(enough[-1])))


def best_candidates(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k best candidates, ties to smaller ids."""
    rough = vectors[near] @ q
    if len(near) > k:
        # Products by blocks may differ in the last bits: whatever may be among the k best is scored again in one order.
        slack = 1e-12 * vectors.shape[1] * float(np.abs(q).max()) * float(np.abs(vectors[near]).max() if len(near) else 0.0)
        near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
    score = (vectors[near] * q).sum(1)
    best = best_of(score, ids[near], k)
    return near[best], score[best]


def search(forest: Forest, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray, queries: np.ndarray, share: float, least: int, k: int):
    """Per query the places and scores of its k best candidates in a shard, ids by size among ties."""
    low, high = forest.ranges(asked, max(4 * k, int(np.ceil(share * forest.n * forest.trees))))
    for q, a, b in zip(queries, low, high, strict=True):
        yield best_candidates(vectors, ids, agreed(forest.votes(a, b), least, k), q, k)


def tuned(vectors: np.ndarray, hashes: Hashes, k: int, target: float) -> tuple[float, int, float]:
    """(share of pairs at which ascent stops, votes needed, share of vectors scored) of least cost on a sample.

    Queries are up to TUNE_QUERIES of the sample's own vectors. Of all pairs that find `target` of the true k best,
    that which scores the fewest vectors is taken, where looking at a place of a range costs a thirtieth of a score.
    """
    n, m = len(vectors), min(TUNE_QUERIES, len(vectors))
    if n <= 4 * k:
        return 1.0, 1, 1.0  # every vector is a candidate: there are no 4 k others
    strings = hashes.strings(vectors, query=False)
    forest, asked, ids = Forest(strings, hashes.length), hashes.strings(vectors[:m], query=True), np.arange(n)
    truth = [best_of(np.where(ids == q, -np.inf, vectors @ vectors[q]), ids, k) for q in range(m)]
    best = (np.inf, 1.0, 1, 1.0)
    for share in SHARES:
        low, high = forest.ranges(asked, max(4 * k, int(np.ceil(share * n * hashes.trees))))
        seen = (high - low).sum() / m / n
        if seen / 30 > best[0]:
            break  # from here on the ranges alone cost more
        found, scored = np.zeros(hashes.trees + 2), np.zeros(hashes.trees + 2)
        for t, a, b in zip(truth, low, high, strict=True):
            v = forest.votes(a, b)
            found += np.bincount(v[t], minlength=hashes.trees + 2)
            scored += np.bincount(v, minlength=hashes.trees + 2)
        found, scored = found[::-1].cumsum()[::-1], scored[::-1].cumsum()[::-1]
        good = np.flatnonzero(found[1:] >= target * k * m) + 1
        if len(good):
            least = int(good[-1])
            part = float(scored[least]) / m / n
            best = min(best, (part + seen / 30, share, least, part))
    return best[1:]


# ---- shards and blocks of queries as files in the shared folder ---------------------------------------------------

_held: dict[str, tuple] = {}
WORKER_CACHES.append(_held)


def _opened(folder: str, name: str) -> list[np.ndarray] | None:
    """The arrays of a file; a worker keeps the last shard and the last block, for its next pair mostly has one of them."""
    kind = name.split("-")[0]
    if _held.get(kind, ("",))[0] != f"{folder}/{name}":
        store, path = filesystem(folder)
        if not store.get_file_info(f"{path}/{name}").is_file:
            return None  # a shard or block that the dealing left empty
        with store.open_input_file(f"{path}/{name}") as f:
            _held[kind] = (f"{folder}/{name}", unpack(f.read()))
    return _held[kind][1]


def _planter(folder: str, hashes: Hashes, kind: str):
    """Writes a shard with its forest, or a block of queries with their strings; once, whoever reads it."""

    def run(key, table):
        import pyarrow as pa

        number, ids, v = key[0].as_py(), table.column("id").to_numpy(), matrix(table.column("v"))
        strings = hashes.strings(v, query=kind == "queries")
        arrays = [ids, v.ravel(), strings.ravel()]
        if kind == "shard":
            forest = Forest(strings, hashes.length)
            arrays = [ids, v.ravel(), forest.sorted.ravel(), forest.orders.ravel()]
        publish(folder, f"{kind}-{number}", lambda out: out.write(pack(*arrays)))
        return pa.table({"rows": pa.array([len(ids)], pa.int64())})

    return run


def _searcher(folder: str, hashes: Hashes, blocks: int, share: float, least: int, k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for pair in batch.column(0).to_pylist():
                shard, block = _opened(folder, f"shard-{pair // blocks}"), _opened(folder, f"queries-{pair % blocks}")
                if shard is None or block is None:
                    continue
                (ids, v, strings, orders), (q_ids, q, asked) = shard, block
                v, strings, orders = v.reshape(len(ids), -1), strings.reshape(-1, len(ids)), orders.reshape(-1, len(ids))
                forest = Forest(strings, hashes.length, orders)
                found = list(search(forest, v, ids, asked.reshape(len(q_ids), -1), q.reshape(len(q_ids), -1), share, least, k))
                near, scores = np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])
                at = np.repeat(q_ids, [len(p) for p, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids[near], pa.int64()), pa.array(scores, pa.float64())], names=["query_rep", "rep", "score"])

    return run


def _plant(rows: DataFrame, by: str, folder: str, hashes: Hashes, kind: str) -> None:
    rows.groupBy(by).applyInArrow(_planter(folder, hashes, kind), "rows long").agg(F.sum("rows")).collect()


def _pairs(spark: SparkSession, shards: int, blocks: int) -> DataFrame:
    """A row per pair of a shard and a block, in tasks of a few pairs with one shard."""
    n = shards * blocks
    return spark.range(0, n, 1, min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // 8))))


def nearest(table: DataFrame, *, queries: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target_recall: float = TARGET_RECALL, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, seed: int = 7) -> DataFrame:
    """The k nearest found of each query row among all others: query_id, rank, vec_id, score.

    Equal vectors are indexed and searched once: of each distinct vector only the k + 1 least ids can be answers,
    so a vector held by a third of all rows neither fills a shard nor is searched for again and again. Distinct
    vectors are dealt by hash over shards of about shard_rows, each with a forest of its own (a document-partitioned
    index). Every shard's forest and every block of queries is built and written once, to the shared folder; a task
    takes a few pairs of them, reads both and searches, so a lost executor costs its pairs only. A shard and a block
    bound a task's memory. The hash strings' centre and radius come from all rows; only the stopping size and the
    votes needed are tuned, at any size, on the documented samples.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id. Of
    rows that repeat an id the one with the least vector counts. Fewer candidates than k give fewer rows; an empty
    table none. Vectors of several lengths raise a ValueError. Other columns are not read.
    """
    spark = table.sparkSession
    rows = only_vectors(table, id_col, vec_col, nonzero=True)
    by_vector = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    members = written(members.select("id", "v", "r"), "vectors")
    reps = members.where("r = 1").select("id", "v")
    n, d = common_length(reps)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre = np.array(reps.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(d)])).first()[0], float)
    away = F.aggregate(F.zip_with("v", F.array(*map(F.lit, centre.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    hashes = Hashes(centre, float(reps.agg(F.sqrt(F.max(away))).first()[0]), seed)
    sample = np.array([r.v for r in reps.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(TUNE_ROWS).collect()], float)
    share, least, _ = tuned(sample, hashes, k, target_recall)

    asked = rows.where(F.expr(queries.replace(id_col, "id"))).select(F.col("id").alias("query_id"), "v")
    # A query's vector stands in the index, so the representative's id names it.
    shards = max(1, -(-n // shard_rows))
    wanted = written(asked.groupBy("v").agg(F.min("query_id").alias("id")), "queries")
    blocks = max(1, -(-wanted.count() // query_rows))
    folder = fresh_dir(spark, "forest")
    _plant(wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "block", folder, hashes, "queries")
    _plant(reps.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards))), "shard", folder, hashes, "shard")
    found = _pairs(spark, shards, blocks).mapInArrow(_searcher(folder, hashes, blocks, share, least, k + 1), "query_rep long, rep long, score double")
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
    found = found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1).drop("i")

    groups = members.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    answers = found.join(groups.select("rep", "ids"), "rep").groupBy("query_rep").agg(F.collect_list(F.struct("score", "ids")).alias("groups"))
    queried = asked.join(wanted.withColumnRenamed("id", "query_rep"), "v").select("query_id", "query_rep")
    each = queried.join(answers, "query_rep").select("query_id", F.explode("groups").alias("g")).select("query_id", F.explode("g.ids").alias("vec_id"), F.col("g.score").alias("score"))
    return ranked(each.where("vec_id <> query_id"), k)
