"""Exact top-k inner products of integer vectors: by descending length, on rotated parts, with Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .vectors import best_of, common_length, matrix, only_vectors, ranked

BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096
#: Bands of length at most; what a band holds beyond a block is dealt on.
BANDS = 256
#: Rows of greatest length that give every query its first bound, and rows taken at once within a block.
SEED_ROWS, STEP = 2_048, 2_048
#: Largest sum of squares up to which doubles add integer products exactly.
_EXACT = float(1 << 52)


def exact_products(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of the rows of a with q: in doubles where those are exact, else in Python integers."""
    if len(a) and float(np.abs(a).max()) * float(np.abs(q).max()) * a.shape[1] >= _EXACT:
        return np.array([sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for r in a], object)
    return a @ q


class Rotated:
    """Candidates by descending length in the axes of their own products' decomposition, with lengths of the rests."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, axes: np.ndarray, parts: tuple[int, ...]):
        length = np.sqrt((vectors * vectors).sum(1))
        order = np.lexsort((ids, -length))
        self.vectors, self.ids, self.length = vectors[order], ids[order], length[order]
        turned = self.vectors @ axes
        self.parts, self.slices, self.rests, at = parts, [], [], 0
        for p in parts:
            self.slices.append(turned[:, at:p])
            self.rests.append(np.sqrt(np.maximum((turned[:, p:] ** 2).sum(1), 0.0)))
            at = p

    def best(self, query: np.ndarray, own: int, axes: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best that are at least `bound`, which some k rows elsewhere are known to reach."""
        q, turned = float(np.sqrt(query @ query)), query @ axes
        slack = 1e-9 * (q * (self.length[0] if len(self.length) else 0.0) + 1.0)  # rounding of the rotation
        rests, at = [], 0
        for p in self.parts:
            rests.append((slice(at, p), float(np.sqrt(max(turned[p:] @ turned[p:], 0.0)))))
            at = p
        kept_ids, kept = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(self.ids), STEP):
            if q * self.length[start] + slack < bound:
                break  # no row from here on is long enough
            rows = np.arange(start, min(start + STEP, len(self.ids)))
            rows = rows[(q * self.length[rows] + slack >= bound) & (self.ids[rows] != own)]
            partial = np.zeros(len(rows))
            for part, rest, (cut, left) in zip(self.slices, self.rests, rests, strict=True):
                partial = partial + part[rows] @ turned[cut]
                stay = partial + left * rest[rows] + slack >= bound
                rows, partial = rows[stay], partial[stay]
                if not len(rows):
                    break
            if not len(rows):
                continue
            ids, scores = np.concatenate([kept_ids, self.ids[rows]]), np.concatenate([kept, exact_products(self.vectors[rows], query)])
            top = best_of(scores, ids, k)
            kept_ids, kept = ids[top], scores[top]
            if len(kept) == k:
                bound = max(bound, float(kept[-1]))
        return kept_ids, kept


def _products(batches):
    """Cells (i <= j) of the sum of v_i v_j over the batches: one row each, whatever the number of vectors."""
    import pyarrow as pa

    total = None
    for batch in batches:
        v = matrix(batch.column(0))
        if len(v):
            total = v.T @ v + (0 if total is None else total)
    if total is not None:
        i, j = np.triu_indices(len(total))
        for a in range(0, len(i), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(i[a : a + 65_536], pa.int32()), pa.array(j[a : a + 65_536], pa.int32()), pa.array(total[i, j][a : a + 65_536], pa.float64())], names=["i", "j", "s"])


def axes_of(rows: DataFrame, d: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """Right singular vectors of all rows by falling value, and where to stop and look at the bound.

    They are those of the d x d matrix of products, summed up in every task and then over the tasks.
    """
    gram = np.zeros((d, d))
    for r in rows.select("v").mapInArrow(_products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.s
    return np.linalg.svd(gram)[0], tuple(sorted({max(1, d // 8), max(1, d // 3), max(1, 2 * d // 3), d}))


def _search(k: int, axes: np.ndarray, parts: tuple[int, ...]):
    def run(key, left, right):
        import pyarrow as pa

        q_ids, at_least = left.column("id").to_numpy(), left.column("bound").to_numpy()
        queries, ids = matrix(left.column("v")), right.column("id").to_numpy()
        out_q, out_i, out_s = [], [], []
        if len(q_ids) and len(ids):
            block = Rotated(matrix(right.column("v")), ids, axes, parts)
            for q_id, q, bound in zip(q_ids.tolist(), queries, at_least.tolist(), strict=True):
                found, scores = block.best(q, q_id, axes, bound, k)
                out_q += [q_id] * len(found)
                out_i += found.tolist()
                out_s += [int(s) for s in scores]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_i, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def _bounds(top: np.ndarray, ids: np.ndarray, k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            queries, q_ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            bound = []
            for i, q in zip(q_ids.tolist(), queries, strict=True):
                s = np.asarray(exact_products(top, q), float)[ids != i]
                bound.append(float(np.sort(s)[-k]) if len(s) >= k else -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound, pa.float64()), pa.array(np.sqrt((queries**2).sum(1)) if len(queries) else [], pa.float64())], names=["id", "v", "bound", "length"])

    return run


def top_products(table: DataFrame, *, queries: str = "vec_id % 50 = 0", k: int = 5, factor: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k largest integer inner products of each query row with all others: query_id, rank, vec_id, score. Exact.

    Components become floor(factor * x). The SEED_ROWS longest vectors (a bounded set, sent to the tasks) give
    every query a bound that k rows reach. Candidates are dealt into bands by descending length, at most BANDS, and
    within a band by a hash into blocks; a query goes to those bands only whose longest vector could reach its bound,
    a prefix of the bands. In a block rows go by descending length until none is long enough, and the partial sums
    over the rotated components are dropped as soon as the Cauchy-Schwarz bound on their rest shows that they cannot
    reach it. What remains is multiplied in exact integers. The rotation comes from the d x d matrix of products over
    all rows; any rotation is exact.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; zero
    vectors do. Of rows that repeat an id the one with the least vector counts. Fewer candidates give fewer rows; an
    empty table none. A score beyond 64 bits raises, as do vectors of several lengths. Other columns are not read.
    """
    spark = table.sparkSession
    scaled = F.transform("v", lambda x: F.floor(x * float(factor)).cast("double"))
    rows = only_vectors(table, id_col, vec_col, nonzero=False).select("id", scaled.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(rows.withColumn("length", length), "integer-vectors")
    n, d = common_length(rows)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = rows.orderBy(F.desc("length"), "id").limit(SEED_ROWS).collect()
    axes, parts = axes_of(rows, d)
    asked = rows.where(F.expr(queries.replace(id_col, "id"))).select("id", "v").mapInArrow(_bounds(np.array([r.v for r in top], float), np.array([r.id for r in top]), k), "id long, v array<double>, bound double, length double")
    bands = min(BANDS, -(-n // block_rows))
    edges = []
    if bands > 1:
        edges = sorted(set(rows.selectExpr(f"percentile_approx(length, array({', '.join(str(i / bands) for i in range(1, bands))}), 10000)").first()[0]), reverse=True)
    band = F.expr("+".join(["0", *[f"int(length < {e!r}D)" for e in edges]]))
    # Equal lengths may be many, and there may be more rows than the bands hold: a band is dealt on by a hash.
    sizes = sorted(rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect(), key=lambda r: r.band)
    cuts = {r.band: max(1, -(-r.n // (2 * block_rows))) for r in sizes}
    by_band = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values for x in pair]), F.col("band"))
    dealt = rows.withColumn("band", band).withColumn("cut", F.pmod(F.xxhash64("id"), by_band(cuts.items()).cast("long")))
    q_blocks = max(1, -(-n // (50 * QUERY_ROWS)))
    reach = asked.withColumn("band", F.explode(F.array(*[F.lit(r.band) for r in sizes])))
    reach = reach.where(by_band([(r.band, r.longest) for r in sizes]) * F.col("length") * (1 + 1e-12) + 1e-6 >= F.col("bound"))
    sent = reach.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), by_band(cuts.items()).cast("long") - 1))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(q_blocks)))
    copies = dealt.select("id", "v", "band", "cut").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    key = "band", "cut", "part"
    found = sent.select("id", "v", "bound", *key).groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_search(k, axes, parts), "query_id long, vec_id long, score long")
    return ranked(found, k)
