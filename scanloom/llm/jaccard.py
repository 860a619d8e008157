"""Exact Jaccard join of documents on word shingles, down to one component per document.

Most documents share too little with any other to link, and counts show it before any pair is formed: a document
with more shingles of its own than a link leaves room for is done. What is left is joined in three steps: documents
with equal sets are one class; classes that meet in an index list form candidate clusters; each cluster is joined
by `set_join.SetJoin`, in blocks where it is large.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .set_join import Groups, SetJoin
from .shared import least_unsigned, make_room, pack, parts_for, text_bytes, unpack, written
from .shingles import WORDS, batch_sets, digest

NUM, DEN = 75, 100
#: A mapper's block is closed at so many shingles or documents.
BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 50_000
#: Bytes of text whose shingles one task counts at most, about.
PART_BYTES = 32 << 20
#: Part of the hash range in which shingles are counted first, of which the leading bits are kept.
FIRST_RANGE, FIRST_BITS = 0.375, 48
#: Sets and shingles in a block of a cluster; random dealings of a cluster of several blocks before the exact pass.
BLOCK_SETS, BLOCK_CLUSTER_SHINGLES, DEALINGS = 96, 2_000_000, 3

_HEAD = "array<struct<id: long, n: long, digest: binary>>"
_ROW = f"part int, block long, heads {_HEAD}, blob binary"


def spare(n, num: int = NUM, den: int = DEN):
    """Elements a set of n may hold that a linked set does not: n less the least overlap."""
    return n - -(-num * n // den)


# ---- counting who else holds a shingle --------------------------------------------------------------------------


def _arrow():
    import pyarrow as pa

    head = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))
    return pa, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("heads", head), ("blob", pa.binary())])


def _dealer(parts: int, share: float, bits: int, size: int, block_shingles: int, block_docs: int):
    """Mapper: per block of documents one row with its heads and postings, and per range of hashes the distinct ones in it.

    A hash that a large part of the block's documents hold is one entry there, with their number: no range is hot.
    The postings are, for each distinct hash in ascending order, the number of its documents and the documents.
    """

    def run(batches):
        from pyspark import TaskContext

        make_room()
        pa, schema = _arrow()
        limit, shift = int(share * 2**64), np.uint64(64 - bits)
        edges = np.array([min(limit * p // parts, 2**64 - 1) for p in range(parts)], np.uint64) >> shift
        first, blocks, heads, held, total = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            nonlocal blocks, heads, held, total
            block = first + blocks
            flat = np.concatenate(held) >> shift
            doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
            order = np.argsort(flat, kind="stable")
            hashes, counts = np.unique(flat, return_counts=True)
            rows = [{"part": block % parts, "block": block, "heads": heads, "blob": pack(least_unsigned(counts), least_unsigned(doc[order]))}]
            bounds = np.append(np.searchsorted(hashes, edges), len(hashes))
            for p in range(parts):
                a, b = bounds[p], bounds[p + 1]
                if a < b:
                    rows.append({"part": p, "block": block, "heads": None, "blob": pack(hashes[a : a + 1], least_unsigned(np.diff(hashes[a:b])), least_unsigned(counts[a:b]))})
            blocks, heads, held, total = blocks + 1, [], [], 0
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[k : k + 64], schema)

        for batch in batches:
            for i, hashes in zip(batch.column(0).to_pylist(), batch_sets(batch.column(1), size), strict=True):
                heads.append({"id": i, "n": len(hashes), "digest": digest(hashes)})
                held.append(hashes[: np.searchsorted(hashes, np.uint64(limit))] if share < 1 else hashes)
                total += len(held[-1])
                if total >= block_shingles or len(heads) >= block_docs:
                    yield from flush()
        if heads:
            yield from flush()

    return run


def _hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, steps, counts = unpack(blob)
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate([head, steps.astype(np.uint64)]), dtype=np.uint64), counts.astype(np.int64)


def _counter(detail: bool):
    """Reducer of a range of hashes: for each block, in the order of its hashes, in how many documents each is.

    Without detail only whether that is one; with it also the hashes of those that are in more.
    """

    def run(table):
        make_room()
        pa, schema = _arrow()
        rows = table.to_pylist()
        full = [r for r in rows if r["heads"] is None]
        pairs = [_hashes(r["blob"]) for r in full]
        if pairs:
            _, inverse = np.unique(np.concatenate([h for h, _ in pairs]), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([c for _, c in pairs])).astype(np.int64)[inverse]
            at = 0
            for r, (h, _) in zip(full, pairs, strict=True):
                t = total[at : at + len(h)]
                at += len(h)
                r["blob"] = pack(least_unsigned(t), h[t > 1]) if detail else pack(np.packbits(t == 1), np.array([len(t)], np.uint32))
        return pa.Table.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema)

    return run


def _gather(table, detail: bool) -> tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a block: heads, each document's number of hashes that no other has, documents by posting, the counters' answers."""
    heads, postings, answers = None, None, []
    for part, h, blob in sorted(zip(table.column("part").to_pylist(), table.column("heads").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda r: r[0]):
        if h is not None:
            heads, postings = h, unpack(blob)
        else:
            answers.append(unpack(blob))
    counts, doc = postings[0].astype(np.int64), postings[1].astype(np.int64)
    alone = np.concatenate([np.zeros(0, bool), *(a[0] == 1 if detail else np.unpackbits(a[0], count=int(a[1][0])).astype(bool) for a in answers)])
    return heads, np.bincount(doc[np.repeat(alone, counts)], minlength=len(heads)), doc, [counts, *(np.concatenate([np.zeros(0, np.uint64), *(a[k] for a in answers)]) for k in (0, 1))] if detail else []


def _summed(table):
    import pyarrow as pa

    heads, own, *_ = _gather(table, False)
    return pa.table({"id": pa.array([h["id"] for h in heads], pa.int64()), "n": pa.array([h["n"] for h in heads], pa.int64()), "digest": pa.array([h["digest"] for h in heads], pa.binary()), "own": pa.array(own, pa.int64())})


def _prefixes(num: int, den: int):
    """Per document that may still link: its shared shingles, and those of them in its prefix, rarest first."""

    def run(table):
        import pyarrow as pa

        heads, own, doc, (counts, total, shared) = _gather(table, True)
        more = total > 1
        held = np.zeros(len(total), np.uint64)
        held[more] = shared
        take = np.repeat(more, counts)
        doc, hashes, count = doc[take], np.repeat(held, counts)[take], np.repeat(total, counts)[take]
        order = np.lexsort((hashes, doc))
        doc, hashes, count = doc[order], hashes[order], count[order]
        bounds = np.searchsorted(doc, np.arange(len(heads) + 1))
        out = []
        for k, h in enumerate(heads):
            take = spare(h["n"], num, den) + 1 - int(own[k])
            mine = hashes[bounds[k] : bounds[k + 1]]
            if take > 0 and len(mine):
                front = np.lexsort((mine, count[bounds[k] : bounds[k + 1]]))[:take]
                out.append({"id": h["id"], "n": h["n"], "own": int(own[k]), "shared": mine.tobytes(), "prefix": mine[front].view(np.int64).tolist()})
        return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64()))]))

    return run


def _counted(docs: DataFrame, amount: int, share: float, bits: int, size: int, detail: bool) -> DataFrame:
    """The counters' answers for all blocks of `amount` bytes of text, dealt so that a range's hashes fit a task."""
    parts = 4 * parts_for(docs.sparkSession, share * amount, 4 * PART_BYTES)
    dealt = docs.mapInArrow(_dealer(parts, share, bits, size, BLOCK_SHINGLES, BLOCK_DOCS), _ROW)
    return dealt.groupBy("part").applyInArrow(_counter(detail), _ROW)


# ---- joining clusters ---------------------------------------------------------------------------------------------


def _sets(table) -> tuple[list[int], list[int], list[np.ndarray]]:
    return table.column("id").to_pylist(), table.column("n").to_pylist(), [np.frombuffer(b, np.uint64) for b in table.column("shared").to_pylist()]


def _block_join(num: int, den: int):
    def run(table):
        import pyarrow as pa

        ids, sizes, sets = _sets(table)
        found = [(ids[x], ids[y]) for x, y in SetJoin(sets, sizes, num, den).links(Groups(len(ids)))]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _cross_join(num: int, den: int):
    """Joins the sets of the left side with all, where their components differ."""

    def run(key, left, right):
        import pyarrow as pa

        few, comps, seen = set(left.column("id").to_pylist()), {}, set()
        ids, sizes, sets = [], [], []
        for t in (left, right):
            for i, c, n, s in zip(t.column("id").to_pylist(), t.column("component").to_pylist(), *_sets(t)[1:], strict=True):
                if (i, n, s.tobytes()) not in seen:  # a repeated id may have several sets
                    seen.add((i, n, s.tobytes()))
                    comps[i] = c
                    ids.append(i)
                    sizes.append(n)
                    sets.append(s)
        groups, heads = Groups(len(ids)), {}
        for k, i in enumerate(ids):
            groups.join(k, heads.setdefault(comps[i], k))
        asked = np.array([i in few for i in ids], bool)
        found = [(comps[ids[x]], comps[ids[y]]) for x, y in SetJoin(sets, sizes, num, den).links(groups, lambda x, near: near if asked[x] else near[asked[near]])]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _postings(sets: DataFrame, num: int, den: int, *more: str) -> DataFrame:
    """A row per element of every set's prefix: element w, size band, most (the largest set that may link by w), first.

    Sets that link share the first, in the order of rarity, of their common elements, and it lies at a position (the
    set's own elements come before) that leaves room for the overlap. That bounds the other's size if it is the
    smaller one: `most`. The smaller set has it even among its `first` elements, those that leave room for the overlap
    with a set no smaller.
    """
    n, place = F.col("n"), F.col("own") + F.col("j")
    rows = sets.select("id", "n", "own", *more, F.posexplode("prefix").alias("j", "w"))
    band = F.floor(F.log("n") / math.log(den / num)).cast("int")
    first = place <= n - F.ceil(2 * num * n / (num + den))
    return rows.select("id", "n", *more, "w", band.alias("band"), (F.floor((n - place) * (num + den) / num) - n).alias("most"), first.alias("first"))


def _candidate_edges(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges that connect, within each index list, all sets whose sizes and positions there allow a link.

    A list is cut into bands of sizes; sets that link lie in one band or in two that follow each other. An entry is
    tied to the least id among the `first` entries of its band and of the band below, if it may link with the smallest
    of them. Those heads are aggregated on the map side and joined back, so that a list that a large part of all
    sets share is never one task's.
    """
    postings = _postings(sets, num, den)
    heads = postings.where("first").groupBy("w", "band").agg(F.min("id").alias("head"), F.min("n").alias("low"))
    heads = heads.select("w", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "head", "low")
    return postings.join(heads, ["w", "band"]).where("most >= low and id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()


def _meetings(few: DataFrame, all_sets: DataFrame, of_few: str, of_all: str) -> tuple[DataFrame, DataFrame]:
    """Where sets of two posting tables may link: distinct (cluster, id of few, of_all) and (cluster, id of all, of_few).

    of_few and of_all are the tasks that the sets are dealt to. Each list is reduced to its distinct tasks before the
    other side's entries are joined to it.
    """
    out = []
    for one, other, place in ((few, all_sets, of_all), (all_sets, few, of_few)):
        # The smaller of two sets that link is a `first` entry, in the larger's band or the one below.
        lists = other.groupBy("cluster", "w", "band", place).agg(F.min(F.when(F.col("first"), F.col("n"))).alias("low"), F.max("most").alias("top"))
        lists = lists.select("cluster", "w", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("at"), "band", place, "low", "top")
        found = one.withColumnRenamed("band", "at").join(lists, ["cluster", "w", "at"])
        out.append(found.where("(at >= band and most >= low) or (first and at <= band and top >= n)").select("cluster", "id", place).distinct())
    return out[0], out[1]


def _spread_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner", ways: int = 64) -> DataFrame:
    """rows joined with one row per key, each key's rows dealt over `ways` tasks by their id, whatever its size."""
    copies = per_key.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return rows.withColumn("way", F.pmod(F.xxhash64("id", F.lit(-3)), F.lit(ways).cast("long"))).join(copies, [key, "way"], how).drop("way")


def _links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect exactly the sets connected by links of at least num / den."""
    clusters = components(_candidate_edges(sets, num, den)).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    members = written(sets.join(clusters, "id"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.length("shared")) / (8 * BLOCK_CLUSTER_SHINGLES)))
    sizes = members.groupBy("cluster").agg(F.least(blocks, F.count("*")).cast("int").alias("blocks"))
    large = sizes.where("blocks > 1")
    sized = _spread_join(members, large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = sized.withColumn("dealing", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, F.lit(DEALINGS - 1)).otherwise(F.lit(0)))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", "dealing"), F.col("blocks")))
    edges = written(dealt.groupBy("cluster", "dealing", "block").applyInArrow(_block_join(num, den), "a long, b long"), "links")
    if large.isEmpty():
        return edges
    # A cluster of several blocks is mostly one component by now. The others in it are compared with what they may
    # link with there: by blocks of both, and a set goes to those blocks only that hold a candidate of its.
    found = components(edges)
    rest = _spread_join(members, large, "cluster").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = written(rest, "large-clusters")
    per = rest.groupBy("cluster", "component").agg(F.count("*").alias("sets"))
    main = per.groupBy("cluster").agg(F.max_by("component", F.struct("sets", "component")).alias("main"), F.sum("sets").alias("all"), F.max("sets").alias("most"))
    main = main.select("cluster", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK_SETS).cast("int").alias("few")).where("few > 0")
    row, column = F.pmod(F.xxhash64("id", F.lit(-1)), F.col("few")), F.pmod(F.xxhash64("id", F.lit(-2)), F.col("blocks"))
    rest = written(_spread_join(rest, main, "cluster").withColumn("row", row).withColumn("column", column), "dealt-clusters")
    few = rest.where("component <> main")
    postings = written(_postings(rest, num, den, "cluster", "row", "column", "component", "main"), "postings")
    columns_of, rows_of = _meetings(postings.where("component <> main").drop("column"), postings.drop("row"), "row", "column")
    keep = "cluster", "row", "column", "id", "n", "shared", "component"
    left = few.drop("column").join(columns_of, ["cluster", "id"]).select(*keep)
    # Both sides come from one table: new names (aliases) tell their columns apart.
    right = rest.drop("row").join(rows_of, ["cluster", "id"]).select(*[F.col(c).alias(c) for c in keep])
    crossed = left.groupBy("cluster", "row", "column").cogroup(right.groupBy("cluster", "row", "column")).applyInArrow(_cross_join(num, den), "a long, b long")
    return edges.unionByName(written(crossed, "links"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per document: id, n_shingles, component_id (the least id reachable by links, its own included).

    Exact but for equal 64-bit hashes of different shingles (see `shingles`). Words are runs of characters other than white space of ASCII, A-Z taken as a-z; a document's set holds the runs
    of `size` words, or the whole sequence if it has fewer, as 64-bit hashes. Documents link when
    den * intersection >= num * union.

    Two rounds of counts find who can link: over a part of the hash range for all documents, then in full for one
    document of each class of equal sets that the first round leaves. Both move each block's distinct hashes by range
    of the hash, in as many ranges as the bytes of text ask for. Clusters of classes that meet in index lists, at
    positions and sizes that allow a link, are joined in tasks of at most some BLOCK_SETS sets; a larger cluster is
    dealt into blocks at random a few times, which connects what is densely linked without all pairs, and then only
    sets across the components left are compared, in those pairs of blocks where their index lists meet. Classes
    need no pairs at all.

    Null and empty texts have an empty set, 0 shingles and no link. A row with a null id has a null component and
    links with nothing. Rows that repeat an id are one document with several sets, each row with its own
    n_shingles. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Written, for both what is kept and the result follow from it.
    amount = text_bytes(rows, "text")
    table = written(_counted(rows, amount, FIRST_RANGE, FIRST_BITS, size, False).groupBy("block").applyInArrow(_summed, "id long, n long, digest binary, own long"), "sets")
    classes = table.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("own").alias("own"))
    left = classes.where(F.col("own") <= F.col("n") - F.ceil(F.col("n") * num / den)).select(F.col("rep").alias("id")).distinct()
    texts = rows.join(left.hint("shuffle_hash"), "id", "left_semi")
    sets = _counted(texts, amount, 1.0, 64, size, True).groupBy("block").applyInArrow(_prefixes(num, den), "id long, n long, own long, shared binary, prefix array<long>")
    edges = _links(written(sets, "shared-shingles"), num, den)

    classed = table.where("n > 0 and id is not null").select("id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
    # Only an id with several sets ties their classes together.
    ties = classed.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    tied = classed.join(ties, "id").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    found = components(edges.unionByName(tied)).withColumnRenamed("node", "rep")
    by_class = classes.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = table.join(by_class, "digest", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
