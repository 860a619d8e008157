"""Vector searches and WARC archives against brute force."""

import gzip
import io

import numpy as np
import pytest

from scanloom.llm import lsh_forest
from scanloom.llm.exact_topk import axes_of, top_products
from scanloom.llm.lsh_forest import Forest, Hashes, agreed, best_candidates, nearest, tuned
from scanloom.llm.queries import ORACLE_SQL
from scanloom.llm.warc import archived_pages, digest_of, read_warc, records, write_warc

SCHEMA = "vec_id long, embedding array<float>, id long, v string, score int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def vectors(n=900, d=16, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    out = (rng.standard_normal((n, d)) * rng.uniform(0.2, spread, (n, 1))).astype(np.float32)
    out[40:160] = out[40]  # many equal vectors
    rows = out.tolist()
    rows[3] = None
    rows[5] = [None, *rows[5][1:]]
    rows[7] = [float("nan"), *rows[7][1:]]
    rows[9] = [float("inf"), *rows[9][1:]]
    rows[20] = [0.0] * d
    return rows


def usable(rows, zero):
    ok = {i: np.array(v, float) for i, v in enumerate(rows) if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    return {i: v for i, v in ok.items() if zero or v.any()}


def test_forest_recall_and_order(spark):
    rows = vectors()
    good = usable(rows, False)
    got = {}
    for r in nearest(table(spark, rows), shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in good if i % 20 == 0]
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        found = sorted(got[q])
        assert [k for k, *_ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(good[i] @ good[q]), rel=1e-12, abs=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        best = sorted((-float((good[i] * good[q]).sum()), i) for i in good if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(queries)


def test_forest_ranges_hold_exactly_the_shared_prefixes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    h = Hashes(np.zeros(8), 5.0, 3, trees=3, symbols=3, bits=4)
    strings, asked = h.strings(x, query=False), h.strings(x[:10], query=True)
    f = Forest(strings, h.length)
    low, high = f.ranges(asked, 30)
    for q in range(10):
        found = [set(f.orders[t][low[q, t] : high[q, t]].tolist()) for t in range(3)]
        shared = lambda lv: [{k for k in range(200) if lv == 0 or strings[k, t] >> np.uint64(64 - lv) == asked[q, t] >> np.uint64(64 - lv)} for t in range(3)]  # noqa: B023, E731
        level = max(lv for lv in range(13) if sum(map(len, shared(lv))) >= 30)
        assert found == shared(level)
        assert f.votes(low[q], high[q]).tolist() == [sum(k in x for x in found) for k in range(200)]


def test_forest_scores_few_of_many_shards_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 48))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    got = {}
    for r in nearest(table(spark, x.tolist()), shard_rows=900, query_rows=70).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 4000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got) == 0.9 * 20 * 200
    h = Hashes(np.zeros(48), 1.0, 7)
    share, least, _ = tuned(x[:900], h, 21, 0.96)
    f, asked = Forest(h.strings(x[:900], query=False), h.length), h.strings(x[900:1000], query=True)
    low, high = f.ranges(asked, int(share * 900 * f.trees))
    assert np.mean([len(agreed(f.votes(a, b), least, 21)) for a, b in zip(low, high, strict=True)]) < 0.5 * 900


def test_tuning_uses_the_forest_at_500_vectors():
    x = np.random.default_rng(3).standard_normal((500, 16))
    h = Hashes(np.zeros(16), float(np.sqrt((x * x).sum(1).max())), 7)
    share, _, scored = tuned(x, h, 5, 0.9)
    assert share < 1 and scored < 0.9


def test_equal_scores_keep_the_least_ids():
    rng = np.random.default_rng(0)
    v = np.zeros((600, 9))
    v[:, 0], v[:, 1:] = 1.0, rng.standard_normal((600, 8))
    places, scores = best_candidates(v, np.arange(600), np.arange(600), np.eye(9)[0], 20)
    assert places.tolist() == list(range(20)) and (scores == 1).all()


@pytest.mark.parametrize("search", [nearest, top_products])
def test_searches_of_odd_tables(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (None, [9.0, 9.0]), (1, [3.0, 5.0]), (1, [3.0, 5.0]), (2, [2.0, 1.0])]
    found = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    with pytest.raises(ValueError, match="of 2 and of 3"):
        search(table(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]]))


def test_axes_come_from_all_rows(spark):
    x = np.random.default_rng(5).standard_normal((300, 6))
    axes, _ = axes_of(spark.createDataFrame([(r,) for r in x.tolist()], "v array<double>").repartition(3), 6)
    want = np.linalg.svd(x.T @ x)[0]
    assert np.allclose(np.abs((axes * want).sum(0)), 1)


def test_forest_files_are_written_once(spark, monkeypatch):
    planted = []
    monkeypatch.setattr(lsh_forest, "_plant", lambda rows, by, folder, hashes, kind, plant=lsh_forest._plant: planted.append(kind) or plant(rows, by, folder, hashes, kind))
    x = np.random.default_rng(6).standard_normal((500, 8))
    assert nearest(table(spark, x.tolist()), shard_rows=100, query_rows=5).count() == 25 * 20
    assert planted == ["queries", "shard"]


def test_forest_small_tables(spark):
    assert nearest(table(spark, [])).count() == 0
    assert nearest(table(spark, [None, [0.0, 0.0]])).count() == 0
    one = nearest(table(spark, [[1.0, 0.0], [0.5, 0.5], [0.5, 0.5]])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(one, key=lambda r: r.rank)] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_exact_topk(spark, spread):
    rows = vectors(seed=2, spread=spread)
    good = {i: np.floor(256 * v) for i, v in usable(rows, True).items()}
    got = {}
    for r in top_products(table(spark, rows), block_rows=128).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q: [(k, i, -s) for k, (s, i) in enumerate(sorted((-int(good[i] @ good[q]), i) for i in good if i != q)[:5], 1)] for q in good if q % 50 == 0}
    assert {q: sorted(v) for q, v in got.items()} == want


def test_exact_topk_small_and_large_numbers(spark):
    assert top_products(table(spark, [])).count() == 0
    big = [[5e6, 5e6], [5e6, 5e6 - 1], [-5e6, 1.0]]
    got = [(r.vec_id, r.score) for r in sorted(top_products(table(spark, big)).collect(), key=lambda r: r.rank)]
    v = [[int(np.floor(256 * float(np.float32(x)))) for x in r] for r in big]
    assert got == [(1, sum(a * b for a, b in zip(v[0], v[1], strict=True))), (2, sum(a * b for a, b in zip(v[0], v[2], strict=True)))]


PAGES = [(1, "u1", "<p>same</p>"), (2, "u2\r\nX: y", "<p>same</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 40_000), (6, "u6", "<p>same</p>"), (None, "u", "alone"), (8, "u8", "WARC/1.1\r\n\r\n"), (6, "u6", "<p>same</p>")]


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in PAGES], "page_id long, url string, html string, digest string, offset int")
    rows = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archived_pages(pages, split_bytes=split).collect())
    largest = {}
    for i, _, h in PAGES:
        largest[h or ""] = max(largest.get(h or "", -1), i or -1)
    want = []
    for i, _, h in PAGES:
        b, top = (h or "").encode(), largest[h or ""]
        again = i is not None and top != i
        want.append((i or 0, len(b), digest_of(b), "revisit" if again else "response", top if again else None))
    assert rows == sorted(want)


def test_warc_least_bytes_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in archived_pages(pages, min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert archived_pages(pages.limit(0)).count() == 0
    folder = f"file://{tmp_path}/w"
    assert write_warc(pages, folder) == 4
    payloads = [bytes(r.payload) for r in read_warc(spark, folder, split_bytes=100).where("record_type = 'response'").collect()]
    assert sorted(payloads) == [b"ab", b"abcdef"]


def test_reader_skips_what_only_looks_like_a_member():
    body = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    noise = b"\x1f\x8b\x08\x00junk" + gzip.compress(b"not a record")
    data = noise + gzip.compress(body) + gzip.compress(body)
    for split in (3, 50, 10**6):
        found = [o for s in range(0, len(data), split) for o, _ in records(io.BytesIO(data), s, min(s + split, len(data)))]
        assert found == [len(noise), len(noise) + len(gzip.compress(body))]


def test_sql_of_the_searches_and_archives(spark, tmp_path):
    import duckdb

    table(spark, vectors(seed=8)).write.parquet(f"{tmp_path}/embeddings.parquet")
    pages = [(i, u, h) for i, u, h in PAGES if i not in (None, 6)] + [(6, "u6", "<p>same</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        for name in ("embeddings", "pages"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = {name: sorted(db.sql(ORACLE_SQL[name]).fetchall()) for name in ("op2_exact_topk", "op4_warc")}
    assert sorted(map(tuple, top_products(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect())) == want["op2_exact_topk"]
    found = archived_pages(spark.read.parquet(f"{tmp_path}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect())) == want["op4_warc"]


def test_warc_record_longer_than_a_chunk(spark):
    import random

    rng = random.Random(2)
    long = "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(1_200_000))
    pages = spark.createDataFrame([(1, "u", long), (2, "u", "x"), (3, "u", long)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in archived_pages(pages, split_bytes=100_000).collect()}
    assert rows[1].payload_bytes == len(long.encode()) > 3 << 20 and rows[1].payload_digest == digest_of(long.encode())
    assert [rows[k].refers_to for k in (1, 2, 3)] == [3, None, None]
