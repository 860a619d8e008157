"""Token counts, packing, token tables, near-duplicates, toxicity, mixing and licences on small documents."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from scanloom.llm import jaccard, licenses, mixing, packing, token_counts as counting, toxicity  # noqa: E402
from scanloom.llm.encode import encoder  # noqa: E402
from scanloom.llm.license_texts import FILES, TEXTS  # noqa: E402
from scanloom.llm.packing import SumOfSquares, filled, pack_documents  # noqa: E402
from scanloom.llm.set_join import Groups, SetJoin  # noqa: E402
from scanloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from scanloom.llm.shingles import batch_sets  # noqa: E402
from scanloom.llm.sstable import lookup, read_token_tables, token_tables, write_token_tables  # noqa: E402
from scanloom.llm.token_counts import token_counts  # noqa: E402

SCHEMA = "doc_id long, text string, part int, block long, n long, id string"
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "tab\tnew\nline", "a\x1cb\u0085c d", "<|endoftext|> x<|ENDOFTEXT|>", "İß Σας é é", "日本 ٣ x²½", "▁ ▁x", "<s></s>", "x" * 5000, "word " * 9000, "it's don't 'tis", "\x00\x01", "same text here now ok", "same text here now ok"]


def frame(spark, texts, ids=None):
    """Documents with more columns, whose names operators also use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_words_encode_as_the_tokenizer_does():
    e = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.by_words
    for t in ODD:
        assert e.ids(t) == np.asarray(e.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts(frame(spark, ODD), path).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), t
    assert token_counts(frame(spark, []), path).count() == 0
    assert token_counts(frame(spark, ["a b", "a b"], [None, None]), path).count() == 2


def test_sum_of_squares_choice_is_the_least_rise():
    rng = random.Random(1)
    p = SumOfSquares(16)
    for _ in range(300):
        s = rng.randint(1, 15)
        before = p.level.copy()

        def after(h, s=s, before=before):
            n = before.copy()
            if h:
                n[h] -= 1
            if h + s < 16:
                n[h + s] += 1
            return int((n[1:16] ** 2).sum())

        options = [0, *[h for h in range(1, 17 - s) if before[h]]]
        assert after(p.choose(s)) == min(map(after, options))
        p.place((0, 0, b"", s))


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    e = encoder(path)
    texts = ODD + ["word " * n for n in (1, 7, 63, 64, 65, 500)]
    rows = pack_documents(frame(spark, texts), path, size=64).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = e.ids(t) + b"\2\0\0\0", 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0
    assert pack_documents(frame(spark, []), path).count() == 0


def test_token_tables_round_trip_and_lookup(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    e = encoder(path)
    ids = [5, -3, None, 5, *range(100, 100 + len(ODD) - 4)]
    folder = f"file://{tmp_path}/tables"
    write_token_tables(frame(spark, ODD, ids), folder, path, end_id=1)
    rows = read_token_tables(spark, folder).collect()
    order = sorted(zip(ids, ODD, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at, want = 0, []
    for i, t in order:
        b = e.ids(t) + b"\1\0\0\0"
        want.append((i, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    found = lookup(folder, [-3, 104, 99])
    assert sorted(found) == [-3, 104] and found[-3].tolist() == [1]
    assert token_tables(frame(spark, []), path).count() == 0


def brute_components(texts):
    up = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = (t or "").translate(up).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            k = len(s & sets[j])
            if s and sets[j] and 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts(seed, families=6, copies=25):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
            texts.append(" ".join(w).title() if rng.random() < 0.1 else " ".join(w))
    return texts


@pytest.mark.parametrize("block_sets", [96, 4])
def test_jaccard_components(spark, monkeypatch, block_sets):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block_sets)
    texts = ODD + near_texts(3)
    sizes, roots = brute_components(texts)
    got = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(sizes, roots, strict=True))


def test_jaccard_odd_tables(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    long = " ".join(f"v{k}" for k in range(40))
    rows = jaccard.jaccard_components(frame(spark, [long, long, "other words are in this one", long], [7, None, 4, 4])).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(7, 4): 1, (None, None): 1, (4, 4): 2})


def test_set_join_finds_all_links():
    for seed in range(6):
        rng = random.Random(seed)
        sets = []
        for _ in range(120):
            base = rng.choice(sets) if sets and rng.random() < 0.7 else np.array([], np.uint64)
            new = np.array([rng.randint(0, 3000) for _ in range(rng.randint(1, 25))], np.uint64)
            sets.append(np.unique(np.concatenate([base[: len(base)], new])) if rng.random() < 0.8 or not len(base) else base)
        groups = Groups(len(sets))
        list(SetJoin(sets, [len(s) for s in sets], 75, 100).links(groups))
        want = Groups(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    want.join(i, j)
        assert [groups.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_shingles_of_long_texts():
    import pyarrow as pa

    rng = random.Random(5)
    text = " ".join(f"W{rng.randint(0, 10**7)}" for _ in range(400_000))
    a, b = batch_sets(pa.array([text, text.lower().replace(" ", "\n")]))
    assert len(a) and (a == b).all()
    giant = "Q" * (5 << 20)
    c, d = batch_sets(pa.array([f"a b {giant} c d e", f"A b {giant.lower()}\tc d e"]))
    assert len(c) == 2 and (c == d).all()


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best one, then the same on either side of it."""
    out = []

    def split(lo, hi):
        best = None
        for a in range(lo, hi):
            s = 0
            for b in range(a, hi):
                s += scores[b]
                if s > 0 and (best is None or s > best[2] + 1e-12 or (abs(s - best[2]) <= 1e-12 and b + 1 - a < best[1] - best[0])):
                    best = (a, b + 1, s)
        if best:
            split(lo, best[0])
            out.append(best)
            split(best[1], hi)

    split(0, len(scores))
    return out


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(60):
        s = rng.normal(-0.2, 1, rng.integers(1, 30))
        got, want = toxicity.maximal_segments(s), brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity(spark):
    rng = random.Random(4)
    calm, bad = [f"calm{k}" for k in range(300)], ["vile", "nasty", "horrid"]
    texts, toxic = [], []
    for k in range(600):
        w = rng.choices(calm, k=rng.randint(5, 80))
        if k % 6 == 0:
            at = rng.randrange(len(w))
            w[at:at] = rng.choices(bad, k=3)
        texts.append(" ".join(w))
        toxic.append(int(k % 6 == 0))
    docs = frame(spark, [*texts, None, "", "vile " * 20_000], [*range(602), None])
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 603
    by = {r.doc_id: r for r in rows}
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(600))
    held = [k for k in range(600) if by[k].held_out]
    assert np.mean([by[k].predicted == toxic[k] for k in held]) > 0.95
    assert by[600].predicted == by[601].predicted == 0 and by[None].predicted == 1
    p = by[0].passages[0]
    assert set(texts[0].lower()[p.start : p.end].split()) & set(bad)
    assert toxicity.without_toxic(docs, toxicity.fit(docs, labels)).columns == docs.columns
    nothing = labels.where("toxic = 0")
    assert toxicity.toxicity(docs, nothing).where("predicted = 1").count() == 0
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_mixing_meets_targets_and_matches_a_dense_fit(spark):
    rng = random.Random(6)
    texts, domain = [], []
    for k in range(300):
        d = "ab"[k % 3 == 0]
        texts.append(" ".join(rng.choices(["wüßte", "über", "für"] if d == "a" else ["what", "who", "how"], k=rng.randint(3, 60))))
        domain.append(d)
    docs = frame(spark, [*texts, None, ""], [*range(301), None])
    labelled = spark.createDataFrame([*enumerate(domain), (None, "a"), (4, None)], "doc_id long, domain string")
    rows = mixing.mix(docs, labelled, {"a": 0.25, "b": 0.75}).collect()
    assert len(rows) == 302 and all(r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    for d, w in (("a", 0.25), ("b", 0.75)):
        assert abs(sum(r.domains[d] * r.rate for r in rows) - w * total) < 1e-3 * total
    a = np.array([[r.domains["a"], r.domains["b"]] for r in rows])
    r = np.ones(len(a))
    for _ in range(50):
        live = r > 0
        r = np.maximum(0, r - a @ np.linalg.solve(a[live].T @ a[live], a.T @ r - np.array([0.25, 0.75]) * total))
    assert np.allclose(r, [x.rate for x in rows], atol=1e-2)
    assert {x.rate for x in rows if x.n_tokens == 0} == {1.0}
    fit = mixing.Fit([[0.0, 0.0]], [], [])
    again = mixing.resampled(docs, fit, mixing.fit_classifier(docs, labelled))
    assert again.columns == docs.columns and sorted(map(repr, again.collect())) == sorted(map(repr, docs.collect()))


def test_stock_license_files(spark):
    mark, known = "Copyright (c) 2021, Some Body\nAll rights reserved.\n\n", dict(TEXTS)
    files = {f: open(os.path.join(FILES, f), encoding="utf-8").read() for f in os.listdir(FILES)}
    filled = files["Apache-2.0.txt"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Some Body")
    assert filled != files["Apache-2.0.txt"]
    stock = [("MIT", "MIT License\n\n" + mark + known["MIT"]), ("MIT", "The MIT License (MIT)\n\n" + mark + known["MIT"]), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + mark + known["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")), ("ISC", "ISC License\n\n" + mark + known["ISC"]), ("Apache-2.0", filled), ("GPL-3.0-only", files["GPL-3.0-only.txt"].split("How to Apply These Terms")[0])]
    stock += [("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.\n\n" + known["WTFPL"].split("is changed.")[-1])]
    stock += [(f.removesuffix(".txt"), t) for f, t in files.items()]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(frame(spark, [t for _, t in stock])).collect()}
    assert [got[k] for k in range(len(stock))] == [name for name, _ in stock]


def test_licenses(spark):
    mit = dict(TEXTS)["MIT"]
    spelt = "Copyright (c) 2020 Some Body\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace("\n", "\n\n  ").replace(",", " ;")
    texts = [mit, spelt, mit + " more", "Text.\n\n  Released under  the MIT licence!\nLicensed under CC BY-NC 4.0.", None, "", mit.replace(" ", "\n", 40)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[k].license_id for k in range(7)] == ["MIT", "MIT", None, None, None, None, "MIT"]
    assert got[0].digest == got[1].digest and got[4].digest == got[5].digest
    assert got[3].notice_ids == ["CC-BY-NC-4.0", "MIT"] and got[5].notice_ids == []
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
    assert licenses.scan_licenses(frame(spark, [mit, mit], [None, None])).where("license_id = 'MIT'").count() == 2


def long_text(seed, words=60_000):
    rng = random.Random(seed)
    return " ".join(rng.choice(["it's", "Straße", "x²", "", "日本", "\n", f"w{rng.randint(0, 10**6)}"]) for _ in range(words))


def test_token_counts_of_long_texts_and_several_blocks(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(counting, "BLOCK_CHARS", 100_000)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, long_text(1, 300_000), *[f"common words {k} in every block " * 900 for k in range(20)]]
    assert len(texts[len(ODD)]) > 1 << 20
    got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, texts).coalesce(1), path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_packing_and_tables_of_long_texts(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    e = encoder(path)
    text = long_text(2)
    want = np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rows = sorted(pack_documents(frame(spark, [text, "b"]), path).where("doc_id = 0").collect(), key=lambda r: r.start)
    ids = want + b"\2\0\0\0"
    assert sum(r.length for r in rows) == len(ids) // 4 and all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in rows)
    (row,) = token_tables(frame(spark, [text]), path).collect()
    assert (row.n_tokens, row.ids_crc32) == (len(want) // 4 + 1, zlib.crc32(want + b"\1\0\0\0"))


def test_a_repeated_id_fills_several_shards(spark, tmp_path, monkeypatch):
    from scanloom.llm import sstable

    monkeypatch.setattr(sstable, "SHARD_BYTES", 2_000)
    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/tables"
    rng = random.Random(3)
    texts = [f"{rng.random()} text" for _ in range(600)]
    manifest = write_token_tables(frame(spark, texts, [7] * 400 + list(range(100, 300))), folder, path, end_id=1)
    assert sum(m["first"] == m["last"] == 7 for m in manifest) > 1 and max(m["entries"] for m in manifest) < 200
    rows = sorted(read_token_tables(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([7] * 400 + list(range(100, 300)))
    assert sorted(lookup(folder, [7, 8, 150, 299, 300])) == [7, 150, 299]


def test_packed_windows_keep_what_the_method_placed():
    rng = random.Random(5)
    p, total, full = SumOfSquares(512), 0, []
    for k in range(4000):
        n = min(511, max(1, int(rng.lognormvariate(4.5, 1))))
        total += n
        full += filter(None, [p.place((k, 0, b"\0" * 4 * n, n))])
    before = p.rest()
    after = filled([list(w) for w in before], 512)
    size = lambda w: sum(x[-1] for x in w)
    assert sum(map(size, after)) == sum(map(size, before)) and all(size(w) & (size(w) - 1) == 0 and size(w) <= 512 for w in after)
    kept = sorted(map(size, before), reverse=True)[: sum(size(w) == 512 for w in after)]
    assert sum(map(size, full)) + sum(kept) >= 0.95 * total


def test_packing_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN_TOKENS", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["some words to pack " * (k % 40 + 1) for k in range(200)]
    rows = pack_documents(frame(spark, texts), path, size=64).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(range(200))
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 and n <= 64 for n in lengths.values())


def test_words_with_equal_polynomial_hashes_differ(spark):
    word = "a"
    for _ in range(10):  # the Thue-Morse word and its complement meet under any polynomial modulo 2**64
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = jaccard.jaccard_components(frame(spark, [f"{word} one two three four", f"{other} one two three four"])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 1)]


def test_jaccard_of_a_shingle_that_all_documents_hold(spark, monkeypatch):
    rng = random.Random(8)
    common = "these words stand at the head of every one of the documents here"
    texts = [f"{common} {' '.join(f'u{rng.randint(0, 10**9)}' for _ in range(rng.randint(0, 12)))}" for _ in range(150)]
    texts += [f"{t} x" for t in texts[:30]] + ["é É " + " ".join(f"Ä{k}" for k in range(60)), "é É " + " ".join(f"ä{k}" for k in range(60))]
    sizes, roots = brute_components(texts)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    got = {r.doc_id: r for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == list(zip(sizes, roots, strict=True))


SETS = "id long, n long, own long, shared binary, prefix array<long>"


def as_set(i, n, own, elements, prefix):
    return (i, n, own, np.sort(np.array(elements, np.uint64)).tobytes(), prefix)


def test_boilerplate_that_cannot_link_makes_no_candidates(spark):
    """10,000 sets of 100 that share 80 elements: not enough to link, and their places in the prefix tell so."""
    boilerplate = list(range(1, 81))
    rows = spark.range(10_000).selectExpr("id", "100L AS n", "20L AS own", "X'00' AS shared", f"array({', '.join(f'{w}L' for w in boilerplate[:6])}) AS prefix")
    assert jaccard._candidate_edges(rows, 75, 100).count() == 0


def test_sets_of_a_chain_meet_their_neighbours_only(spark, monkeypatch):
    """One candidate cluster of 400 sets without a link: a set goes to the blocks of its candidates, not to all 100."""
    rng, met = random.Random(1), []
    rows = []
    for i in range(400):
        popular = rng.sample(range(10_000, 11_000), 6)
        rows.append(as_set(i, 8, 0, [i + 1, i + 2, *popular], [i + 1, i + 2, min(popular)]))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard, "_meetings", lambda *a, real=jaccard._meetings: met.append(real(*a)) or met[-1])
    assert jaccard._links(spark.createDataFrame(rows, SETS), 75, 100).count() == 0
    columns, rows_of = met[0]
    assert 400 <= columns.count() < 4 * 400 and 400 <= rows_of.count() < 4 * 400


def brute_toxicity(texts, toxic, asked):
    """The whole fit and score in plain Python, with segments by their definition."""
    import math

    words = [toxicity.words_of(t) for t in texts]
    held = [Counter(w for ws, y in zip(words, toxic, strict=True) if y == c for w in set(ws)) for c in (0, 1)]
    n0, n1 = sum(held[0].values()), sum(held[1].values())
    weight, scores, clean = 0.2 * (n0 + n1), {}, {}
    for w in sorted(set(held[0]) | set(held[1])):
        prior = weight * (held[0][w] + held[1][w]) / (n0 + n1)
        y0, y1 = held[0][w] + prior, held[1][w] + prior
        odds = math.log(y1 / (n1 + weight - y1)) - math.log(y0 / (n0 + weight - y0))
        if abs(odds) / math.sqrt(1 / y1 + 1 / y0) >= 4:
            scores[w], clean[w] = odds, held[0][w]
    chance = [(clean[w] + 0.5) / (n0 + 0.5 * len(scores)) for w in scores]
    terms = [*zip(scores.values(), chance, strict=True), (-0.05, max(0.0, 1 - sum(chance)))]
    low, high = 1e-9, 64.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(p * math.exp(mid * s) for s, p in terms) < 1 else (low, mid)
    decay = high

    def best(ws):
        return sorted((decay * s for *_, s in brute_segments([scores.get(w, -0.05) for w in ws])), reverse=True)

    tops = [best(ws)[0] - math.log(len(ws)) for ws, y in zip(words, toxic, strict=True) if not y and best(ws)]
    log_k = sum(tops) / len(tops) - 0.5772156649 if tops else -0.5772156649

    def x_of(ws):
        total, most = 0.0, -math.inf
        for r, v in enumerate([s - log_k - math.log(len(ws)) for s in best(ws)], 1):
            if v <= 0 and r > 1:
                break
            total += v
            chance = math.factorial(r) * math.factorial(r - 1)
            most = max(most, -math.log(math.exp(-total) * total ** (r - 1) / chance) if total > 1 else total)
        return math.asinh(max(most, -20.0))

    xs = [x_of(ws) for ws in words]
    k = sum(toxic)
    goal = [(k + 1) / (k + 2) if y else 1 / (len(toxic) - k + 2) for y in toxic]
    a = b = 0.0
    for _ in range(20_000):  # plain Newton steps with halving
        p = [1 / (1 + math.exp(-(a * x + b))) for x in xs]
        ga, gb = sum((g - q) * x for g, q, x in zip(goal, p, xs, strict=True)) - 1e-6 * a, sum(g - q for g, q in zip(goal, p, strict=True)) - 1e-6 * b
        h = [q * (1 - q) for q in p]
        haa, hab, hbb = sum(v * x * x for v, x in zip(h, xs, strict=True)) + 1e-6, sum(v * x for v, x in zip(h, xs, strict=True)), sum(h) + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 1 / max(abs(da), abs(db), 1e-12))
        a, b = a + scale * da, b + scale * db
        if max(abs(da), abs(db)) < 1e-12:
            break
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, a * x_of(toxicity.words_of(t)) + b)))) for t in asked]


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(14)
    long = "q" * 65  # longer than a word has to be
    texts, toxic = [], []
    for k in range(240):
        w = rng.choices([f"calm{j}" for j in range(60)], k=rng.randint(4, 30))
        if k % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                w[at:at] = rng.choices(["vile", "nasty", long], k=2)
        elif k % 9 == 0:
            w.append("vile")
        texts.append(" ".join(w))
        toxic.append(int(k % 4 == 0))
    fitted = [k for k in range(240) if zlib.crc32(str(k).encode()) % 5]
    asked = [f"{long} calm1 calm2 {long}", "nasty calm3 vile", "calm5 calm6", *texts[:40]]
    want = brute_toxicity([texts[k] for k in fitted], [toxic[k] for k in fitted], asked)
    docs = spark.createDataFrame([(k, t, 0.5, 1) for k, t in enumerate(texts)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert long in model.scores
    more = spark.createDataFrame([(k, t) for k, t in enumerate([*asked, asked[0]])], "doc_id long, text string")
    got = [r.score for r in sorted(toxicity.score(more, model).collect(), key=lambda r: r.doc_id)]
    assert np.allclose(got, [*want, want[0]], atol=1e-6)
    assert toxicity.toxicity(docs.unionByName(docs), labels).count() == 480


def test_toxicity_scores_more_words_than_were_once_kept(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 20001), k -> concat(IF(id % 2 = 0, 'calm', 'vile'), k)), ' ') AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    assert len(toxicity.fit(docs, labels, train_rows=60).scores) == 40_002


def test_mixing_without_labels_and_of_odd_rows(spark):
    docs = frame(spark, ["a b c", None, "", "d e " * 60_000, "a b c"], [1, None, 2, 3, 1])
    none = spark.createDataFrame([], "doc_id long, domain string")
    other = spark.createDataFrame([(77, "x")], "doc_id long, domain string")
    for labelled in (none, other):
        rows = mixing.mix(docs, labelled, {"x": 1.0}).collect()
        assert sorted((r.n_tokens, r.rate, len(r.domains), r.misfit) for r in rows) == [(0, 1.0, 0, 0.0), (0, 1.0, 0, 0.0), (3, 1.0, 0, 0.0), (3, 1.0, 0, 0.0), (120_000, 1.0, 0, 0.0)]
    labelled = spark.createDataFrame([(1, "x"), (3, "y"), (1, "x")], "doc_id long, domain string")
    assert mixing.mix(docs.limit(0), labelled, {"x": 1.0}).count() == 0
    rows = mixing.mix(docs, labelled, {"x": 0.5, "y": 0.5}).collect()
    assert len(rows) == 5 and all(r.rate >= 0 for r in rows)


def test_mixing_says_that_targets_cannot_be_met(spark):
    members = spark.createDataFrame([([1.0, 1.0],), ([2.0, 2.0],)], "tokens array<double>")
    with pytest.raises(ValueError, match="miss the targets"):
        mixing.fit_rates(members, [1.0, 9.0], accept=0.01)
    with pytest.warns(UserWarning, match="miss the targets"):
        fit = mixing.fit_rates(members, [1.0, 9.0])
    assert fit.totals == pytest.approx([5.0, 5.0]) and fit.misfit == pytest.approx(0.8)


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(12)
    kinds = {"a": ["wüßte", "über", "für", "hätte"], "b": ["what", "who", "how"], "c": ["WHAT!!", "WHO!!"]}
    rows = [(k, " ".join(rng.choices(kinds[d], k=rng.randint(2, 40))), d) for k, d in enumerate(rng.choices("abc", k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    c = mixing.fit_classifier(docs, docs.select("doc_id", "domain").where("doc_id < 300"))
    assert c.domains == ["a", "b", "c"] and c.accuracy > 0.95 and c.loss < 0.2
    found = mixing.memberships(docs.where("doc_id >= 300"), c, keep=["domain"]).collect()
    assert np.mean([c.domains[int(np.argmax(r.tokens))] == r.domain for r in found]) > 0.95
    assert all(sum(r.tokens) == pytest.approx(r.n_tokens) for r in found)


def test_sql_of_licenses_on_planted_files(spark, tmp_path):
    import duckdb

    rng, texts = random.Random(15), dict(TEXTS)
    filler = lambda n: " ".join(f"word{rng.randint(0, 999)}" for _ in range(n))
    # DuckDB lowers letter by letter, Spark also where one letter becomes two or depends on its place.
    docs = [*[t for t in ODD if "İ" not in (t or "")], *texts.values(), *[t.upper().replace("\n", "\n\n") for t in texts.values()], *[f"Copyright (c) {k} X\n{t}" for k, t in enumerate(texts.values())]]
    docs += [f"{filler(50)}\nReleased under the MIT license!\n{filler(20)}\n  licensed under CC BY-SA 4.0", long_text(4), f"{texts['MIT']} and more", "a\rb © c\r\nCopyright (c) 1 x"]
    for f in os.listdir(FILES):
        docs.append(open(os.path.join(FILES, f), encoding="utf-8").read())
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(db.sql(ORACLE_SQL["op8_licenses"]).fetchall())
    got = QUERIES["op8_licenses"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "digest", "license_id", "notice_ids").collect())) == want
    assert sum(r[2] is not None for r in want) >= 3 * len(texts) and "CC-BY-SA-4.0,MIT" in [r[3] for r in want]


def test_licenses_join_a_table_of_any_size(spark):
    known = spark.range(20_000).selectExpr("concat('L', id) AS license_id", "concat('licence text number ', id) AS text")
    got = licenses.scan_licenses(frame(spark, ["Licence  text, number 19999", "else"]), licenses.digests(known)).collect()
    assert {r.doc_id: r.license_id for r in got} == {0: "L19999", 1: None}
