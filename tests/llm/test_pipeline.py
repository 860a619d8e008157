"""The corpus pipeline, stage by stage, against plain Python on a small corpus."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from scanloom.llm.encode import encoder  # noqa: E402

from .test_documents import brute_components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    words = {"en": [f"the{k}w" for k in range(90)], "de": [f"der{k}ä" for k in range(90)]}
    docs, labels = [], []
    for k in range(400):
        lang = "en" if k % 3 else "de"
        w = rng.choices(words[lang], k=rng.randint(30, 90))
        toxic, junk = k % 8 == 0, k % 5 == 0
        if toxic:
            w[3:3] = ["vileword"] * 4
        if junk and not toxic:
            w = [x + "###" for x in w]
        docs.append([k, " ".join(w), lang, "src0", 1])
        labels.append((k, int(not junk), int(toxic)))
    for k in range(400, 440):
        copy = docs[k - 300][1].split()
        copy[5] = "changed"
        docs.append([k, " ".join(copy), docs[k - 300][2], "src1", 1])
    docs += [[440, None, "en", "s", 0], [441, "", "en", "s", 0], [None, "no id at all", "en", "s", 1], [7, docs[7][1], "en", "s", 1]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    before = docs.collect()
    clean = stage["toxicity"](spark, docs, corpus)
    kept = clean.collect()
    assert clean.columns == docs.columns
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in before if "vileword" not in (r.text or ""))

    once = stage["near_duplicates"](spark, clean, corpus)
    rows = sorted((r for r in kept if r.doc_id is not None), key=lambda r: r.doc_id)
    _, roots = brute_components([r.text for r in rows])
    heads = {rows[k].doc_id for k, root in enumerate(roots) if root == k}
    found = once.collect()
    assert once.columns == docs.columns and Counter(r.doc_id for r in found) == Counter([*heads, None])
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.doc_id is None or r.text == texts[r.doc_id] for r in found)

    mixed = stage["mixing"](spark, once, corpus)
    uses = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(uses) <= {r.doc_id for r in found}
    good = [r.doc_id for r in found if r.doc_id is not None and r.text and "#" not in r.text]
    assert sum(uses[i] >= 1 for i in good) >= 0.97 * len(good)
    junk = [r.doc_id for r in found if r.text and "#" in r.text]
    assert sum(uses[i] for i in junk) < 0.8 * len(junk)

    pieces, encode = defaultdict(list), encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for r in stage["packing"](spark, mixed, corpus).collect():
        pieces[r.doc_id].append(r)
    by_id = {r.doc_id: r.text for r in found}
    for i, n in uses.items():
        ids = encode.ids(by_id[i]) + b"\2\0\0\0"
        assert sum(r.length for r in pieces[i]) == n * len(ids) // 4
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in pieces[i])


def test_run_and_empty_tables(spark, corpus, tmp_path):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
