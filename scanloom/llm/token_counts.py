"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import least_unsigned, make_room, pack, parts_for, text_bytes, unpack

#: A block is closed at so many characters or documents.
BLOCK_CHARS, BLOCK_DOCS = 16 << 20, 50_000
#: Bytes of text whose pre-tokens one task counts, about.
PART_BYTES = 64 << 20
_PRE_TOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")
_CUT = re.compile(r"(?<! ) |\n")


def pre_tokens(text: str, step: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of the pre-tokens of a text with the word marker in front, at most about `step` characters at a time.

    A pre-token is a run of spaces with the word after it, or a newline with the word after it. No piece of a
    model that `countable` accepts spans two of them, so their piece counts add up to the text's.
    """
    text = " " + text.replace("▁", " ")
    at = 0
    while at < len(text):
        m = _CUT.search(text, at + step) if at + step < len(text) else None
        end = m.start() if m else len(text)
        yield _PRE_TOKEN.findall(text, at, end)
        at = end


def countable(model) -> None:
    """Raise unless pieces never span pre-tokens and the text is taken as it is."""
    pieces = [model.id_to_piece(i) for i in range(len(model))]
    if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("the model has pieces that span pre-tokens")
    if "".join(model.encode(" a  b", out_type=str)) != "▁▁a▁▁b" or model.encode("\nx", out_type=str)[:2] != ["▁", "<0x0A>"]:
        raise ValueError("the model's normaliser changes white space")


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_HEAD = "array<struct<i: long, b: long>>"
_ROW = f"part int, block long, heads {_HEAD}, blob binary"


def _arrow():
    import pyarrow as pa

    head = pa.list_(pa.struct([("i", pa.int64()), ("b", pa.int64())]))
    return pa, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("heads", head), ("blob", pa.binary())])


def _block(rows: list, numbers: _Numbers, parts: int, block: int) -> Iterator[dict]:
    """A row with the block's frequencies, and for each part one with the distinct pre-tokens that are dealt to it.

    The frequencies are, pre-token by pre-token in the order of the parts: how many documents hold it, the documents,
    and how often each does.
    """
    ids = np.concatenate([u for *_, u, _ in rows])
    freq = np.concatenate([f for *_, f in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[-1]) for r in rows])
    names = [n.encode() for n in numbers]
    part = np.fromiter((zlib.crc32(n) for n in names), np.int64, len(names)) % parts
    by_part = np.argsort(part, kind="stable")
    place = np.empty(len(names), np.int64)
    place[by_part] = np.arange(len(names))
    order = np.argsort(place[ids], kind="stable")
    held = np.bincount(place[ids], minlength=len(names))
    yield {"part": block % parts, "block": block, "heads": [{"i": r[0], "b": r[1]} for r in rows], "blob": pack(least_unsigned(held), least_unsigned(doc[order]), least_unsigned(freq[order]))}
    bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
    for p in np.unique(part).tolist():
        mine = [names[i] for i in by_part[bounds[p] : bounds[p + 1]]]
        sizes = np.fromiter(map(len, mine), np.int64, len(mine))
        yield {"part": p, "block": block, "heads": None, "blob": pack(np.frombuffer(b"".join(mine), np.uint8), least_unsigned(sizes))}


def _mapper(parts: int, block_chars: int, block_docs: int):
    def run(batches):
        from pyspark import TaskContext

        make_room()
        pa, schema = _arrow()
        first = TaskContext.get().partitionId() << 32
        rows, numbers, chars, blocks = [], _Numbers(), 0, 0

        def flush():
            nonlocal rows, numbers, chars, blocks
            out = []
            for x in _block(rows, numbers, parts, first + blocks):
                out.append(x)
                if len(out) == 64:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
            rows, numbers, chars = [], _Numbers(), 0
            blocks += 1

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                found = [np.unique(np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)), return_counts=True) for x in pre_tokens(text)] if text else []
                if len(found) > 1:
                    u, inverse = np.unique(np.concatenate([u for u, _ in found]), return_inverse=True)
                    f = np.bincount(inverse, weights=np.concatenate([f for _, f in found])).astype(np.int64)
                elif found:
                    u, f = found[0]
                else:
                    u = f = np.zeros(0, np.int64)
                rows.append((i, len(text.encode()), u, f))
                chars += len(text)
                if chars >= block_chars or len(rows) >= block_docs:
                    yield from flush()
        if rows:
            yield from flush()

    return run


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        countable(_models[path])
    return _models[path]


_models: dict = {}


def _counter(model_path: str):
    """Reducer of a part, row by row: for each block, in the order of its pre-tokens, how many pieces each has."""

    def run(batches):
        pa, schema = _arrow()
        model, pieces = _model(model_path), {}
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                if r["heads"] is not None:
                    continue
                text, sizes = unpack(r["blob"])
                ends, raw = np.cumsum(sizes, dtype=np.int64).tolist(), text.tobytes()
                names = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                new = [n for n in names if n not in pieces]
                # A newline is a byte piece of its own after the model's word marker: two pieces in front of the pre-token's.
                pieces.update(zip(new, (len(x) - 2 for x in model.encode(["\n" + n.decode() for n in new], num_threads=1)), strict=True))
                r["blob"] = pack(least_unsigned(np.fromiter(map(pieces.__getitem__, names), np.int64, len(names))))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _summed(table):
    """The documents of a block: every pre-token's pieces times its frequencies, added up by document."""
    import pyarrow as pa

    heads, postings, counts = None, None, [np.zeros(0, np.int64)]
    for _, h, blob in sorted(zip(table.column("part").to_pylist(), table.column("heads").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda r: r[0]):
        if h is not None:
            heads, postings = h, unpack(blob)
        else:
            counts.append(unpack(blob)[0])
    held, doc, freq = postings
    total = np.bincount(doc, weights=np.repeat(np.concatenate(counts), held) * freq.astype(np.int64), minlength=len(heads)).astype(np.int64)
    return pa.table({"id": pa.array([h["i"] for h in heads], pa.int64()), "n_bytes": pa.array([h["b"] for h in heads], pa.int64()), "n_tokens": pa.array(total)})


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per document: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Each task cuts its documents into blocks and numbers a block's distinct pre-tokens. These are dealt by hash over
    as many parts as the bytes of text ask for; a part encodes every distinct pre-token once and answers each block
    with the counts of its pre-tokens, which are joined there to their frequencies per document and summed. A
    pre-token of all documents is one entry per block, so none is hot; a part is streamed and holds its distinct
    pre-tokens only, a block has at most BLOCK_CHARS characters and one document more.

    Null and empty texts count 0 tokens and 0 bytes. A null id and repeated rows stay, one result row each. An
    empty table gives an empty result. Other columns are not read. A text of any length is split in steps.
    """
    parts = 4 * parts_for(docs.sparkSession, text_bytes(docs, text_col), 4 * PART_BYTES)
    mapped = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_mapper(parts, BLOCK_CHARS, BLOCK_DOCS), _ROW)
    answered = mapped.repartitionById(parts, F.col("part")).mapInArrow(_counter(model_path), _ROW)
    sums = answered.groupBy("block").applyInArrow(_summed, "id long, n_bytes long, n_tokens long")
    return sums.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
