"""Sum-of-squares online packing of tokenised documents into windows of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import only_encoder

#: Tokens of a run, about: a task packs its documents run by run, and holds the ids of a run's open windows.
RUN_TOKENS = 32 << 20


class SumOfSquares:
    """Online packing of items into windows of `size`, by the fill level that leaves the least sum of squared counts.

    `level[h]` counts the open windows filled to h. An item of s tokens goes to an open window of level h, with
    h + s <= size, or to a new one (h = 0), whichever least raises the sum of level[h]**2 over 0 < h < size; ties
    go to the fullest window.
    """

    def __init__(self, size: int):
        self.size, self.level, self.open = size, np.zeros(size + 1, np.int64), defaultdict(list)

    def choose(self, s: int) -> int:
        size, level = self.size, self.level
        h = np.flatnonzero(level[1 : size - s + 1]) + 1
        new = 2 * level[s] + 1 if s < size else 0
        if not len(h):
            return 0
        after = np.where(h + s < size, 2 * level[h + s] + 1, 0)
        rise = after - (2 * level[h] - 1)
        best = len(h) - 1 - int(np.argmin(rise[::-1]))
        return int(h[best]) if rise[best] <= new else 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Place a piece whose last field is its number of tokens; the window's pieces if that fills it."""
        s = piece[-1]
        h = self.choose(s)
        window = []
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
        window.append(piece)
        if h + s == self.size:
            return window
        self.level[h + s] += 1
        self.open[h + s].append(window)
        return None

    def rest(self) -> list[list[tuple]]:
        """The open windows, fullest first; none stays open."""
        out = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.level[:] = 0
        self.open.clear()
        return out


def filled(windows: list[list[tuple]], size: int) -> list[list[tuple]]:
    """The windows with what they lack taken from the emptiest; what is left at last, cut into powers of two.

    A piece is (document, tokens before it, ids, number of tokens); cutting splits the ids. Only the gaps' tokens leave
    the window that they were placed in.
    """
    out, held = [], sorted(windows, key=lambda w: sum(p[-1] for p in w))
    spare, kept = [], 0  # pieces of the emptiest windows, to be taken from the end

    def take(want: int) -> list[tuple]:
        nonlocal kept
        pieces = []
        kept -= want
        while want:
            doc, start, ids, n = spare.pop()
            cut = min(n, want)
            if cut < n:
                spare.append((doc, start, ids[: 4 * (n - cut)], n - cut))
            pieces.append((doc, start + n - cut, ids[4 * (n - cut) :], cut))
            want -= cut
        return pieces

    left = 0
    while left < len(held):
        window = held.pop()
        gap = size - sum(p[-1] for p in window)
        while kept < gap and left < len(held):
            spare.extend(held[left])
            kept += sum(p[-1] for p in held[left])
            left += 1
        if kept < gap:
            spare.extend(window)
            kept += size - gap
        else:
            out.append(window + take(gap))
    while kept:  # full windows, and then the largest power of two that the rest holds
        out.append(take(size if kept >= size else 1 << (kept.bit_length() - 1)))
    return out


def _packer(tokenizer_path: str, end_id: int, size: int, run: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = "doc", "start", "length", "crc", "doc_tokens", "sequence", "offset"
        schema = pa.schema([(n, pa.int64()) for n in names])
        encode, packer = only_encoder(tokenizer_path), SumOfSquares(size)
        sequence, rows, run_tokens = TaskContext.get().partitionId() << 40, [], 0

        def emit(windows):
            nonlocal sequence
            for window in windows:
                offset = 0
                for (doc, total), start, ids, n in window:
                    rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                    offset += n
                sequence += 1

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.ids(text) + end
                total = len(ids) // 4
                whole = total // size * size
                emit([((doc, total), at, ids[4 * at : 4 * (at + size)], size)] for at in range(0, whole, size))
                if whole < total:
                    full = packer.place(((doc, total), whole, ids[4 * whole :], total - whole))
                    if full:
                        emit([full])
                run_tokens += total
                if run_tokens >= run:
                    emit(filled(packer.rest(), size))
                    run_tokens = 0
                if len(rows) >= 10_000:
                    yield batch_of()
        emit(filled(packer.rest(), size))
        if rows:
            yield batch_of()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of tokenised documents and the window each lies in.

    Every document is its ids (no special tokens added) and then `end_id`. What fills whole windows of `size`
    tokens is cut off its front; the rest goes, as the documents arrive, to the fill level chosen by
    `SumOfSquares`. At the end of a run, of RUN_TOKENS tokens or the task, the windows still open are mostly nearly
    full. What they lack is cut from the emptiest of them, and the last part is cut into windows whose lengths are
    powers of two; so nothing is padded, and all other tokens stay where the method placed them.

    Each task packs what it reads and nothing is shuffled; a task holds the ids of a run's open windows (fewer than
    RUN_TOKENS tokens and a document) and of one document. Sequence ids are the partition's number times 2**40 plus a
    counter.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the end id
    alone. A null id and repeated rows are packed like any other row. An empty table gives no rows. Columns
    beside id and text are not read.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_packer(tokenizer_path, end_id, size, RUN_TOKENS), "doc long, start long, length long, crc long, doc_tokens long, sequence long, offset long")
    return pieces.select(F.col("doc").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")
