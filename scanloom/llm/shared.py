"""Folders that the driver and every executor can reach, and small byte helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import struct
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session may go without it: there a folder of this machine is set up. On a cluster an unset
    folder is an error, since files of one machine are invisible to the others.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + os.path.join(tempfile.gettempdir(), f"scanloom-{os.getuid()}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


_made: list[str] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder URI below the shared root; it goes when the driver ends."""
    _made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@atexit.register
def _remove_made() -> None:
    for uri in _made:
        with contextlib.suppress(Exception):
            store, path = filesystem(uri)
            store.delete_dir(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared root and read it back: cuts the lineage, survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_finished(spark: SparkSession) -> None:
    """Collect the garbage of the driver's JVM, and with it the shuffles and broadcasts of finished queries on all machines.

    Spark drops those only when the driver happens to collect; in a loop of queries its heap grows before that.
    """
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path, usable on the driver and in executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write) -> str:
    """Call write(stream) on a private file, then move it to uri/name, so a retried task leaves one whole file."""
    store, folder = filesystem(uri)
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        write(out)
    store.move(temporary, f"{folder}/{name}")
    return f"{folder}/{name}"


#: Tables that operators keep in a Python worker from task to task.
WORKER_CACHES: list[dict] = []


def make_room(keep: dict | None = None) -> None:
    """Give back what other operators have left in this Python worker, before a task that needs memory.

    Their tables go, but for `keep`, and so does memory that is free but still held by the process.
    """
    for table in WORKER_CACHES:
        if table is not keep:
            table.clear()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Keys of a Remembered beyond that length are not kept.
LONGEST_REMEMBERED = 48


class Remembered(dict):
    """A dict that computes missing values; half full, its entries become the old generation, and older ones go."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.half, self.old = compute, entries // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.half:
                self.old = dict(self)
                super().clear()
            self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Groups to deal `amount` (bytes, rows) into: of at most about `each`, and no fewer than there are shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(amount) // each))


def text_bytes(rows: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts and some for each row: one scan that reads the column and keeps two numbers."""
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    return 16 * n + (total or 0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed blob; see unpack."""
    import zstandard

    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        out += [struct.pack("<cI", a.dtype.char.encode(), len(a)), np.ascontiguousarray(a).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, length = struct.unpack_from("<cI", raw, at)
        a = np.frombuffer(raw, np.dtype(kind.decode()), length, at + 5)
        at += 5 + a.nbytes
        out.append(a)
    return out


def least_unsigned(a: np.ndarray) -> np.ndarray:
    """The same values in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
