"""WARC archives: a writer of one gzip member per record and a reader that splits archives at any byte."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, fresh_dir, publish

GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
_HEAD_LIMIT = 1 << 20
_READ_SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, declared_digest string, declared_bytes long, payload_digest string, payload_bytes long, payload binary"


# ---- writing -------------------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def page_record(page_id, url: str | None, html: str | None, refers_to, date: str) -> bytes:
    """A response record, or a revisit record of the page `refers_to` that holds the HTTP head only."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", url or f"urn:page:{page_id}"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return _record(fields, http + payload)
    return _record([*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def _writer(folder: str, date: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows = ((i, u, h, r) for b in batches for i, u, h, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        head = next(rows, None)
        if head is None:
            return
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def write(out):
            nonlocal n
            out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for part in ((head,), rows):
                for i, url, html, refers_to in part:
                    out.write(page_record(i, url, html, refers_to, date))
                    n += 1

        publish(folder, name, write)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n]})

    return run


def revisits(pages: DataFrame, *, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """The pages with refers_to: of pages with equal payloads of at least min_bytes, the largest id; null for itself.

    The largest id per digest is aggregated on the map side first; the join back is a plain equi-join whose hot
    digest adaptive execution splits.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), "url", F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_bytes, F.sha1("html")))
    first = rows.where("digest is not null").groupBy("digest").agg(F.max("id").alias("largest"))
    return rows.join(first.hint("merge"), "digest", "left").select("id", "url", "html", F.when(F.col("largest") != F.col("id"), F.col("largest")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> int:
    """Write a record per page, an archive per task; returns the number of page records.

    A null html is an empty payload, a null url is replaced by an urn. A page with a null id is a response unless
    its payload occurs under an id. Rows that repeat an id and payload each get a record: all are responses if
    that id is the payload's largest.
    """
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(None).cast("string"))
    rows = revisits(pages, id_col=id_col, html_col=html_col, min_bytes=min_bytes)
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    return sum(r.records for r in rows.mapInArrow(_writer(folder, date), "name string, records long").select("records").collect())


# ---- reading -------------------------------------------------------------------------------------------------


class _Member:
    """Inflates one gzip member of a file from an offset on, chunk by chunk; knows where it ends."""

    def __init__(self, source, offset: int):
        self.source, self.at, self.z = source, offset, zlib.decompressobj(31)

    def chunks(self, step: int = _CHUNK) -> Iterator[bytes]:
        data = b""
        while not self.z.eof:
            if not data:
                self.source.seek(self.at)
                data = self.source.read(step)
                self.at += len(data)
                if not data:
                    raise EOFError("archive ends within a member")
            out = self.z.decompress(data, 4 * _CHUNK)
            data = self.z.unconsumed_tail
            if out:
                yield out
        self.at -= len(self.z.unused_data)


def _starts_record(source, offset: int) -> bool:
    """Whether a gzip member whose content begins like a WARC record starts here."""
    try:
        source.seek(offset)
        out = zlib.decompressobj(31).decompress(source.read(4096), 64)
    except zlib.error:
        return False
    return out.startswith(VERSION)


def _candidates(source, start: int, end: int) -> Iterator[int]:
    """Offsets in [start, end) of the gzip magic, found in overlapping chunks."""
    at = start
    while at < end:
        source.seek(at)
        data = source.read(min(_CHUNK, end - at) + len(GZIP_MAGIC) - 1)
        i = data.find(GZIP_MAGIC)
        while i >= 0:
            if at + i < end:
                yield at + i
            i = data.find(GZIP_MAGIC, i + 1)
        at += _CHUNK


def _parse(member: _Member, keep: bool) -> dict:
    """The record in a member: its fields, and of the payload the digest, the length and, if asked for, the bytes."""
    chunks = member.chunks()
    data = b""
    while b"\r\n\r\n" not in data:
        if len(data) > _HEAD_LIMIT:
            raise ValueError("no end of the record's header")
        data += next(chunks)
    head, _, data = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    left = int(fields["content-length"])
    http = fields.get("content-type", "").startswith("application/http")
    sha, n, kept, front = hashlib.sha1(), 0, [], b""
    while True:
        data, left = data[:left], left - len(data[:left])
        if http:  # the payload is what follows the HTTP head
            front += data
            data = b""
            if b"\r\n\r\n" in front:
                _, _, data = front.partition(b"\r\n\r\n")
                http = False
            elif len(front) > _HEAD_LIMIT:
                raise ValueError("no end of the HTTP head")
        sha.update(data)
        n += len(data)
        if keep:
            kept.append(data)
        data = next(chunks, None)
        if data is None:
            break
    if left:
        raise ValueError("the record is shorter than its Content-Length")
    return {"fields": fields, "digest": base64.b32encode(sha.digest()).decode(), "bytes": n, "payload": b"".join(kept) if keep else None}


def records(source, start: int, end: int, keep: bool = False) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in [start, end) of an open archive."""
    at = start
    while at < end:
        at = next((c for c in _candidates(source, at, end) if _starts_record(source, c)), end)
        while at < end and _starts_record(source, at):
            member = _Member(source, at)
            record = _parse(member, keep)
            yield at, record
            at = member.at


def _reader(keep: bool):
    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _READ_SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("offset", "declared_bytes", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        rows, held = [], 0
        for batch in batches:
            for uri, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store, path = filesystem(uri)
                with store.open_input_file(path) as source:
                    for offset, r in records(source, start, end, keep):
                        f = r["fields"]
                        declared = f.get("warc-payload-digest", "")
                        rows.append((uri, offset, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), declared.removeprefix("sha1:") or None, int(f["x-payload-length"]) if "x-payload-length" in f else None, r["digest"], r["bytes"], r["payload"]))
                        held += len(r["payload"] or b"")
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_warc(spark: SparkSession, folder: str, *, split_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """A row per record of the folder's .warc.gz files.

    Each task takes byte ranges of at most split_bytes, looks for gzip members that open a WARC record, and owns
    the records that start inside its range, reading past the end for the last. A record is inflated in steps;
    without `payloads` only its digest and length are kept.
    """
    from pyarrow import fs

    store, path = filesystem(folder)
    root = folder if "://" not in folder else folder[: folder.index("://") + 3]
    files = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".warc.gz")]
    prefix = "" if root == folder else root
    splits = [(prefix + f.path, at, min(at + split_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, split_bytes)]
    ranges = spark.createDataFrame(splits, "path string, start long, stop long")
    if splits:
        ranges = ranges.repartitionByRange(len(splits), "path", "start")
    return ranges.mapInArrow(_reader(payloads), _READ_SCHEMA)


def archived_pages(pages: DataFrame, *, folder: str | None = None, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0, split_bytes: int = 32 << 20) -> DataFrame:
    """Write the pages as archives and read them back: page id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length come from the payload read back, and a record whose declared digest differs
    raises; a revisit's are those it declares. An empty table gives no rows; columns beside the page's are not read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    write_warc(pages, folder, id_col=id_col, html_col=html_col, min_bytes=min_bytes)
    found = read_warc(spark, folder, split_bytes=split_bytes, payloads=False).where("record_type in ('response', 'revisit')")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1) as long)")
    response = F.col("record_type") == "response"
    wrong = response & (F.col("payload_digest") != F.col("declared_digest"))
    return found.select(
        page("record_id").alias(id_col),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(wrong, F.raise_error(F.lit("payload differs from its digest"))).when(response, F.col("payload_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
