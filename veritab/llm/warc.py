"""WARC archives: a writer and a salvage reader.

The writer makes one gzip member for each record, in files of a bounded size, below the folder that the cluster shares. Its
manifest is a table: files of attempts that failed are not in it. The salvage reader checks each record (gzip's sum, header, length,
block digest). After a failed check it looks for the next valid member or version line, goes on there, and logs the bytes between as
a quarantined gap. It holds one record at a time.

Defined results: null and empty payloads are empty; a null url gives no target URI; a null page_id is kept as null and never
refers to another; rows of the smallest page_id of equal payloads are all responses; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import shared_dir, small_batches, table, written

#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 100
#: A file is closed once it has that many bytes.
FILE_BYTES = 32 << 20
VERSION = b"WARC/1.1"
GZIP = b"\x1f\x8b\x08"
PIECE = 1 << 18
HEADER_LIMIT = 1 << 16
#: A member that unpacks to more bytes is damaged or hostile: no record of it is held.
MEMBER_LIMIT = 1 << 30


def _line(s: str) -> bytes:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s).encode("utf-8", "surrogatepass")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A record, without compression. A revisit has the HTTP header alone, whose Content-Length is the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % ("null" if page_id is None else str(page_id)).encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    head += [b"Content-Type: application/http;msgtype=response", b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(Exception):
    """A record that fails a check."""


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def parse(data: bytes, offset: int, end: int) -> Record:
    """The record that data is, after all checks."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.\d+", lines[0]):
        raise Damaged("no version line")
    headers = {k.strip().decode("latin-1").lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
    if not headers.get("content-length", "").isdigit() or not headers.get("warc-type"):
        raise Damaged("header")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("length")
    block = rest[:n]
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != want.lower():
        raise Damaged("block digest")
    return Record(offset, end, headers, block)


class Salvage:
    """Records and gaps of a seekable file of gzip members, plain records, or both."""

    def __init__(self, f, size: int) -> None:
        self.f, self.size = f, size

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def zipped(self, at: int) -> Record:
        z, out, pos, held = zlib.decompressobj(31), [], at, 0
        try:
            while not z.eof:
                piece = self.read(pos, PIECE)
                if not piece:
                    raise Damaged("cut off")
                pos += len(piece)
                while piece and not z.eof:
                    out.append(z.decompress(piece, PIECE * 16))
                    held += len(out[-1])
                    if held > MEMBER_LIMIT:
                        raise Damaged("too large")
                    piece = z.unconsumed_tail
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        end = pos - len(z.unused_data)
        return parse(b"".join(out), at, end)

    def plain(self, at: int) -> Record:
        head = self.read(at, HEADER_LIMIT)
        stop = head.find(b"\r\n\r\n")
        found = re.search(rb"\r\ncontent-length:\s*(\d+)\s*\r\n", head[: stop + 2], re.I) if stop >= 0 else None
        if not found:
            raise Damaged("header")
        n = stop + 4 + int(found[1]) + 4
        if at + n > self.size:
            raise Damaged("cut off")
        return parse(self.read(at, n), at, at + n)

    def one(self, at: int) -> Record:
        start = self.read(at, 7)
        if start.startswith(GZIP):
            return self.zipped(at)
        if start == b"WARC/1.":
            return self.plain(at)
        raise Damaged("neither a member nor a version line")

    def candidates(self, at: int) -> Iterator[int]:
        """Places from `at` on that begin like a member or a version line."""
        while at < self.size:
            piece = self.read(at, PIECE + 6)
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", piece):
                if m.start() < PIECE:
                    yield at + m.start()
            at += PIECE

    def __iter__(self) -> Iterator[Record | Gap]:
        at = 0
        while at < self.size:
            try:
                got = self.one(at)
            except Damaged as e:
                bad, reason = at, str(e)
                for at in self.candidates(bad + 1):
                    try:
                        got = self.one(at)
                        break
                    except Damaged:
                        continue
                else:
                    yield Gap(bad, self.size, reason)
                    return
                yield Gap(bad, at, reason)
            yield got
            at = got.end


def salvage(data: bytes) -> tuple[list[Record], list[Gap]]:
    found = list(Salvage(io.BytesIO(data), len(data)))
    return [x for x in found if isinstance(x, Record)], [x for x in found if isinstance(x, Gap)]


def write(pages: DataFrame, to: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Archives pages (page_id, url, html) in folder `to`. Returns the folder and the manifest: path, records, bytes."""
    spark = pages.sparkSession
    small_batches(spark)
    to = to or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # one small row for each payload that occurs more than once; the join is on an even key, and a hot one is split by adaptive execution
    first = p.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null").select("digest", "first")
    ready = p.join(first, "digest", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, folder = fs.FileSystem.from_uri(to)
        system.create_dir(folder, recursive=True)
        t = TaskContext.get()
        done, out, path, size, n = 0, None, "", 0, 0
        for b in batches:
            for page_id, url, text, digest, first_id in zip(*(b[c].tolist() for c in ("page_id", "url", "html", "digest", "first"))):
                if out is None:
                    path, size, n = f"{folder}/part-{t.partitionId():05d}-{t.taskAttemptId()}-{done:04d}.warc.gz", 0, 0
                    out = system.open_output_stream(path, compression=None)
                page_id = None if pd.isna(page_id) else int(page_id)
                again = page_id is not None and not pd.isna(first_id) and first_id < page_id
                data = member(record("revisit" if again else "response", page_id, url, text.encode("utf-8", "surrogatepass"), digest, int(first_id) if again else None))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
                    out, done = None, done + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    # ids above 2 ** 53 would not survive pandas' floats in columns with nulls
    rows = ready.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("first").cast("string").alias("first"))

    def exact(batches):
        for b in batches:
            b["page_id"] = pd.Series([None if x is None else int(x) for x in b["page_id"]], dtype=object)
            b["first"] = pd.Series([None if x is None else int(x) for x in b["first"]], dtype=object)
            yield b

    manifest = rows.mapInPandas(lambda batches: run(exact(batches)), "path string, records bigint, bytes bigint")
    return to, written(manifest, "warc-manifest")


RECORD = "path string, offset bigint, end bigint, type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, gap string"


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files, and a row of type `gap` for each quarantined run of bytes."""
    spark = manifest.sparkSession

    def page(x: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", x)
        return int(m[1]) if m else None

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return path, x.start, x.end, "gap", None, None, None, None, None, None, x.reason
        h, payload = x.headers, x.payload
        if h["warc-type"] == "revisit":
            n = re.search(rb"content-length:\s*(\d+)", x.block, re.I)
            return path, x.offset, x.end, "revisit", page(h["warc-record-id"]), h.get("warc-target-uri"), int(n[1]) if n else None, h["warc-payload-digest"].partition(":")[2], page(h.get("warc-refers-to", "")), None, None
        return path, x.offset, x.end, h["warc-type"], page(h.get("warc-record-id", "")), h.get("warc-target-uri"), len(payload), hashlib.sha256(payload).hexdigest(), None, payload if payloads else None, None

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORD.split(", "))])
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for x in Salvage(f, f.size()):
                        rows.append(row(path, x))
                        held += len(rows[-1][9] or b"") + 200
                        if held > 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n).mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    folder, manifest = write(table(spark, sf_dir, "pages"))
    r = read(manifest, folder, payloads=False)
    # archives that were written just now are whole: a gap is an error, not a shorter result
    r = r.where(F.when(F.col("type") == "gap", F.raise_error(F.concat(F.lit("damaged archive: "), "path", F.lit(", "), "gap")).cast("boolean")).otherwise(F.lit(True)))
    return r.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


SQL = f"""
WITH q AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first < page_id THEN first END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
