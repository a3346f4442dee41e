"""WARC archives: monolithic gzip files, a normaliser that gives each record a member, and an offset index.

Records keep the page key in WARC-Record-ID, the payload's SHA-1 in WARC-Payload-Digest, and an HTTP block whose
Content-Length is the payload's; the block of a revisit has no payload. An index file has one line per record:
offset, bytes in the archive, record type.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import new_path, written

LEAST_REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20
FILES = "folder string, path string, index_path string, records long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def with_origins(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Adds payload, its digest and `refers_to`: the largest page_id with the same payload, null for responses.

    Payloads are grouped by SHA-1 and length, and only the keys of payloads that repeat are kept and joined
    back, so copies meet as counts, not as rows. The joined table is written before the join: its
    sides are then plain shuffles, which adaptive execution splits when one payload is a third of all.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    repeated = rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(
        F.max("page_id").alias("origin"), F.count("*").alias("n")).filter("n > 1 and origin is not null").drop("n")
    joined = rows.join(written(repeated, "payloads"), ["digest", "size"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("if(page_id <=> origin, null, origin)").alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(_URN)
    return int(number) if number else None


def record_bytes(row: dict) -> bytes:
    payload, revisit = row["payload"], row["refers_to"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(row["page_id"])), ("WARC-Date", DATE)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Refers-To", _name(row["refers_to"])), ("WARC-Profile", _PROFILE)]
    fields += [("WARC-Payload-Digest", "sha1:" + row["digest"]), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def inflated(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in pieces of at most `chunk` bytes."""
    member, fed = zlib.decompressobj(31), False
    while data := source.read(chunk):
        while True:
            piece = member.decompress(data, chunk)
            fed = True
            if piece:
                yield piece
            if member.eof:
                data, member, fed = member.unused_data, zlib.decompressobj(31), False
                if not data:
                    break
                continue
            data = member.unconsumed_tail
            if not data and len(piece) < chunk:
                break
    if fed:
        raise ValueError("the gzip stream is cut short")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records from a stream; a stream that ends inside of a record is an error."""
    held, start = bytearray(), 0
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", start)
                if end < 0:
                    break
                need = end + 4 - start + int(_fields(held[start:end])["content-length"]) + 4
            if len(held) - start < need:
                break
            yield bytes(held[start : start + need])
            start, need = start + need, None
        if start:
            del held[:start]
            start = 0
    if held:
        raise ValueError("the archive ends inside of a record")


def _fields(head: bytes) -> dict[str, str]:
    lines = bytes(head).decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def parsed(record: bytes) -> tuple:
    """page_id, payload bytes, digest, type and refers_to of a record; a payload that is not its digest's is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page(fields["warc-record-id"]), size, digest, kind, refers


def _open(folder: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    return system, f"{base}/part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"


def _listed(folder: str, path: str, index_path: str | None, n: int) -> pa.RecordBatch:
    cells = [pa.array([folder]), pa.array([path]), pa.array([index_path], pa.string()), pa.array([n], pa.int64())]
    return pa.RecordBatch.from_arrays(cells, names=["folder", "path", "index_path", "records"])


def write_archives(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES, level: int = 1) -> DataFrame:
    """Writes a record per page, one monolithic gzip file per task, and lists the files.

    Reads `page_id`, `url` and `html` only. A null html is an empty payload, a null url has no target, and a null
    page_id has an empty name, never refers to itself and is never referred to. A repeated row of a response is a
    response too. Files lie below the shared folder; only those of surviving tasks are listed.
    """
    folder = new_path(pages.sparkSession, "archives")

    def write_task(batches):
        out = packer = None
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system, path = _open(folder)
                    out, packer = system.open_output_stream(path + ".warc.gz", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(record_bytes(row)))
                n += 1
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield _listed(folder, path + ".warc.gz", None, n)

    return written(with_origins(pages, least_bytes).mapInArrow(write_task, FILES), "archive-list")


def normalise(files: DataFrame, level: int = 6) -> DataFrame:
    """Rewrites archives so that each record is a gzip member of its own, with an index file beside each.

    A file's stream is inflated once, in pieces; one record is held at a time. Files of many members are taken
    too. An empty list of files gives an empty list.
    """
    folder = new_path(files.sparkSession, "normalised")

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(folder)
                source_system, _ = _open(row["folder"])
                n = offset = 0
                with source_system.open_input_stream(row["path"], compression=None) as source, system.open_output_stream(path + ".warc.gz", compression=None) as out, system.open_output_stream(path + ".idx") as index:
                    for record in records(inflated(source)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        kind = _fields(record[: record.index(b"\r\n\r\n")])["warc-type"]
                        out.write(member)
                        index.write(f"{offset}\t{len(member)}\t{kind}\n".encode())
                        offset, n = offset + len(member), n + 1
                if n != row["records"]:
                    raise ValueError(f"{row['path']} holds {n} records, not {row['records']}")
                yield _listed(folder, path + ".warc.gz", path + ".idx", n)

    return written(files.repartition(max(1, files.count())).mapInArrow(task, FILES), "normalised-list")


def read_archives(files: DataFrame) -> DataFrame:
    """Reads normalised archives record by record through their index."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = _open(row["folder"])
                with system.open_input_stream(row["index_path"]) as index:
                    lines = index.read().decode().splitlines()
                held = []
                with system.open_input_file(row["path"]) as source:
                    for line in lines:
                        offset, size, kind = line.split("\t")
                        source.seek(int(offset))
                        held.append(parsed(zlib.decompress(source.read(int(size)), 31)))
                        if held[-1][3] != kind:
                            raise ValueError(f"the index of {row['path']} is wrong")
                        if len(held) == 10_000:
                            yield _read(held)
                            held = []
                if held:
                    yield _read(held)

    return files.repartition(max(1, files.count())).mapInArrow(
        task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _read(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
