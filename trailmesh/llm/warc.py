"""WARC archives: written with one gzip member per record, read back record by record.

The reader holds one record at a time: it inflates a member piece by piece, cuts header and
content by ``Content-Length``, and checks both digests against what it has read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmesh.llm.arrow import map_batches, slices
from trailmesh.session import checkpointed, scratch_folder

CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
           "payload_digest string, digests_ok boolean, path string, position long")


def http_head(payload_bytes: int) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n"
            ).encode()


def record_uri(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit carries the headers of its payload but not the payload."""
    block = http_head(len(payload)) + (payload if refers_to is None else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def first_of_equal_payloads(pages: DataFrame, least_bytes: int, id_col: str, url_col: str,
                            html_col: str) -> DataFrame:
    """(page_id, url, payload, refers_to): null for the smallest id of equal payloads and for short ones."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null").select("digest", "first")
    )
    # A digest that many pages share is split by the adaptive join; it is one row on the right.
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 100, roll_bytes: int = 256 << 20,
                   date: datetime | None = None) -> DataFrame:
    """Writes a record per row and returns the manifest (path, records, bytes) of the files.

    ``folder`` must be seen by all executors; by default it lies in ``spark.checkpoint.dir``.
    Payload is the html in UTF-8, empty for null. Of equal payloads of at least
    ``least_bytes`` the smallest page id is the response and the others are revisits (rows
    that repeat the smallest id are responses too; rows without an id revisit it). An attempt
    of a task that fails leaves files that no manifest names. A file is closed after
    ``roll_bytes``. Other columns are not read; an empty table gives an empty manifest.
    """
    folder = f"{(folder or scratch_folder(pages.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = first_of_equal_payloads(pages, least_bytes, id_col, url_col, html_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        mark = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        sink, count, size, number = None, 0, 0, 0

        def close() -> dict:
            sink.close()
            name = f"{folder}/{mark}-{number:04d}.warc.gz"
            return {"path": [name], "records": [count], "bytes": [size]}

        for part in slices(batches, "payload"):
            columns = (part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if sink is None:
                    name = f"{base}/{mark}-{number:04d}.warc.gz"
                    sink = store.open_output_stream(name, compression=None)  # the members are gzip already
                member = gzip_member(record(page_id, url, payload, refers_to, stamp))
                sink.write(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    yield close()
                    sink, count, size, number = None, 0, 0, number + 1
        if sink is not None:
            yield close()

    return checkpointed(map_batches(rows, work, MANIFEST))


def read_member(source, waiting: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Inflated pieces of the member at the head of ``waiting``; with the last one, the bytes after it."""
    inflate = zlib.decompressobj(31)
    while True:
        yield inflate.decompress(waiting, CHUNK), b""
        if inflate.eof:
            yield b"", inflate.unused_data
            return
        waiting = inflate.unconsumed_tail or source.read(CHUNK)
        if not waiting:
            raise EOFError("the archive ends inside a record")


def read_records(source) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, block) of every record of an open archive, in order."""
    waiting = source.read(CHUNK)
    while waiting:
        head, block, need = b"", bytearray(), None
        fields: dict[str, str] = {}
        before = source.tell() - len(waiting)
        for piece, after in read_member(source, waiting):
            if need is None:
                head += piece
                end = head.find(b"\r\n\r\n")
                if end >= 0:
                    version, *lines = head[:end].decode().split("\r\n")
                    if not version.startswith("WARC/"):
                        raise ValueError(f"no WARC record at {before}")
                    fields = dict(line.split(": ", 1) for line in lines)
                    need = int(fields["Content-Length"])
                    block += head[end + 4:]
            else:
                block += piece
            waiting = after
        if need is None or len(block) != need + 4 or block[need:] != b"\r\n\r\n":
            raise ValueError(f"the length of the record at {before} is wrong")
        if not waiting:
            waiting = source.read(CHUNK)
        yield before, fields, bytes(block[:need])


def page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def parsed(fields: dict[str, str], block: bytes) -> dict:
    """The columns of one record, digests verified."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    good = hashlib.sha256(block).hexdigest() == fields["WARC-Block-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        good = good and len(payload) == length and hashlib.sha256(payload).hexdigest() == digest
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"], "refers_to": page_of(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length,
        "payload_digest": digest, "digests_ok": good,
    }


def read_archives(manifest: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of the files named in ``manifest``, one file after the other within a task.

    A revisit has no payload, but the length and digest of the one it stands for.
    A file that is cut short, or whose lengths are wrong, or a record that disagrees with one
    of its digests, raises an error, so ``digests_ok`` is true in every row.
    """
    files = manifest.count()
    names = [f.strip().split()[0] for f in RECORDS.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                out, size = {n: [] for n in names}, 0
                with store.open_input_file(name) as source:
                    for position, fields, block in read_records(source):
                        row = parsed(fields, block) | {"path": path, "position": position}
                        if not row["digests_ok"]:
                            raise ValueError(f"a digest of the record at {position} of {path} is wrong")
                        for n in names:
                            out[n].append(row[n])
                        size += len(block)
                        if size >= batch_bytes:
                            yield out
                            out, size = {n: [] for n in names}, 0
                if out["path"]:
                    yield out

    # One task per file: the paths are tiny, and left alone they would all meet in one task.
    return map_batches(manifest.select("path").repartition(max(1, files), "path"), work, RECORDS)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives of ``pages`` and reads them back."""
    return read_archives(write_archives(pages, **options))
