"""WARC archives: writing, normalising whole-file gzip streams, and reading back by a sidecar index.

``write_monolithic`` writes response records into files that are one gzip stream each, as many writers leave them.
``normalise`` inflates such a file once, from its start to its end, and rewrites every record as a gzip member of its
own; beside the archive it writes an index with the offset and length of each member, so that any record can be read
alone. A record may become a revisit on the way: it then refers to another record and carries no payload. ``read``
reads the members by the index. Files are reached through pyarrow's file systems, so the folder may be any that all
machines share and pyarrow knows. Every attempt of a task writes files under new names and returns these, and only what
Spark commits is read later; files that a lost attempt leaves are never listed. Each archive is a task of its own.

``archive`` does all this for a table of pages. Of pages with equal payloads of at least ``least`` bytes, the one with
the largest id is a response and the others revisit it; of repeated rows with that id, the one written last. Smaller
payloads are all responses. A null payload counts as empty; a null url is left out, and control characters in one are
escaped; a null id is kept as null. Pages spread over files of bounded size, and the records of a group of equal
payloads are dealt over many tasks to learn which one they revisit. A payload is held whole, one at a time, whatever its
length. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import bound_batches, filesystem, salted, saved, utf8

#: Bytes of the records of one archive file, headers included, before they are packed; and records, since an index is read whole.
FILE_BYTES, FILE_RECORDS = 32 << 20, 50_000
#: Tasks, at most, that archives are dealt over.
MOST_TASKS = 100_000
CHUNK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(page: int | None, ordinal: str, url: str | None, payload: bytes) -> bytes:
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}:{ordinal}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    head |= {"WARC-Payload-Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}", "Content-Type": "application/http;msgtype=response"}
    return record(head, HTTP % len(payload) + payload)


def page_of(record_id: str) -> int | None:
    number = record_id.strip("<>").split(":")[2]
    return int(number) if number else None


def parse(head: bytes) -> dict[str, str]:
    """Headers of a record, without its version line."""
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream; one record is held at a time."""
    held, more = bytearray(), True
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            got = next(chunks, None)
            if got is None:
                more = False
            else:
                held.extend(got)
        return len(held) >= n

    while True:
        at, end = 0, -1
        while end < 0:
            end = held.find(b"\r\n\r\n", max(at - 3, 0))
            if end < 0:
                at = len(held)
                if not fill(at + 1):
                    if held.strip():
                        raise ValueError("a record is cut off")
                    return
        headers = parse(bytes(held[:end]))
        n = int(headers["Content-Length"])
        if not fill(end + 4 + n + 4):
            raise ValueError("a record is cut off")
        yield headers, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n + 4]


def inflated(stream: Any) -> Iterator[bytes]:
    """What a gzip stream holds, whether of one member or several, in bounded pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


class _Counted:
    """A new file, and how many bytes it has."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.stream, self.size = files.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def dealt(archives: DataFrame) -> DataFrame:
    """The rows (file, ...), spread so that each archive is a task."""
    return archives.repartitionByRange(max(1, min(archives.count(), MOST_TASKS)), "file")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write (id, url, payload) to whole-file gzip streams in the folder; (file, seq, id, n, digest, record) of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        part, k, out, pack, size = TaskContext.get().partitionId(), 0, None, None, 0

        def close() -> None:
            out.write(pack.flush())
            out.close()

        for batch in batches:
            rows = []
            for page, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                payload = payload or b""
                if out is None or size >= FILE_BYTES or seq >= FILE_RECORDS:
                    if out is not None:
                        close()
                        k += 1
                    name, seq, size = f"part-{part:06d}-{k:04d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, 0
                    out, pack = _Counted(files, f"{path}/{name}"), zlib.compressobj(6, zlib.DEFLATED, 31)
                own = f"{part}-{k}-{seq}"
                raw = response(page, own, url, payload)
                out.write(pack.compress(raw))
                rows.append((name, seq, page, len(payload), hashlib.sha1(payload).hexdigest(), own))
                seq += 1
                size += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "seq", "id", "n", "digest", "record"])
        if out is not None:
            close()

    return pages.mapInArrow(run, "file string, seq int, id long, n long, digest string, record string")


def revisits(index: DataFrame, least: int) -> DataFrame:
    """(file, seq, to): the records of (file, seq, id, n, digest, record) that revisit another, and that one's record id."""
    long_ = index.filter(F.col("n") >= least)
    groups = saved(long_.groupBy("digest", "n").agg(F.max(F.struct("id", "file", "seq", "record")).alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "copies")
    to = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("kept.id").cast("string"), F.lit("")), F.lit(":"), F.col("kept.record"), F.lit(">"))
    again = salted(long_.select("file", "seq", "digest", "n"), groups, ["digest", "n"], ["file", "seq"])
    return again.filter((F.col("file") != F.col("kept.file")) | (F.col("seq") != F.col("kept.seq"))).select("file", "seq", to.alias("to"))


def revisit(headers: dict[str, str], block: bytes, to: str) -> bytes:
    """The record as a revisit of another: its headers and those of the message, without the payload, whose length is noted."""
    message = block[: block.index(b"\r\n\r\n") + 4]
    head = {k: v for k, v in headers.items() if k != "Content-Length"}
    head |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": to, "WARC-Payload-Length": str(len(block) - len(message))}
    return record(head, message)


def normalise_file(files: fs.FileSystem, source: str, target: str, to: dict[int, str]) -> int:
    """Rewrite one archive, each record a member, beside an index of JSON lines; the number of records."""
    out, index, n = _Counted(files, target), _Counted(files, f"{target}.idx"), 0
    with files.open_input_stream(source, compression=None) as stream:
        for headers, block in records(inflated(stream)):
            raw = revisit(headers, block, to[n]) if n in to else record({k: v for k, v in headers.items() if k != "Content-Length"}, block)
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member, at = pack.compress(raw) + pack.flush(), out.size
            out.write(member)
            index.write(json.dumps({"offset": at, "length": len(member), "id": headers.get("WARC-Record-ID")}).encode() + b"\n")
            n += 1
    out.close()
    index.close()
    return n


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the archives (file, revisits array of (seq, to) or null) from one folder into another; (file, records), with the new names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(target)
        files.create_dir(folder, recursive=True)
        _, origin = filesystem(source)
        for batch in batches:
            old = batch.column(0).to_pylist()
            new = [f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}.warc.gz" for name in old]
            n = [normalise_file(files, f"{origin}/{a}", f"{folder}/{b}", {r["seq"]: r["to"] for r in found or []}) for a, b, found in zip(old, new, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array(n, pa.int64())], ["file", "records"])

    return dealt(archives).mapInArrow(run, "file string, records long")


def read_members(files: fs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a normalised archive, each read alone by the index."""
    with files.open_input_stream(f"{path}.idx", compression=None) as s:
        entries = [json.loads(line) for line in s.read().splitlines()]
    with files.open_input_file(path) as f:
        for e in entries:
            f.seek(e["offset"])
            member = zlib.decompressobj(31)
            raw = member.decompress(f.read(e["length"]))
            if not member.eof or member.unused_data:
                raise ValueError(f"{path}: no member at {e['offset']}")
            got = list(records(iter([raw])))
            if len(got) != 1 or got[0][0].get("WARC-Record-ID") != e["id"]:
                raise ValueError(f"{path}: another record at {e['offset']}")
            yield got[0]


def read(archives: DataFrame, folder: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives (file); digests of responses are those of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for h, block in read_members(files, f"{path}/{name}"):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if h["WARC-Type"] == "revisit":
                        n, digest, to = int(h["WARC-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), page_of(h["WARC-Refers-To"])
                    else:
                        n, digest, to = len(payload), hashlib.sha1(payload).hexdigest(), None
                    rows.append((page_of(h["WARC-Record-ID"]), n, digest, h["WARC-Type"], to))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return dealt(archives).mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str, *, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives of pages in folder/warc with their indexes; (file, records). The whole-file streams are deleted in the end."""
    bound_batches(pages.sparkSession)
    source = pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[payload_col].cast("string"))
    index = saved(write_monolithic(source, f"{folder}/monolithic"), "index")
    found = revisits(index, least).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "to"))).alias("revisits"))  # a file is of bounded size
    archives = saved(index.select("file").distinct().join(found, "file", "left"), "to-do")
    done = saved(normalise(archives, f"{folder}/monolithic", f"{folder}/warc"), "archives")
    files, path = filesystem(f"{folder}/monolithic")
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)
    return done
