"""WARC records kept in ZIP packages, written by tasks and read back by byte ranges.

A package holds stored (uncompressed) members: ``archive/*.warc.gz``, where every record is a gzip member of its own, and
``indexes/*.cdx``, one line per record with its offset in the archive member. The reader never extracts a package: it
reads the end of the file, follows the ZIP64 locator when there is one, parses the central directory, finds where the
stored bytes of a member begin from its local header, and then reads spans of records.

Equal payloads of at least ``MIN_REVISIT`` bytes are written once: the row with the smallest id is a ``response``, the
others are ``revisit`` records that name it and carry the HTTP headers only. Groups are found by digest with a partial
aggregation; the join back is one that adaptive execution can split.

Packages go to a shared folder under names unique to the task attempt, and only names in the written manifest are read,
so a retried task leaves an orphan at worst. Any file system that pyarrow can address by URI will do.

Defined results: a null payload is empty; a null id is written as an empty urn and read back as null; null urls are
empty. Rows that repeat the smallest id are all responses. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.session import scratch_folder

MIN_REVISIT = 100
PACKAGE_BYTES = 64 << 20
SPAN_BYTES = 1 << 20
TASK_BYTES = 16 << 20
_MANIFEST = "package string, records bigint, size bigint"

# Fixed values of the ZIP format: signatures and the value that sends a reader to the ZIP64 fields.
END_SIGNATURE = b"PK\x05\x06"
ZIP64_LOCATOR = b"PK\x06\x07"
ZIP64_END = b"PK\x06\x06"
CENTRAL_ENTRY = b"PK\x01\x02"
LOCAL_ENTRY = b"PK\x03\x04"
FULL_32, FULL_16 = 0xFFFFFFFF, 0xFFFF


class Member:
    """A member of a package as its central directory tells: where its local header is, and its size."""

    def __init__(self, name: str, header: int, size: int, method: int):
        self.name, self.header, self.size, self.method = name, header, size, method


def _end_of_directory(read: Callable[[int, int], bytes], size: int) -> tuple[int, int, int]:
    """(offset, length, entries) of the central directory. ``read(start, length)`` gives bytes of the file."""
    span = min(size, 22 + FULL_16)
    tail = read(size - span, span)
    at = tail.rfind(END_SIGNATURE, 0, max(0, span - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END_SIGNATURE, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file, or cut short")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL_16 or FULL_32 in (length, offset):
        place = size - span + at - 20
        locator = read(place, 20) if place >= 0 else b""
        if locator[:4] != ZIP64_LOCATOR:
            raise ValueError("ZIP64 values without a ZIP64 locator")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != ZIP64_END:
            raise ValueError("the ZIP64 locator points elsewhere")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, length, entries


def members(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The central directory of a package of ``size`` bytes."""
    offset, length, entries = _end_of_directory(read, size)
    raw, at, found = read(offset, length), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL_ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # only fields that are full in the entry are here, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == FULL_32 else plain
                packed = wide.pop(0) if packed == FULL_32 else packed
                header = wide.pop(0) if header == FULL_32 else header
            extra = extra[4 + n :]
        found.append(Member(name, header, packed, method))
        at += 46 + n_name + n_extra + n_comment
    return found


def stored_start(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; records can't be read by range")
    local = read(member.header, 30)
    if local[:4] != LOCAL_ENTRY:
        raise ValueError("the central directory points to no local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    inner = urn.rpartition(":")[2].rstrip(">")
    return int(inner) if inner else None


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record (response, or revisit where ``refers_to`` is given) as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "").replace("\n", "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + payload if refers_to is None else http
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return gzip.compress(head + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(raw: bytes) -> dict:
    """The headers (lower-case names) of an inflated record, with ``http`` (lower-case names) and ``payload``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8").split("\r\n")[1:])}
    fields["payload"] = payload
    return fields


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(folder)
    return found, path


def _writer(folder: str, package_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True))
        row = next(rows, None)
        while row is not None:
            name = f"{uuid.uuid4().hex}.zip"
            index, at = [], 0
            with files.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
                with package.open("archive/records.warc.gz", "w", force_zip64=True) as member:
                    while row is not None and at < package_bytes:
                        raw = record_bytes(*row)
                        member.write(raw)
                        index.append(f"{'' if row[0] is None else row[0]} {at} {len(raw)}\n")
                        at += len(raw)
                        row = next(rows, None)
                package.writestr("indexes/records.cdx", "".join(index))
            yield pa.RecordBatch.from_pydict({"package": [name], "records": pa.array([len(index)], pa.int64()), "size": pa.array([at], pa.int64())})

    return write


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages below ``folder``/packages and returns the manifest (package, records, size) written beside them."""
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first_id")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    typed = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    typed.mapInArrow(_writer(f"{folder}/packages", package_bytes), _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _spans(folder: str, span_bytes: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                with files.open_input_file(f"{base}/{name}") as source:

                    def read(start: int, length: int, source=source) -> bytes:
                        source.seek(start)
                        return source.read(length)

                    listed = {m.name: m for m in members(read, source.size())}
                    starts, sizes, counts = [], [], []
                    for member in [m for n, m in listed.items() if n.startswith("archive/")]:
                        index = listed[member.name.replace("archive/", "indexes/").replace(".warc.gz", ".cdx")]
                        begin, lines = stored_start(read, member), read(stored_start(read, index), index.size).decode().splitlines()
                        for line in lines:
                            offset, length = map(int, line.split(" ")[1:])
                            if starts and sizes[-1] < span_bytes and starts[-1] + sizes[-1] == begin + offset:
                                sizes[-1] += length
                                counts[-1] += 1
                            else:
                                starts.append(begin + offset)
                                sizes.append(length)
                                counts.append(1)
                yield pa.RecordBatch.from_pydict({"package": [name] * len(starts), "start": pa.array(starts, pa.int64()), "size": pa.array(sizes, pa.int64()), "records": pa.array(counts, pa.int64())})

    return spans


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _reader(folder: str, with_payload: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        files, base = _open(folder)
        for batch in batches:
            for name, start, size, count in zip(*(batch.column(c).to_pylist() for c in ("package", "start", "size", "records")), strict=True):
                with files.open_input_file(f"{base}/{name}") as source:
                    source.seek(start)
                    raw = source.read(size)
                rows = []
                while raw:
                    inflate = zlib.decompressobj(31)
                    fields = parse_record(inflate.decompress(raw) + inflate.flush())
                    raw = inflate.unused_data
                    whole, told = fields["warc-type"] == "response", fields["warc-payload-digest"].rpartition(":")[2]
                    digest = hashlib.sha256(fields["payload"]).hexdigest() if whole else told
                    if digest != told:
                        raise ValueError(f"{name}: the payload at byte {start} or later doesn't have its digest")
                    rows.append((
                        _page(fields["warc-record-id"]), len(fields["payload"]) if whole else int(fields["http"]["content-length"]), digest, fields["warc-type"],
                        None if whole else _page(fields["warc-refers-to"]), fields["warc-target-uri"], fields["payload"] if with_payload else None,
                    ))
                if len(rows) != count:
                    raise ValueError(f"{name}: the index tells of {count} records, there are {len(rows)}")
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    return read


def read_packages(spark: SparkSession, folder: str, with_payload: bool = False, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The records of all packages in the manifest of ``folder``; payloads only on request (null for revisits' bodies)."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    tasks = max(1, -(-(manifest.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))  # a fixed number: spans are small rows that stand for much reading
    spans = manifest.select("package").mapInArrow(_spans(f"{folder}/packages", span_bytes), "package string, start bigint, size bigint, records bigint")
    found = spans.repartition(tasks, "package", "start").mapInArrow(
        _reader(f"{folder}/packages", with_payload),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary",
    )
    return found if with_payload else found.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a fresh shared folder and reads the records back."""
    folder = scratch_folder(pages.sparkSession, "warc")
    write_packages(pages, folder)
    return read_packages(pages.sparkSession, folder)
