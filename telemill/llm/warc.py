"""WARC archives packed in ZIP files: writer, and a reader by byte ranges.

An archive written here holds two stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (one line per record with its file, offset and length).  The reader takes any number of
stored members under ``archive/`` and of indexes under ``indexes/``.  It never extracts a member: it range-reads the
end record, the ZIP64 end record where there is one, and the central directory, finds where the stored members begin,
resolves each index line to its member, cuts neighbouring records into blocks of bounded size, deals the blocks out,
and each task range-reads the records of its blocks.

Files go through ``pyarrow.fs``, so the folder may be any store that it knows.  A writing task names its files
by its attempt; only files of attempts that succeeded are in the manifest, so retried tasks leave no record twice.

Defined cases: a null payload is empty; of equal payloads the record with the largest id is the response and
the others revisit it; a null id is smaller than any other; ids are percent-encoded in a record's name, so any text
will do; a null URL has no WARC-Target-URI; line ends in a
URL are percent-encoded; records are kept as often as their rows repeat; no rows give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import join_groups, save, text_of
from telemill.sources.scratch import scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
WARC_DATE = "2024-01-01T00:00:00Z"
#: An archive is closed after so many bytes of records; a block of records is read at once.
ARCHIVE_BYTES, BLOCK_BYTES = 256 << 20, 2 << 20
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Repeated payload digests that are broadcast at most; the name of a record without an id, which no encoded id equals.
MAX_BROADCAST, NO_ID = 200_000, "%"


class _Sink(io.RawIOBase):
    """Write-only view of a stream: ZipFile then streams and needs no seek."""

    def __init__(self, out):
        self._out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, when: str = WARC_DATE) -> bytes:
    """One WARC record, as a gzip member of its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {when}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_zip(out, records: Iterator[tuple[str, bytes]]) -> int:
    """Stream records (id, packed bytes) into an archive of stored members; how many there were."""
    index, at = [], 0
    with zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED) as archive:
        with archive.open(DATA, "w", force_zip64=True) as member:
            for name, packed in records:
                member.write(packed)
                index.append(f"{name} {WARC_DATE} " + json.dumps({"offset": at, "length": len(packed), "filename": DATA}) + "\n")
                at += len(packed)
        archive.writestr(INDEX, "".join(index).encode())
    return len(index)


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        rows = ((r[0], r[1], r[2], r[3]) for b in batches for r in zip(b["_id"], b["_url"], b["_html"], b["_refers"], strict=True))
        told, pending = [], next(rows, None)

        def some() -> Iterator[tuple[str, bytes]]:
            nonlocal pending
            size = 0
            while pending is not None and size < ARCHIVE_BYTES:
                name, url, html, refers = pending
                packed = record(name, url, html.encode("utf-8", "surrogatepass"), refers)
                size += len(packed)
                yield name, packed
                pending = next(rows, None)

        while pending is not None:
            path = f"{root}/part-{attempt}-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                n = write_zip(out, some())
            told.append((path, n, store.get_file_info(path).size))
        yield pd.DataFrame(told, columns=["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record under folder; the manifest (path, records, bytes), already materialised."""
    total = pages.count()
    rows = pages.select(F.col(id_col).alias("_pid"), F.col(url_col).alias("_url"), text_of(html_col).alias("_html"), F.sha1(text_of(html_col)).alias("_sha"))
    groups = rows.groupBy("_sha").agg(F.max("_pid").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    groups = save(groups, "warc-repeated")
    if groups.count() <= MAX_BROADCAST:  # the pages stay where they are
        rows = rows.join(F.broadcast(groups), "_sha", "left")
    else:
        rows = join_groups(rows, groups, "_sha", "_n", total, F.concat(F.lit("row "), F.coalesce(F.col("_pid").cast("string"), F.lit("none"))))
    name = lambda c: F.url_encode(F.col(c).cast("string"))
    refers = F.when(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("_pid")), name("_last"))
    rows = rows.select(F.coalesce(name("_pid"), F.lit(NO_ID)).alias("_id"), "_url", "_html", refers.alias("_refers"))
    spark = pages.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return save(rows.mapInPandas(_writer(folder), "path string, records long, bytes long"), "warc-manifest")


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    got = file.read(length)
    if len(got) != length:
        raise ValueError(f"archive ends before byte {start + length}")
    return got


def directory(file, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (where a stored member's bytes begin, how many), from the central or ZIP64 directory."""
    tail_at = max(0, size - 22 - FULL16)
    tail = _range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        record64 = _range(file, end64, 56)
        if record64[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    entries, at, found = _range(file, start, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, plain, n_name, n_extra, n_comment, local = struct.unpack_from("<10xH8xIIHHH8xI", entries, at)
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra, x = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain, packed, local = (next(wide) if v == FULL32 else v for v in (plain, packed, local))
            x += 4 + n
        at += 46 + n_name + n_extra + n_comment
        if method == 0:
            head = _range(file, local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return found


def _entries(name: str, raw: bytes) -> list[dict]:
    """The lines of an index in order of file and offset."""
    lines = (zlib.decompress(raw, 47) if name.endswith(".gz") else raw).splitlines()
    found = [json.loads(line[line.index(b"{") :]) for line in lines if b"{" in line]
    found = [e | {"offset": int(e["offset"]), "length": int(e["length"])} for e in found]
    return sorted(found, key=lambda e: (e["filename"], e["offset"]))


def _blocks(folder: str):
    def list_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_file(path) as file:
                    members = directory(file, file.size())
                    indexes = [(name, _range(file, *at)) for name, at in sorted(members.items()) if name.startswith("indexes/")]
                out, inside, begin, end = [], None, 0, 0
                for entry in (e for name, raw in indexes for e in _entries(name, raw)):
                    name = entry["filename"]
                    data, _ = members[name if name in members else f"archive/{name}"]
                    start = data + entry["offset"]
                    if inside is not None and (data != inside or start != end or start + entry["length"] - begin > BLOCK_BYTES):
                        out.append((path, begin, end - begin))
                        inside = None
                    inside, begin = data, start if inside is None else begin
                    end = start + entry["length"]
                if inside is not None:
                    out.append((path, begin, end - begin))
                yield pd.DataFrame(out, columns=["path", "start", "length"])

    return list_blocks


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.split(b"\r\n")[1:]:
        name, _, value = line.partition(b": ")
        if name.lower() == b"content-length":
            fields["payload-length"] = value.decode()
    return fields, payload


def _reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = arrow_fs.FileSystem.from_uri(folder)
        bare = lambda urn: urn.removeprefix("<urn:page:").removesuffix(">") if urn else None
        for batch in batches:
            for path, start, length in zip(batch["path"], batch["start"], batch["length"], strict=True):
                with store.open_input_file(path) as file:
                    packed = _range(file, int(start), int(length))
                rows = []
                while packed:
                    gz = zlib.decompressobj(31)
                    fields, payload = parse_record(gz.decompress(packed))
                    packed = gz.unused_data
                    if fields["warc-type"] == "response" and f"sha1:{digest(payload)}" != fields["warc-payload-digest"]:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((bare(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], bare(fields.get("warc-refers-to")), int(fields["payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), payload))
                yield pd.DataFrame(rows, columns=["record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return read


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives that manifest lists."""
    blocks = manifest.select("path").repartition("path").mapInPandas(_blocks(folder), "path string, start long, length long").repartition("path", "start")
    out = blocks.mapInPandas(_reader(folder), "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write pages to archives in the shared folder and read the records back, without their payloads."""
    folder = scratch(pages.sparkSession, "warc")
    read = read_archives(write_archives(pages, folder, id_col), folder, payloads=False)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.when(F.col(c) != NO_ID, F.url_decode(F.col(c))).cast(kind)
    return read.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
