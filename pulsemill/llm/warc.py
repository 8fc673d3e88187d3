"""Web archives in ZIP packages, read in place.

A package is a ZIP file with stored (not compressed) members: ``archive/data.warc.gz``, a
gzip member per record, and ``indexes/index.cdxj``, a line per record with its offset and
length in the archive. A reader parses the ZIP's end record and central directory (ZIP64 as
well), finds where the members' bytes lie in the package, reads the index, and then reads
single records by range; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.llm import files
from pulsemill.llm import words as W

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
#: compressed bytes of a package, about; a record is never cut
PACKAGE_BYTES = 64 << 20
#: payloads with fewer bytes are never replaced by a reference
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


# -- ZIP -------------------------------------------------------------------------------


def members(source) -> dict[str, tuple[int, int, int]]:
    """Name -> (offset of the data, bytes, method) of a ZIP's members, from its directories.

    ``source`` is seekable. Sizes and offsets that do not fit 32 bits come from the ZIP64
    end record and extra fields.
    """
    source.seek(0, 2)
    size = source.tell()
    tail_at = max(0, size - (22 + 0xFFFF + 20))
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end + 3)  # the mark may stand in the comment
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if (count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (wide,) = struct.unpack_from("<Q", tail, end - 20 + 8)
        source.seek(wide)
        record = source.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    source.seek(at)
    directory, pos, found = source.read(length), 0, {}
    for _ in range(count):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, pos + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, pos + 20)
        (header,) = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        x = 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == 1:
                wide, k = extra[x + 4 : x + 4 + n], 0
                for field in ("plain", "packed", "header"):
                    if {"plain": plain, "packed": packed, "header": header}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", wide, k)
                        k += 8
                        if field == "plain":
                            plain = value
                        elif field == "packed":
                            packed = value
                        else:
                            header = value
            x += 4 + n
        source.seek(header)
        local = source.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        skip = sum(struct.unpack_from("<HH", local, 26))
        found[name] = (header + 30 + skip, packed, method)
        pos += 46 + n_name + n_extra + n_note
    return found


def package(parts: dict[str, bytes]) -> bytes:
    """A ZIP file with these members, stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


# -- WARC ------------------------------------------------------------------------------


def record(page_id: int | None, url: str, payload: bytes, digest: str, n_bytes: int, revisit: bool, refers_to: int | None) -> bytes:
    """A record as a gzip member. A revisit's block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!()*~')}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(plain: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The named fields, the HTTP fields and the payload of an unpacked record."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def url_key(url: str) -> str:
    """Host labels from the right, then the path: what an index is sorted by."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return quote(url)
    return f"{host})" + quote(parts.path + ("?" + parts.query if parts.query else ""))


def _number(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def read_package(source) -> Iterator[dict]:
    """The records of an open package in the order of its index, each read by range."""
    found = members(source)
    at, length, method = found[INDEX]
    base, _, stored = found[ARCHIVE]
    if method or stored:
        raise ValueError("archive and index must be stored")
    source.seek(at)
    for line in source.read(length).decode().splitlines():
        entry = json.loads(line.split(" ", 2)[2])
        source.seek(base + entry["offset"])
        fields, http, payload = parse(zlib.decompress(source.read(entry["length"]), 31))
        revisit = fields["warc-type"] == "revisit"
        digest = fields["warc-payload-digest"].partition(":")[2]
        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        yield {
            "page_id": _number(fields["warc-record-id"]), "url": entry["url"], "record_type": fields["warc-type"],
            "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload_digest": digest,
            "refers_to": _number(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
        }


# -- tables ----------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html) -> with ``n``, ``digest``, ``revisit`` and ``refers_to``.

    Payloads that occur once are told apart by a count of their digests, made before any
    page is moved. Adaptive execution splits the join for a payload with many rows. Null
    ids count as largest; rows that share the smallest id of a payload are all responses.
    """
    html = F.coalesce("html", F.lit(""))
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("n"), F.sha2(html.cast("binary"), 256).alias("digest"),
    )
    shared = given.where(F.col("n") >= least).groupBy("digest").agg(
        F.count("*").alias("_rows"), F.min("page_id").alias("_first")
    ).where("_rows > 1").select("digest", "_first", F.lit(True).alias("_shared"))
    again = F.coalesce(F.col("_shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return given.join(shared, "digest", "left").select(
        *given.columns, again.alias("revisit"), F.when(again, F.col("_first")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str | None = None, *, package_bytes: int = PACKAGE_BYTES) -> tuple[DataFrame, str]:
    """Write a record per row of (page_id, url, html); returns (catalog, folder), a row per package.

    Of equal payloads of ``LEAST_SHARED`` bytes or more one is written, the others refer to it.
    A null html is an empty payload and a null url an empty one; repeated rows are written
    each; no pages make an empty catalog; further columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or files.new_folder(spark, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        packed: list[bytes] = []
        lines: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal packed, lines, held, piece
            content = package({ARCHIVE: b"".join(packed), INDEX: "".join(sorted(lines)).encode()})
            name = files.write(folder, f"part-{part:05d}-{piece:05d}", ".wacz", content)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)])], ["file", "records"])
            packed, lines, held, piece = [], [], 0, piece + 1
            return row

        for batch in W.slices(batches, "html"):
            for r in batch.to_pylist():
                url = r["url"] or ""
                one = record(r["page_id"], url, r["html"].encode(), r["digest"], r["n"], r["revisit"], r["refers_to"])
                entry = {"url": url, "mime": "text/html", "digest": f"sha256:{r['digest']}", "offset": held, "length": len(one), "filename": ARCHIVE}
                lines.append(f"{url_key(url)} {''.join(c for c in DATE if c.isdigit())} {json.dumps(entry)}\n")
                packed.append(one)
                held += len(one)
                if held >= package_bytes:
                    yield flush()
        if packed:
            yield flush()

    mark_revisits(pages).mapInArrow(run, "file string, records long").write.parquet(f"{folder}/catalog")
    return spark.read.parquet(f"{folder}/catalog"), folder


def read(catalog: DataFrame, folder: str, *, payload: bool = False) -> DataFrame:
    """A row per record of the packages: page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = files.opened(folder)

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    rows: list[dict] = []
                    for found in read_package(source):
                        rows.append(found)
                        if len(rows) == 1000:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    tasks = max(1, min(100_000, catalog.count()))
    return catalog.select("file").repartition(tasks, "file").mapInArrow(run, schema + ", payload binary" * payload)
