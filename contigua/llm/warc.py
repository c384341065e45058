"""Web archives: legacy ARC files converted to WARC.

An ARC file starts with a version block; each record has one header line, whose fields
depend on the version (5 in version 1, 10 in version 2), and as many content bytes as
the line declares. The converter reads both and makes WARC records of them: an id from
the record's place and content, a timestamp from the 14-digit date, the type, and the
payload digest. Archives are rows (archive, content) of a table in shared storage, a few
MB each, so every task reads and writes whole archives and a lost one is made again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import cut, ship

ARCHIVE_BYTES = 4 << 20
# The field lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe_url(url: str | None) -> str:
    """A URL without white space or control characters; a missing one is a dash."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def http_response(payload: bytes, page_id: int | None) -> bytes:
    name = "" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {name}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 contigua\n{FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, at: int, url: str, ip: str, date: str, mime: str, content: bytes) -> bytes:
    extra = f" 200 {digest(content)} - {at} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{extra} {len(content)}\n".encode() + content + b"\n"


def arc_records(data: bytes):
    """Yields (offset, fields, content) of each record, the version block left out.

    ``data`` is plain or gzip, in one member or many; offsets count unpacked bytes.
    """
    data = unzipped(data)
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no end of the header line at {at}")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        if version is None:
            length = int(line.rsplit(" ", 1)[1])
            version = int(data[stop + 1 : stop + 1 + length].split(b" ", 1)[0])
            if version not in FIELDS or not line.startswith("filedesc://"):
                raise ValueError(f"not an ARC version block: {line[:80]!r}")
        else:
            names = FIELDS[version].split(" ")
            values = line.rsplit(" ", len(names) - 1)  # a URL may hold spaces
            if len(values) != len(names):
                raise ValueError(f"{len(values)} fields at {at}, version {version} has {len(names)}")
            fields = dict(zip(names, values, strict=True))
            length = int(fields["Archive-length"])
            if stop + 1 + length > len(data):
                raise ValueError(f"the record at {at} is cut off")
            yield at, fields, data[stop + 1 : stop + 1 + length]
        at = stop + 1 + length


def payload_of(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP headers (lower-case names), the header bytes and the payload; all is payload if there is no HTTP."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, b"", content
    headers = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, head + gap, payload


def warc_date(arc_date: str) -> str:
    d = (arc_date + "0101000000"[max(0, len(arc_date) - 4) :])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return zipped(head.encode() + block + b"\r\n\r\n")


def zipped(data: bytes) -> bytes:
    """A gzip member of its own, the same bytes each time."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def unzipped(data: bytes) -> bytes:
    """A plain or gzip file, in one member or many, in time linear in its size."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        z = zlib.decompressobj(31)
        while not z.eof:
            if at >= len(data):
                raise EOFError("the file ends inside a gzip member")
            out.append(z.decompress(view[at : at + 16_384]))
            at = min(len(data), at + 16_384) - len(z.unused_data)
    return b"".join(out)


def warc_name(archive: str) -> str:
    """The name of the WARC file for an ARC file: its extension changes, nothing else of it."""
    stem = archive.removesuffix(".gz")
    return stem.removesuffix(".arc") + ".warc" + archive[len(stem) :]


def record_id(archive: str, offset: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}#{payload_digest}')}>"


def convert(archive: str, data: bytes, original: dict[tuple[int, bytes], tuple[str, int, int | None]]) -> bytes:
    """An ARC file as WARC. ``original``: by offset and payload (SHA-256), archive, offset and page of the record that a revisit refers to."""
    out = [warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(archive, -1, ""), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Filename": warc_name(archive), "Content-Type": "application/warc-fields"}, b"software: contigua\r\nformat: WARC File Format 1.0\r\n")]
    for at, fields, content in arc_records(data):
        http, head, payload = payload_of(content)
        d = digest(payload)
        first = original.get((at, hashlib.sha256(payload).digest())) if original else None
        block = head if first else content
        headers = {
            "WARC-Type": "revisit" if first else "response", "WARC-Record-ID": record_id(archive, at, d), "WARC-Date": warc_date(fields["Archive-date"]), "WARC-Target-URI": fields["URL"],
            "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": f"sha1:{d}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response" if head else fields["Content-type"],
        }
        if first:
            headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(first[0], first[1], d), "Refers-To-Page": "" if first[2] is None else str(first[2])}
        out.append(warc_record(headers, block))
    return b"".join(out)


def warc_records(data: bytes):
    """Yields (headers, block) of each record of a plain or gzip WARC file."""
    data = unzipped(data)
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["Content-Length"])
        if data[stop + 4 + n : stop + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield headers, data[stop + 4 : stop + 4 + n]
        at = stop + 8 + n


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as a table of ARC files (archive, content), a gzip member for each record; versions take turns."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = at = 0

        def begin():
            nonlocal version, name, parts, size, at
            version = 1 + (task + made) % 2
            name = f"pages-{task:06d}-{made:05d}.arc"
            first = arc_version_block(version, name, date)
            parts, size, at = [zipped(first)], 0, len(first)

        def done():
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pydict({"archive": pa.array([name]), "content": pa.array([b"".join(parts)], pa.binary())})

        version, name = 1, ""
        for b in batches:
            for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not parts:
                    begin()
                record = arc_record(version, name, at, safe_url(url), "0.0.0.0", date, "text/html", http_response(html.encode(), page))
                parts.append(zipped(record))
                at += len(record)
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield done()
                    parts = []
        if parts:
            yield done()

    return cut(rows.mapInArrow(run, "archive string, content binary"), "arc")


def convert_arcs(arcs: DataFrame) -> DataFrame:
    """A table of ARC files as a table of WARC files.

    Of records with equal payloads the one with the smallest page (X-Page-Id; missing
    ones last, then by archive and offset) is a response, the others revisit it. Archives
    should have names of their own: of two with one name, a record of equal place and
    payload in both counts as one.
    """
    ship(arcs.sparkSession)

    def index(batches):
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for at, _, content in arc_records(data):
                    http, _, payload = payload_of(content)
                    page = http.get("x-page-id") or None
                    rows.append((name, at, page and int(page), len(payload), hashlib.sha256(payload).digest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["archive", "at", "page", "size", "sha"])

    records = cut(arcs.mapInArrow(index, "archive string, at long, page long, size long, sha binary"), "arc-index")
    firsts = records.groupBy("sha", "size").agg(F.min(F.struct(F.col("page").isNull().alias("no"), "page", "archive", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Only records that revisit another need a row here.
    links = records.join(firsts.select("sha", "size", "first"), ["sha", "size"]).where("archive <> first.archive or at <> first.at").select("archive", "at", "sha", F.col("first.archive").alias("f_archive"), F.col("first.at").alias("f_at"), F.col("first.page").alias("f_page"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        original = {(r["at"], r["sha"]): (r["f_archive"], r["f_at"], r["f_page"]) for r in right.to_pylist()}
        names, out = left.column("archive").to_pylist(), []
        for name, data in zip(names, left.column("content").to_pylist(), strict=True):
            out.append(convert(name, data, original))
        return pa.table({"archive": pa.array([warc_name(n) for n in names], pa.string()), "content": pa.array(out, pa.binary())})

    return cut(arcs.groupBy("archive").cogroup(links.groupBy("archive")).applyInArrow(run, "archive string, content binary"), "warc")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """Rows of the response and revisit records: page_id, url, date, record_id, record_type, payload_bytes, payload_digest, refers_to, refers_to_id.

    Each block and each response's payload is digested anew and held against its header.
    """
    ship(warcs.sparkSession)
    schema = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string"

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                for h, block in warc_records(data):
                    if h["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = payload_of(block)
                    told = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if digest(block) != h.get("WARC-Block-Digest", "sha1:" + digest(block)).removeprefix("sha1:"):
                        raise ValueError(f"the block of {h['WARC-Record-ID']} is not what its digest says")
                    page, first = http.get("x-page-id") or None, h.get("Refers-To-Page") or None
                    if h["WARC-Type"] == "response":
                        if digest(payload) != told:
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} is not what its digest says")
                        n = len(payload)
                    else:
                        n = int(http["content-length"])
                    rows.append((page and int(page), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"], h["WARC-Type"], n, told, first and int(first), h.get("WARC-Refers-To")))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64() if " long" in s else pa.string() for s in schema.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[s.split()[0] for s in schema.split(",")])

    return warcs.select("content").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: the rows of ``read_warcs``.

    Null html is an empty payload, a null url a dash; null ids come last among equals.
    Rows that repeat an id are records of their own. An empty table gives no rows.
    """
    return read_warcs(convert_arcs(write_arcs(pages, **columns)))


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of ``folder`` (mounted on every executor): archive, bytes."""

    def run(batches):
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, data in zip(names, b.column(1).to_pylist(), strict=True):
                os.makedirs(folder, exist_ok=True)
                held = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(held, "wb") as f:
                    f.write(data)
                os.replace(held, os.path.join(folder, name))  # a repeated task writes the same file
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"archive": pa.array(names), "bytes": pa.array(sizes, pa.int64())})

    return archives.mapInArrow(run, "archive string, bytes long")
