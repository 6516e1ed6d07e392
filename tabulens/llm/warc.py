"""Legacy archives: ARC files written, parsed by version and declared length, and converted to WARC.

An ARC file opens with a version block that names the fields of its header
lines (version 1: URL, IP, date, type, length; version 2 adds result code,
checksum, location, offset and file name).  Records follow by declared length.
The converter gives every record a WARC identifier, an ISO timestamp, a type and
a payload digest, and writes records whose payload already has a response as
revisits.

Archives are written through Spark's text sink, one bounded segment a file, so
a lost executor only repeats its tasks and any file system that Spark knows will
do; they are read back with the binaryFile source.

Defined cases: a null html is an empty payload; a null id is left out of the
record and comes back null; a null URL is recorded as ``urn:page:<id>``; white
space in a URL is percent-encoded in the ARC line; rows equal in id and payload
get one response, the others revisit it; an empty table gives no rows; a record
shorter than its declared length is kept and marked ``WARC-Truncated: length``;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm.common import col
from tabulens.session import checkpoint_dir, written_table

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("archive string, position long, url string, ip string, warc_date string, http string, "
                 "page_id long, payload_bytes long, payload_digest string, truncated boolean")


def payload_digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts) -> str:
    """A WARC-Record-ID that depends on the given parts alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def _write_segments(segments: DataFrame, path: str) -> str:
    """One file per segment; the bytes are written as they are, gzipped."""
    (segments.select(F.col("segment").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path))
    return path


# ---------------------------------------------------------------- ARC

def arc_header(fields: list[str], values: dict) -> bytes:
    return (" ".join(str(values.get(f, "-")) for f in fields) + "\n").encode()


def arc_version_block(name: str, version: int, date: str) -> bytes:
    fields = ARC_FIELDS[version]
    body = f"{version} 0 tabulens\n{' '.join(fields)}\n\n".encode()
    return arc_header(fields, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date,
                               "Content-type": "text/plain", "Result-code": 200, "Offset": 0, "Filename": name,
                               "Archive-length": len(body)}) + body


def http_response(page_id, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
            f"{own}\r\n").encode() + payload


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = "20000101000000", segment_bytes: int = 8 << 20) -> str:
    """Write pages as ARC files of about ``segment_bytes``; version 1 and 2 take turns."""

    def run(frames):
        parts, size, number = [], 0, 0
        name, version = "", 1

        def opened():
            nonlocal name, version, size
            version = 1 + number % 2
            name = f"pages-{number:05d}.arc"
            parts.append(arc_version_block(name, version, date))
            size = len(parts[0])

        opened()
        for frame in frames:
            for page_id, url, html in zip(frame["page_id"], frame["url"], frame["html"]):
                own = None if page_id is None or pd.isna(page_id) else int(page_id)
                body = http_response(own, (html or "").encode())
                target = "%20".join(url.split()) if url and url.strip() else f"urn:page:{'' if own is None else own}"
                record = arc_header(ARC_FIELDS[version], {
                    "URL": target, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html",
                    "Result-code": 200, "Offset": size, "Filename": name, "Archive-length": len(body)}) + body + b"\n"
                parts.append(record)
                size += len(record)
                if size >= segment_bytes:
                    yield pd.DataFrame({"segment": [b"".join(parts)]})
                    parts.clear()
                    number += 1
                    opened()
        if len(parts) > 1:
            yield pd.DataFrame({"segment": [b"".join(parts)]})

    rows = pages.select(col(id_col).cast("string").alias("page_id"), col(url_col).alias("url"),
                        col(html_col).alias("html"))
    return _write_segments(rows.mapInPandas(run, "segment binary"), path)


def parse_arc(data: bytes):
    """Records of one ARC file after its version block: (position, header fields, body, truncated).

    The version block's own declared length is honoured, and its last line names the fields of all header lines.
    """
    end = data.find(b"\n")
    if end < 0:                          # an empty file holds no records
        return
    length = int(data[:end].rsplit(b" ", 1)[1])
    block = data[end + 1:end + 1 + length]
    lines = block.decode("latin-1").split("\n")
    fields = lines[1].split() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[int(lines[0].split()[0])]
    at = end + 1 + length
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        # only the URL can hold blanks: the other fields are taken from the right
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
        header = dict(zip(fields, values))
        size = int(header["Archive-length"])
        body = data[end + 1:end + 1 + size]
        yield at, header, body, len(body) < size
        at = end + 1 + size


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; a body without a head is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[:end + 4], body[end + 4:])


def http_field(head: str, name: str) -> str | None:
    for line in head.split("\r\n"):
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def warc_date(arc_date: str) -> str:
    """14 digits to ISO 8601; missing digits of a short date are its start."""
    full = arc_date + "00000101000000"[len(arc_date):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def read_arc(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    """Records of all ARC files below ``path``."""

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = []
                for at, header, body, cut in parse_arc(_plain(content)):
                    head, payload = split_http(body)
                    head = head.decode("utf-8", "replace")
                    own = http_field(head, "X-Page-Id")
                    rows.append((name, at, header["URL"], header["IP-address"], warc_date(header["Archive-date"]), head,
                                 int(own) if own is not None else None, len(payload), payload_digest(payload), cut)
                                + ((payload,) if with_payload else ()))
                names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload
                out = pd.DataFrame(rows, columns=names)
                out["page_id"] = out["page_id"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD_SCHEMA + ", payload binary" * with_payload)


# ---------------------------------------------------------------- WARC

def warc_record(kind: str, record_id: str, date: str, block: bytes, more: dict) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, **more, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0,
                segment_bytes: int = 8 << 20, broadcast_rows: int = 100_000) -> str:
    """Convert all ARC files below ``arc_path`` to WARC files.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the smallest id (then archive and
    position) is the response.  The responses that others revisit are joined on the digest; they are broadcast when
    there are at most ``broadcast_rows`` (about 300 bytes each), and shuffled beyond that.
    """
    light = read_arc(spark, arc_path, False).where(F.col("payload_bytes") >= min_revisit_bytes)
    order = F.struct(F.col("page_id").isNull(), "page_id", "archive", "position")
    firsts = written_table(
        light.groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct(order.alias("o"), F.col("url").alias("url"), F.col("warc_date").alias("d"))).alias("f"),
             F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes"),
                F.col("f.o.archive").alias("first_archive"), F.col("f.o.position").alias("first_position"),
                F.col("f.url").alias("first_url"), F.col("f.d").alias("first_date")))
    small = firsts.limit(broadcast_rows + 1).count() <= broadcast_rows
    records = read_arc(spark, arc_path, True)
    joined = records.join(F.broadcast(firsts) if small else firsts,
                          (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")),
                          "left")

    def run(frames):
        parts, size = [], 0

        def opened():
            parts.append(warc_record("warcinfo", record_uuid("warcinfo", uuid.uuid4()), "2000-01-01T00:00:00Z",
                                     b"software: tabulens\r\nformat: WARC File Format 1.1\r\n",
                                     {"Content-Type": "application/warc-fields"}))

        opened()
        for frame in frames:
            for r in frame.itertuples(index=False):
                again = isinstance(r.first_archive, str) and (r.first_archive, r.first_position) != (r.archive, r.position)
                head, payload = r.http.encode(), bytes(r.payload)
                more = {"WARC-Target-URI": r.url, "WARC-IP-Address": r.ip if r.ip != "-" else None,
                        "WARC-Payload-Digest": f"sha1:{r.payload_digest}",
                        "WARC-Truncated": "length" if r.truncated else None,
                        "Content-Type": "application/http; msgtype=response"}
                if again:
                    more |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Target-URI": r.first_url,
                             "WARC-Refers-To-Date": r.first_date,
                             "WARC-Refers-To": record_uuid(r.first_archive, int(r.first_position))}
                block = head if again else head + payload
                more["WARC-Block-Digest"] = f"sha1:{payload_digest(block)}"
                record = warc_record("revisit" if again else "response", record_uuid(r.archive, r.position),
                                     r.warc_date, block, more)
                parts.append(record)
                size += len(record)
                if size >= segment_bytes:
                    yield pd.DataFrame({"segment": [b"".join(parts)]})
                    parts.clear()
                    size = 0
                    opened()
        if len(parts) > 1:
            yield pd.DataFrame({"segment": [b"".join(parts)]})

    return _write_segments(joined.mapInPandas(run, "segment binary"), warc_path)


def parse_warc(data: bytes):
    """Records of one WARC file: (header fields, block), by Content-Length."""
    at = 0
    while True:
        while data[at:at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        header = dict(line.split(": ", 1) for line in lines[1:])
        size = int(header["Content-Length"])
        yield header, data[end + 4:end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of all WARC files below ``path``, digests verified.

    Raises ``ValueError`` in the task when a response's payload does not match its digest.
    """

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for header, block in parse_warc(_plain(content)):
                    if header["WARC-Type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    head = head.decode("utf-8", "replace")
                    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http_field(head, "Content-Length") or 0)
                    if header["WARC-Type"] == "response":
                        size = len(payload)
                        if payload_digest(payload) != digest:
                            raise ValueError(f"payload digest mismatch in {header['WARC-Record-ID']}")
                    own = http_field(head, "X-Page-Id")
                    rows.append((header["WARC-Record-ID"], header["WARC-Target-URI"], header["WARC-Date"],
                                 header["WARC-Type"], int(own) if own is not None else None, size, digest,
                                 header.get("WARC-Refers-To")))
                out = pd.DataFrame(rows, columns=["record_id", "url", "warc_date", "record_type", "page_id",
                                                  "payload_bytes", "payload_digest", "refers_to_id"])
                out["page_id"] = out["page_id"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record_id string, url string, warc_date string, record_type string, page_id long, "
                                  "payload_bytes long, payload_digest string, refers_to_id string")


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC archives and back: one row per page, with the page that a revisit refers to."""
    spark = pages.sparkSession
    arc = write_arc(pages, _folder(spark, "arc"))
    warc = convert_arc(spark, arc, _folder(spark, "warc"), min_revisit_bytes)
    records = written_table(read_warc(spark, warc))
    revisited = (records.where("record_type = 'response'")
                 .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")))
    return records.join(revisited, "refers_to_id", "left")
