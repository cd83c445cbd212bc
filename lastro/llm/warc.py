"""WARC archives with an index: write records and where they are, then read chosen records by coalesced byte ranges.

``write_archives`` writes one archive per task (a new one after ``ARCHIVE_BYTES``), each record a gzip member of its own,
and gives the index: file, offset, length, URL, digest and kind of each record. ``read_records`` takes any selection of index rows, deals stretches of
archives over tasks, sorts them by offset, joins ranges with small gaps into one read, and parses the records.

Of pages with equal payloads that with the largest ``page_id`` is stored as a response; the others are revisit records that
name it, and hold the response's HTTP header without the payload. A null html is an empty payload; a null URL has no
WARC-Target-URI; line breaks and other control characters in URLs are percent-encoded. Rows that repeat the largest
``page_id`` are responses each. A null ``page_id`` never is the largest; pages that share a payload and all lack an id are
responses each.

Archives go to a folder that every executor can reach, by Arrow's file systems. A task attempt writes files of its own name
and only the index rows of attempts that succeed are kept, so lost or repeated attempts leave at most unused files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import slices, stored, table
from lastro.session import shared_folder

ARCHIVE_BYTES, STRETCH, GAP, READ = 1 << 30, 32 << 20, 64 << 10, 8 << 20
INDEX = "file string, offset long, length long, url string, page_id long, payload_digest string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC record, a gzip member of its own; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    content = http + payload if kind == "response" else http
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {page_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {clean_url(url)}")
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_name(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    return gzip.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + content + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> dict:
    """The fields and the payload of a record."""
    try:
        whole = gzip.decompress(data)
    except (OSError, EOFError) as error:
        raise ValueError("no WARC record lies where the index says") from error
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    content = rest[: int(fields["Content-Length"])]
    if rest[len(content) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where the index says")
    http, _, payload = content.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("the payload is not what was written")
    number = lambda name: int(x) if (x := fields[name][len("<urn:page:") : -1]) else None
    refers = number("WARC-Refers-To") if "WARC-Refers-To" in fields else None
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers, "payload": payload}


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``record_type`` and ``refers_to``; payloads below ``least`` bytes are all responses."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    newest = stored(keyed.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.max("page_id").alias("newest")), "warc-newest")
    joined = keyed.join(newest, "sha1", "left") if least else keyed.join(newest, "sha1")
    again = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("newest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = EPOCH) -> DataFrame:
    """Write ``pages(page_id, url, html, record_type, refers_to)`` below ``folder``; the stored index of what was written."""

    def write(batches):
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        out, name, offset = None, None, 0
        for batch in slices(batches, "html"):
            index = []
            for page_id, url, html, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to")), strict=True):
                payload = html.encode()
                digest = base32_sha1(payload)
                data = record(page_id, url, payload, digest, kind, refers_to, date)
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                index.append((name, offset, len(data), url, page_id, digest, kind))
                offset += len(data)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*index, strict=True), kinds, strict=True)] if index else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stored(pages.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` names, each checked against its digest."""

    def read(batches):
        where, root = fs.FileSystem.from_uri(folder)
        held: tuple = (None, None)
        names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(rows):
                name, start, length = rows[at]
                stop, last = start + length, at + 1
                while last < len(rows) and rows[last][0] == name and rows[last][1] - stop <= GAP and rows[last][1] + rows[last][2] - start <= READ:
                    stop = max(stop, rows[last][1] + rows[last][2])
                    last += 1
                if held[0] != name:
                    if held[1] is not None:
                        held[1].close()
                    held = (name, where.open_input_file(f"{root}/{name}"))
                data = memoryview(held[1].read_at(stop - start, start))
                found = [parse(data[o - start : o - start + n]) for _, o, n in rows[at:last]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in zip(names, kinds, strict=True)], names=names)
                at = last

    stretch = F.floor(F.col("offset") / STRETCH)
    ranges = index.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(read, RECORDS + ", payload binary" * with_payload)


def op4_warc(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").cast("long"), "url", "html")
    archives = shared_folder(spark, "warc")
    index = write_archives(revisits(pages), archives)
    return read_records(index, archives)


#: DuckDB has no SHA-1 in base 32: five bits at a time, from the hexadecimal digits of the digest.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
n AS (SELECT html, max(page_id) AS newest FROM p GROUP BY html),
b AS (SELECT page_id, html, newest, sha1(html) AS h FROM p JOIN n USING (html)),
d AS (SELECT page_id, html, newest, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h || '0', 1 + (5 * i) // 4, 2) AS INT) >> (3 - (5 * i) % 4)) & 31 AS INT), 1)), '') AS digest FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN newest IS NULL OR page_id IS NOT DISTINCT FROM newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to FROM d
"""
