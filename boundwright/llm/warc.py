"""WARC archives with a two-level capture index.

Archives: one gzip member a record. Of pages with equal payloads (by digest and length) that of the largest
page_id is a response; the others are revisits, with headers and without payload, that name it.

Index: a line for each record, keyed by the URL with its host reversed (`org,example)/path`) and the page
id. Lines are dealt out by key range and sorted; each task packs its range into compressed blocks of BLOCK
lines and keeps a sparse directory of them: first key, offset and length of each block. The list of
ranges is as long as there are index files. A lookup sorts its keys, finds the file by binary search in that list,
the block by binary search in the file's directory, reads the block's byte range, and finds the
lines by binary search in it. A second ranged read gets the record.

Files are written by tasks into the shared folder, under names of their own attempt; what a lost or
repeated task wrote is never named by the tables that say what there is, so it is never read.

Which payloads are repeated is settled by digests; an html is moved once, with its own capture, so a payload that a third of all
pages have is no hot key.

Defined results: a null html is an empty payload; equal rows with the largest page_id are each a response; payloads of any
length are one record each; an empty table has no archive and gives an empty result; columns other than page_id, url and html are not read;
a null page_id is less than all others and refers to by null; a null url has an empty key; control
characters of a url are percent-encoded in the record's header.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, shared_dir, table, written

BLOCK, FILE_BYTES, LEVEL, SMALLEST = 512, 256 << 20, 6, 0
CRLF = b"\r\n"
RECORDS = "file string, offset long, length long, key string, page_id long"
RANGES = "file string, first string, last string, directory long, size long"
FOUND = "key string, page_id long, file string, offset long, length long"
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | Column) -> Column:
    """The URL with its host's labels reversed, as `org,example)/path?query`; without `://`: as it is; null: empty."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = url.substr(at + 3, F.length(url))
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?#]*", ""))
    return F.coalesce(F.when(at > 0, key).otherwise(url), F.lit(""))


def capture_key(url: str | Column, page_id: str | Column) -> Column:
    """The key of a capture: that of its url, then its page id in a form that sorts as numbers do."""
    number = F.coalesce(F.col(page_id) if isinstance(page_id, str) else page_id, F.lit(-(1 << 63)))
    stamp = F.concat(F.when(number < 0, "-").otherwise("0"), F.lpad(F.hex(number), 16, "0"))
    return F.concat(url_key(url), F.lit(" "), stamp)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, of: int | None) -> bytes:
    """A WARC record; of: the page id of the response that this one revisits, or None for a response."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + CRLF * 2
    block = http + (payload if of is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if of is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url))
    if of is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{of}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, those of its HTTP block under `http-` names, and its payload."""
    head, _, rest = data.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    fields |= {"http-" + k: v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    return fields, payload


def system(folder: str):
    """The file system of a folder and the folder's path in it; Spark's names of S3 are those of Arrow's s3."""
    return arrow_fs.FileSystem.from_uri(folder.replace("s3a://", "s3://").replace("s3n://", "s3://"))


def opened(folder: str):
    """As `system`, with the folder made."""
    where, path = system(folder)
    where.create_dir(path, recursive=True)
    return where, path


def packed(data: bytes) -> bytes:
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """A record for each of pages (page_id, url, html), in archives below folder; returns where each is (RECORDS)."""
    payload = F.coalesce("html", F.lit(""))
    size = F.octet_length(payload)
    marked = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), size.alias("size"), capture_key("url", "page_id").alias("key"))
    same = ["sha", "size"]
    heads = written(marked.groupBy(same).agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")
    heads = written(marked.select("key", *same).distinct().join(heads, same), "heads")

    def archived(batches):
        where, path = opened(folder)
        out = name = None
        for pdf in batches:
            rows = []
            for page_id, url, html, key, head in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["key"], pdf["head"], strict=True):
                page_id, head = (None if pd.isna(x) else int(x) for x in (page_id, head))
                data = html.encode()
                of = None if head == page_id or len(data) < SMALLEST else head
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out = where.open_output_stream(name, compression=None)
                member = packed(record(page_id, url, data, of))
                rows.append((name, out.tell(), len(member), key, page_id))
                out.write(member)
                if out.tell() >= FILE_BYTES:
                    out = out.close()
            found = pd.DataFrame(rows, columns=["file", "offset", "length", "key", "page_id"])
            found["page_id"] = found["page_id"].astype("Int64")
            yield found
        if out is not None:
            out.close()

    head = F.when(F.col("found"), F.col("head")).otherwise(F.col("page_id"))
    whole = marked.join(heads.withColumn("found", F.lit(True)), ["key", *same], "left").withColumn("head", head).select(F.col("page_id").cast("string"), "url", "html", "key", F.col("head").cast("string"))
    return written(whole.mapInPandas(archived, RECORDS), "records")


class Index:
    """Where the index's files are: sorted by the first key."""

    def __init__(self, folder: str, ranges: list):
        self.folder = folder
        self.ranges = sorted((r.first, r.last, r.file, r.directory, r.size) for r in ranges)
        self.firsts = [r[0] for r in self.ranges]


def index(records: DataFrame, folder: str, block: int = BLOCK) -> Index:
    """The two-level index of records, written below folder. As many rows come to the driver as there are index files."""

    def blocks(batches):
        where, path = opened(folder)
        name, out, held, directory, first, last = f"{path}/{uuid.uuid4().hex}.idx", None, [], [], None, None
        lines = (x for pdf in batches for x in zip(pdf["key"], pdf["page_id"], pdf["file"], pdf["offset"], pdf["length"], strict=True))

        def close_block():
            member = packed("\n".join(held).encode())
            directory.append((json.loads(held[0])[0], out.tell(), len(member)))
            out.write(member)
            held.clear()

        for key, page_id, file, offset, length in lines:
            if out is None:
                out, first = where.open_output_stream(name, compression=None), key
            held.append(json.dumps([key, None if pd.isna(page_id) else int(page_id), file, int(offset), int(length)]))
            last = key
            if len(held) == block:
                close_block()
        if out is not None:
            if held:
                close_block()
            at, listing = out.tell(), packed(json.dumps(directory).encode())
            out.write(listing)
            out.close()
            yield pd.DataFrame({"file": [name], "first": [first], "last": [last], "directory": [at], "size": [len(listing)]})

    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = records.withColumn("page_id", F.col("page_id").cast("string")).repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    ranges = written(dealt.select("key", "page_id", "file", "offset", "length").mapInPandas(blocks, RANGES), "ranges")
    return Index(folder, ranges.collect())


class Searcher:
    """Lookups of one task; keeps the latest directory and block."""

    def __init__(self, index: Index):
        self.index, self.where = index, system(index.folder)[0]
        self.file = self.at = None

    def read(self, file: str, offset: int, size: int) -> bytes:
        with self.where.open_input_file(file) as f:
            return zlib.decompress(f.read_at(size, offset), 31)

    def block(self, k: int) -> tuple[list[str], list]:
        if self.at != (self.file, k):
            _, offset, size = self.directory[k]
            lines = [json.loads(x) for x in self.read(self.file, offset, size).split(b"\n")]
            self.at, self.held = (self.file, k), ([x[0] for x in lines], lines)
        return self.held

    def find(self, key: str):
        """Every line of the key."""
        for i in range(max(0, bisect_left(self.index.firsts, key) - 1), bisect_right(self.index.firsts, key)):
            _, last, file, offset, size = self.index.ranges[i]
            if last < key:
                continue
            if self.file != file:
                self.file, self.directory = file, json.loads(self.read(file, offset, size))
                self.firsts = [x[0] for x in self.directory]
            for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
                keys, lines = self.block(k)
                yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]


def lookup(keys: DataFrame, index: Index) -> DataFrame:
    """The captures (FOUND) of the distinct keys (column key), sorted so that a task's lookups lie side by side."""

    def found(batches):
        search = Searcher(index)
        for pdf in batches:
            rows = [line for key in pdf["key"] for line in search.find(key)]
            out = pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInPandas(found, FOUND)


def read(found: DataFrame, folder: str) -> DataFrame:
    """What the records say that were found (CAPTURES); a response's digest is made anew and compared with its header."""

    def captures(batches):
        where, name, source = system(folder)[0], None, None
        for pdf in batches:
            rows = []
            for page_id, file, offset, length in zip(pdf["page_id"], pdf["file"], pdf["offset"], pdf["length"], strict=True):
                if file != name:
                    name, source = file, where.open_input_file(file)
                fields, payload = parse(zlib.decompress(source.read_at(int(length), int(offset)), 31))
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind, size = fields["WARC-Type"], int(fields["http-Content-Length"])
                if kind == "response" and (digest(payload) != said or len(payload) != size):
                    raise ValueError(f"record at {offset} of {file} is damaged")
                of = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                rows.append((None if pd.isna(page_id) else int(page_id), size, said, kind, int(of) if of else None))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.withColumn("page_id", F.col("page_id").cast("string")).repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(captures, CAPTURES)


def captures(pages: DataFrame) -> DataFrame:
    """pages written as archives, indexed, looked up by their keys and read back (CAPTURES)."""
    bounded_batches(pages.sparkSession)
    folder = shared_dir(pages.sparkSession, "warc")
    found = index(write(pages, f"{folder}/archives"), f"{folder}/index")
    keys = pages.select(capture_key("url", "page_id").alias("key"))
    return read(lookup(keys, found), folder)


def op1_capture_index(spark, sf_dir: str) -> DataFrame:
    """Every page's record, by way of the archives and the index."""
    return captures(table(spark, sf_dir, "pages"))


QUERIES = {"op1_capture_index": op1_capture_index}

#: Base 32 of a SHA-1: each eight signs are ten of its hexadecimal digits.
ORACLE_SQL = {
    "op1_capture_index": """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h, n) AS head FROM p)
    SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(h, (i // 8) * 10 + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to FROM g"""
}

