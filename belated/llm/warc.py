"""WARC archives with a two-level capture index.

Writing: each partition writes one archive of gzip members, a record each, to
the shared folder under a name of its own, so a repeated task leaves an archive
that nothing points to.  Of records with equal payloads of at least
``MIN_REVISIT`` bytes that with the largest page id is a response, the others
are revisits without payload that refer to it.

Index: capture lines, keyed by the reversed host and path of the URL and the
page id, are range partitioned and sorted, and written as compressed blocks of
``BLOCK_LINES`` lines.  At the end of each index file its sparse directory keeps
the first key, offset and length of each block; the first keys of the files, one
row a range partition, are the top of it.  A lookup searches the files' keys by
bisection, reads the file's directory by its byte range, searches that, reads the
block by its byte range, searches the block, and reads the record by its byte
range.  Reading back looks every page up this way, by its URL's key and its id.

Null html is an empty payload; a null URL is an empty URI.  Rows with a null
page id are responses; so is a whole group of equal payloads that has no id.
Rows that repeat an id are written each.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT, BLOCK_LINES, DATE = 1000, 256, "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX_SCHEMA = "page_id long, key string, file string, offset long, length long"
FILES_SCHEMA = "file string, first_key string, first_id long, offset long, length long, blocks long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sort_key(url: str | None) -> str:
    """Reversed host, then path and query: com,example,www)/path?query."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return "-)" + quote(url or "", safe="/?&=%:")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key.lower(), safe="/?&=%:,)~")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One gzip member."""
    revisit = refers_to is not None
    block = _HTTP % size + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe='/:?&=%#@+,;!~*()[]$')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Record headers, payload and HTTP headers of a gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def decided(pages: DataFrame) -> DataFrame:
    """Pages with digest, payload size and the response that a revisit refers to."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = hashed.filter(F.col("size") >= MIN_REVISIT).groupBy("digest", "size").agg(F.max("page_id").alias("of"), F.count("*").alias("k")).filter("k > 1")
    # staged, so that both sides are plain exchanges and a hot payload can be split;
    # small payloads, which refer to nothing, are dealt by their pages
    large = common.stage(large.select("digest", "size", "of", F.lit(0).cast("long").alias("salt")), "large")
    salt = F.when(F.col("size") >= MIN_REVISIT, F.lit(0).cast("long")).otherwise(F.xxhash64("page_id", "url"))
    refers = F.when((F.col("size") >= MIN_REVISIT) & (F.col("page_id") < F.col("of")), F.col("of"))
    return hashed.withColumn("salt", salt).join(large, ["digest", "size", "salt"], "left").select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; (page_id, key, file, offset, length) of each record."""
    base = _uri(folder)

    def run(batches):
        fs = out = None
        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(k) for k in range(6)), strict=True):
                page_id, url, payload, digest, size, refers_to = (v.as_py() for v in values)
                if out is None:
                    fs, path = _open(base)
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, payload, digest, size, refers_to)
                out.write(member)
                rows.append((page_id, sort_key(url), name, at, len(member)))
                at += len(member)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["page_id", "key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return common.stage(decided(pages).mapInArrow(run, INDEX_SCHEMA), "captures")


Place = tuple[str, bool, int]


def place(key: str, page_id: int | None) -> Place:
    """The order of capture lines; no id comes first."""
    return key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted, compressed blocks and directories; one row an index file."""
    base = _uri(folder)
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "page_id", "file", "offset")
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        out, name, at, held, directory = None, f"index-{uuid.uuid4().hex}.z", 0, [], []

        def put(lines):
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            out.write(data)
            at += len(data)
            return at - len(data), len(data)

        for batch in batches:
            for page_id, key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, path = _open(base)
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                held.append((key, page_id, file, offset, length))
                if len(held) == BLOCK_LINES:
                    directory.append((*held[0][:2], *put(held)))
                    held = []
        if held:
            directory.append((*held[0][:2], *put(held)))
        if out is not None:
            offset, length = put(directory)
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]]), *(pa.array([v], pa.int64()) for v in (first[1], offset, length, len(directory)))], [x.split()[0] for x in FILES_SCHEMA.split(", ")])

    return common.stage(ranged.mapInArrow(run, FILES_SCHEMA), "index-files")


class IndexFile:
    """One open index file: its directory, and the block read last."""

    def __init__(self, fs, path: str, offset: int, length: int):
        self.f = fs.open_input_file(path)
        self.directory = self._lines(offset, length)
        self.firsts = [place(x[0], x[1]) for x in self.directory]
        self.number, self.block = -1, []

    def _lines(self, offset: int, length: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.f.read_at(length, offset)).decode().split("\n")]

    def search(self, low: Place, high: Place) -> list[list]:
        """The capture lines with places from low to high."""
        found = []
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while k < len(self.firsts) and self.firsts[k] <= high:
            if k != self.number:
                lines = self._lines(*self.directory[k][2:4])
                self.number, self.block = k, [(place(x[0], x[1]), x) for x in lines]
            at = bisect.bisect_left(self.block, low, key=lambda x: x[0])
            while at < len(self.block) and self.block[at][0] <= high:
                found.append(self.block[at][1])
                at += 1
            k += 1
        return found

    def close(self) -> None:
        self.f.close()


class CaptureIndex:
    """The top of the index: one row an index file, that is a range partition of the
    writer's, whose number is a setting and does not grow with the captures."""

    def __init__(self, files: DataFrame, index_folder: str, archive_folder: str):
        self.rows = sorted((tuple(r) for r in files.collect()), key=lambda r: place(r[1], r[2]))
        self.firsts = [place(r[1], r[2]) for r in self.rows]
        self.index, self.archives = _uri(index_folder), _uri(archive_folder)

    def holders(self, low: Place, high: Place) -> list[tuple]:
        """The rows of the files that can hold places from low to high."""
        k = max(0, bisect.bisect_left(self.firsts, low) - 1)
        return self.rows[k : max(k, bisect.bisect_right(self.firsts, high))]

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and payload of every capture of a URL (by its sort key)."""
        key = sort_key(url)
        low, high = (key, False, 0), (key, True, 1 << 63)
        fs, path = _open(self.index)
        found = []
        for name, _, _, offset, length, _ in self.holders(low, high):
            one = IndexFile(fs, f"{path}/{name}", offset, length)
            found += one.search(low, high)
            one.close()
        fs, path = _open(self.archives)
        out = []
        for _, _, file, offset, length in found:
            with fs.open_input_file(f"{path}/{file}") as f:
                fields, payload, _ = parse(f.read_at(length, offset))
            out.append((fields, payload))
        return out


def read_back(pages: DataFrame, captures: CaptureIndex) -> DataFrame:
    """The records of all pages (page_id, url): each page's place is searched in the
    file that can hold it, then each archive's records are read by their byte ranges,
    in order of place.  A response's digest is computed anew."""
    top = captures

    def holders(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for page_id, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = sort_key(url)
            at = place(key, page_id)
            rows += [(r[0], key, page_id, r[3], r[4]) for r in top.holders(at, at)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "key", "page_id", "at", "size"])

    def lines(batches):
        fs, path = _open(top.index)
        name, one, last = None, None, None
        for batch in batches:
            found = []
            for file, key, page_id, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, key, page_id) == last:
                    continue  # the capture lines of one page were all found at once
                last = (file, key, page_id)
                if file != name:
                    if one:
                        one.close()
                    name, one = file, IndexFile(fs, f"{path}/{file}", offset, length)
                at = place(key, page_id)
                found += one.search(at, at)
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[1], pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["page_id", "key", "file", "offset", "length"])
        if one:
            one.close()

    def records(batches):
        fs, path = _open(top.archives)
        file, f = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if name != file:
                    if f:
                        f.close()
                    file, f = name, fs.open_input_file(f"{path}/{name}")
                fields, payload, http = parse(f.read_at(length, offset))
                said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                number = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != said:
                    raise ValueError(f"damaged record at {name}:{offset}")
                rows.append((int(number) if number else None, fields["WARC-Target-URI"], int(http["Content-Length"]) if revisit else len(payload), said, fields["WARC-Type"], int(fields["WARC-Refers-To"][len("<urn:page:") : -1]) if revisit else None))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f:
            f.close()

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    order = ("file", "key", "page_id")
    asked = common.arrow_map(wanted, holders, "file string, key string, page_id long, at long, size long").repartition("file").sortWithinPartitions(*order)
    places = asked.mapInArrow(lines, INDEX_SCHEMA)
    # neighbours stay together, 16 MB of an archive at most
    dealt = places.repartition("file", (F.col("offset") / (1 << 24)).cast("long")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(records, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    archives, index = common.new_folder(spark, "warc"), common.new_folder(spark, "cdx")
    files = write_index(write_archives(pages, archives), index)
    return read_back(pages, CaptureIndex(files, index, archives))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS of FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < of THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < of THEN of END AS refers_to
FROM g
"""
