"""WARC archives of pages with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of an archive that a task
writes in the shared folder; a repeated payload becomes a revisit record.  The
captures are sorted by key (reversed host, path, page id) over the cluster and cut
into compressed blocks, one index file a partition; each index file has a sparse
directory with the first key of every block.  A lookup goes by binary search to
the index files (their first keys are few: one a partition), within a file by
binary search in its directory, then reads the byte range of one block, and by the
entries in it the byte ranges of records.  Archives, blocks and directories are
read by range; no index is held whole.

Files of failed task attempts are never referred to: the manifest tables name
the files of the attempts that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, new_path, slices

MIN_REVISIT_BYTES = 1000
BLOCK_CAPTURES = 500
#: Byte ranges of one archive that lie this near to each other are read at once.
READ_AHEAD = 256 << 10
#: Bytes of records that a reading task takes on, and of an archive that go to one task.
TASK_BYTES = 64 << 20
STRETCH_BYTES = 4 << 20


@lru_cache(maxsize=16)
def _store(base: str):
    """(file system, path) of a folder, as executors see it."""
    filesystem, path = pafs.FileSystem.from_uri(base)
    filesystem.create_dir(path, recursive=True)
    return filesystem, path


def url_key(url):
    """Column: reversed host, then the rest: http://www.a.org/x?y -> org,a,www)/x?y."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?#]*", 0))
    rest = F.regexp_replace(bare, "^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def capture_key(url, page_id):
    """Column: the url key and the page id, so that keys sort by url, then page."""
    number = F.lpad((page_id.cast("decimal(21,0)") + F.lit("9223372036854775808").cast("decimal(21,0)")).cast("string"), 20, "0")
    return F.concat(url_key(url), F.lit(" "), F.coalesce(number, F.lit("-")))


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, original) -> bytes:
    """One WARC record: a response, or a revisit of page ``original`` without a payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if original is None else b"")
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if original is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{original}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the payload is checked against its digest."""
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(line.split(b":", 1)[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if lines[0] != "WARC/1.1" or response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    number = lambda name: int(n) if (n := fields.get(name, "")[len("<urn:page:") : -1]) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if response else None}


def write_archives(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages as records below ``base``; the manifest (key, file, start, size), a written table."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # Digests alone are grouped; only those with copies take part in the join.
    # They are written, so their size is known before the pages are read; small payloads stay where they are.
    large = F.octet_length("html") >= min_bytes
    copies = materialize(rows.where(large).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-copies")
    planned = rows.where(large).join(copies, "digest", "left").unionByName(rows.where(~large).withColumn("original", F.lit(None).cast("long"))).select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("original")), F.lit(None)).otherwise(F.col("original")).alias("original"), capture_key(F.col("url"), F.col("page_id")).alias("key"))

    def run(batches):
        store, name, at, out = None, "", 0, None
        for part in slices(batches, "html"):
            if out is None:
                store, path = _store(base)
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            starts, sizes = [], []
            for page_id, url, text, digest, original in zip(*(part.column(k).to_pylist() for k in range(5))):
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, text.encode("utf-8", "surrogatepass"), digest, original)) + packer.flush()
                out.write(member)
                starts.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_pydict({"key": part.column(5), "file": pa.array([name] * len(starts)), "start": pa.array(starts, pa.int64()), "size": pa.array(sizes, pa.int64())})
        if out is not None:
            out.close()

    return materialize(planned.mapInArrow(run, "key string, file string, start long, size long"), "warc-manifest")


@dataclass(frozen=True)
class CaptureIndex:
    """Index files below ``base`` with their first and last keys, in key order."""

    base: str
    files: tuple[str, ...]
    first: tuple[str, ...]
    last: tuple[str, ...]


def build_index(manifest: DataFrame, base: str, block_captures: int = BLOCK_CAPTURES) -> CaptureIndex:
    """Sort captures over the cluster and write blocks and directories.

    The sort key is the capture key with the record's place, so a hot url is split
    over partitions.  What comes back is a row per index file, not per capture.
    """
    order = ["key", "file", "start"]

    def run(batches):
        entries, blocks, at, name, out, store, path, bounds = [], [], 0, "", None, None, "", [None, None]

        def flush():
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(e, ensure_ascii=True) for e in entries).encode(), 6)
            out.write(packed)
            blocks.append((entries[0][0], entries[-1][0], at, len(packed)))
            at += len(packed)
            entries.clear()

        for batch in batches:
            if out is None and batch.num_rows:
                store, path = _store(base)
                name = uuid.uuid4().hex
                out = store.open_output_stream(f"{path}/{name}.blocks", compression=None)
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                bounds[0] = row[0] if bounds[0] is None else bounds[0]
                bounds[1] = row[0]
                entries.append(row)
                if len(entries) == block_captures:
                    flush()
        if out is not None:
            if entries:
                flush()
            out.close()
            with store.open_output_stream(f"{path}/{name}.directory", compression=None) as side:
                side.write(zlib.compress(json.dumps(blocks).encode(), 6))
            yield pa.RecordBatch.from_pydict({"file": [name], "first": pa.array([bounds[0]], pa.string()), "last": pa.array([bounds[1]], pa.string())})

    files = materialize(manifest.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).mapInArrow(run, "file string, first string, last string"), "warc-index")
    rows = sorted(files.collect(), key=lambda r: (r.first, r.last))
    return CaptureIndex(base, tuple(r.file for r in rows), tuple(r.first for r in rows), tuple(r.last for r in rows))


class _IndexFile:
    """One index file: its directory, and the last block read."""

    def __init__(self, base: str, name: str):
        store, path = _store(base)
        with store.open_input_stream(f"{path}/{name}.directory", compression=None) as side:
            self.blocks = json.loads(zlib.decompress(side.read()))
        self.last = [b[1] for b in self.blocks]
        self.file = store.open_input_file(f"{path}/{name}.blocks")
        self.at, self.entries, self.keys = -1, [], []

    def find(self, key: str):
        for k in range(bisect_left(self.last, key), len(self.blocks)):
            first, _, start, size = self.blocks[k]
            if first > key:
                return
            if self.at != k:
                self.file.seek(start)
                self.entries = [json.loads(x) for x in zlib.decompress(self.file.read(size)).split(b"\n")]
                self.keys, self.at = [e[0] for e in self.entries], k
            yield from self.entries[bisect_left(self.keys, key) : bisect_right(self.keys, key)]


def lookup(keys: DataFrame, index: CaptureIndex) -> DataFrame:
    """(key, file, start, size) of all captures of each distinct key (column ``key``)."""

    def route(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for key in batch.column(0).to_pylist():
                for k in range(bisect_left(index.last, key), bisect_right(index.first, key)):
                    out[0].append(index.files[k])
                    out[1].append(key)
            yield pa.RecordBatch.from_pydict({"index": pa.array(out[0], pa.string()), "key": pa.array(out[1], pa.string())})

    def search(batches):
        opened, name = None, None
        for batch in batches:
            found = []
            for file, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    opened, name = _IndexFile(index.base, file), file
                found += opened.find(key)
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_pydict({"key": pa.array(columns[0], pa.string()), "file": pa.array(columns[1], pa.string()), "start": pa.array(columns[2], pa.int64()), "size": pa.array(columns[3], pa.int64())})

    routed = keys.select("key").where("key is not null").distinct().mapInArrow(route, "index string, key string")
    return routed.repartition("index").sortWithinPartitions("index", "key").mapInArrow(search, "key string, file string, start long, size long")


def read_records(captures: DataFrame, base: str, payload: bool = False) -> DataFrame:
    """The records at (file, start, size), with their payloads if asked for.

    Captures are dealt by stretches of archives, so that a task reads near ranges in
    order and in one read.  How many tasks there are goes by the bytes of the records,
    which the small rows of places do not show.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})

    def run(batches):
        store, path = _store(base)
        name, source, held, held_at = None, None, b"", 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for file, start, size in zip(*(batch.slice(k, 500).column(c).to_pylist() for c in range(3))):
                    if file != name:
                        name, source, held, held_at = file, store.open_input_file(f"{path}/{file}"), b"", 0
                    if start < held_at or start + size > held_at + len(held):
                        source.seek(start)
                        held, held_at = source.read(max(size, READ_AHEAD)), start
                    out.append(parse_record(zlib.decompress(held[start - held_at : start - held_at + size], 31)))
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in out], t) for n, t in kinds.items()})

    places = materialize(captures.select("file", "start", "size"), "captures")
    total = places.agg(F.sum("size")).first()[0] or 0
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    stretch = F.floor(F.col("start") / STRETCH_BYTES)
    return places.repartition(tasks, "file", stretch).sortWithinPartitions("file", "start").mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame, CaptureIndex]:
    """Write archives and index below a new shared folder: (folder, manifest, index)."""
    base = new_path(spark, "warc")
    manifest = write_archives(pages, base, id_col, url_col, html_col)
    return base, manifest, build_index(manifest, base)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page, then find every page's captures by key and read them back.

    One row per input row: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  A null html is an empty payload, a null url an empty one; rows that
    repeat a page id and payload are all responses if theirs is the largest id; a
    payload of null ids alone has responses only.  An empty table gives none.  A very
    long page is a record like any other; other columns, whatever their names, are not read.
    """
    base, _, index = archive(pages.sparkSession, pages, id_col, url_col, html_col)
    keys = pages.select(capture_key(F.col(url_col), F.col(id_col).cast("long")).alias("key"))
    return read_records(lookup(keys, index), base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
