"""WARC archives written in parallel, the same bytes on every run, and read back.

1. Each page becomes a response record in its own gzip member; its size, and the SHA-1 of payload and block are known
   from then on. Of equal payloads of at least `least` bytes (compared by SHA-256 and length) the first one in order
   stays a response; the others become short revisit records that name it.
2. Records are sorted by (page_id, url, digest), nulls last. A running sum of compressed sizes over that order says
   where each record begins; a file ends with the first record that reaches its size. Files thus depend on the pages
   alone, not on partitions or retries. The sum goes by sorted slices and their totals, so no task sees all records.
3. Each file is written by one task under a temporary name of its own. The rows that the successful tasks return are
   stored; only files that they name are renamed, and the manifest, a Parquet table, is written last. A reader takes
   the files of the manifest, so a lost task or a broken run leaves nothing that could be read.

Headers are regenerated: record ids are derived from page, url and digests, the date is a parameter, lengths and digests
are counted. Reading checks file sizes and digests, record lengths, and block and payload digests.

Null html counts as empty. Null page_ids and urls are left out of a record's header and read back as null. Repeated rows
are records of their own; of wholly equal rows one is the response. No pages give no files and an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelab.llm.common import BROADCAST_ROWS, records, slices
from tracelab.session import durable

FILE_BYTES = 64 << 20  # compressed; the last record of a file goes beyond it
SLICE_ROWS = 1 << 18  # of (key, size) rows that one task adds up
LEAST_PAYLOAD = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MADE = pa.schema(
    [("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("content", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("member", pa.binary())]
)
_SHORT = pa.schema([("row", pa.int64()), ("short", pa.binary()), ("short_size", pa.int64())])
_FILES = pa.schema([("file", pa.int64()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("name", pa.string())]
)
MADE = "row long, page_id long, url string, content binary, payload_bytes long, digest string, size long, member binary"
FILES = "file long, temporary string, name string, records long, bytes long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, name string"

Batches = Iterable[pa.RecordBatch]


# --- records -------------------------------------------------------------------------------------


def sha1_text(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr((page_id, url, digest)).encode()).digest()[:16], version=5)}>"


def member(page_id: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A record as a gzip member: a response with its payload, or a revisit (payload None) of page `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, url, digest), "WARC-Date": date}
    if url is not None:  # as an URI: no blanks or line ends
        head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
        if head["WARC-Target-URI"] != url:
            head["X-Url"] = quote(url, safe="")
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if kind == "revisit":
        head["WARC-Profile"] = PROFILE
        if refers_to is not None:
            head["X-Refers-To-Page-Id"] = str(refers_to)
    head |= {
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_text(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"WARC/1.1\r\n{lines}\r\n".encode()) + squeeze.compress(block + b"\r\n\r\n") + squeeze.flush()


def parsed(data: bytes) -> dict:
    """The facts of a record; raises ValueError where lengths or digests do not agree with its content."""
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    length = int(head["Content-Length"])
    block = rest[:length]
    if first != "WARC/1.1" or rest[length:] != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha1:{sha1_text(block)}":
        raise ValueError(f"damaged record {head.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (full != len(payload) or digest != sha1_text(payload)):
        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    number = lambda name: int(head[name]) if name in head else None
    url = unquote(head["X-Url"]) if "X-Url" in head else head.get("WARC-Target-URI")
    return {
        "page_id": number("X-Page-Id"), "url": url, "payload_bytes": full, "payload_digest": digest, "record_type": kind,
        "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if kind == "response" else None,
    }


def members(source: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    data = source.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        data = data or source.read(chunk)
    if any(parts):
        raise ValueError("the file ends within a record")


# --- writing -------------------------------------------------------------------------------------


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of the shared folder, as any task can open it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _made(date: str):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            out: dict[str, list] = {f.name: [] for f in _MADE}
            for r in part.to_pylist():
                data = r["payload"]
                digest = sha1_text(data)
                whole = member(r["page_id"], r["url"], digest, len(data), data, date=date)
                row = (r["row"], r["page_id"], r["url"], hashlib.sha256(data).digest(), len(data), digest, len(whole), whole)
                for name, value in zip(out, row):
                    out[name].append(value)
            yield records(_MADE, **out)

    return run


def _shortened(date: str):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            short = [
                None if r["first"] is None or r["first"]["row"] == r["row"]
                else member(r["page_id"], r["url"], r["digest"], r["payload_bytes"], None, r["first"]["page_id"], date)
                for r in part.to_pylist()
            ]
            yield records(_SHORT, row=part.column("row"), short=short, short_size=[s and len(s) for s in short])

    return run


def _files(folder: str):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """Write each file of the sorted records of a task under a temporary name."""
        store, root = _store(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        now, out = None, None

        def closed() -> pa.RecordBatch:
            out.close()
            return records(_FILES, file=[now], temporary=[temporary], name=[f"{now:08d}.warc.gz"], records=[n], bytes=[size], sha256=[check.hexdigest()])

        for part in slices(batches, "member"):
            for file, data in zip(part.column("file").to_pylist(), part.column("member").to_pylist()):
                if file != now:
                    if out:
                        yield closed()
                    now, temporary = file, f"_temporary/{file:08d}-{uuid.uuid4().hex}"
                    out, n, size, check = store.open_output_stream(f"{root}/{temporary}", compression=None), 0, 0, hashlib.sha256()
                out.write(data)
                check.update(data)
                n, size = n + 1, size + len(data)
        if out:
            yield closed()

    return run


def _committed(folder: str):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """Give the named files their final names; a repeated attempt finds them there already."""
        store, root = _store(folder)
        for part in batches:
            for r in part.to_pylist():
                source, target = f"{root}/{r['temporary']}", f"{root}/{r['name']}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                if store.get_file_info(target).size != r["bytes"]:
                    raise OSError(f"{target} was not written whole")
            yield part

    return run


def _swept(folder: str):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """Remove what lost attempts have left."""
        store, root = _store(folder)
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")
        yield from batches

    return run


def _nulls_last(*columns: str) -> list:
    return [F.col(c).asc_nulls_last() for c in columns]


def _starts(sized: DataFrame, slice_rows: int, order: list[str]) -> DataFrame:
    """sized with `start`: the bytes of all records before a row, in sorted order.

    Sorted slices are written once, so that their totals and their rows are the same; a task holds a slice at a time.
    """
    n = sized.count()
    sort = _nulls_last(*order)
    cut = sized.repartitionByRange(max(1, -(-n // slice_rows)), *sort).sortWithinPartitions(*sort)
    # the id that a partition counts up: its number, and the place in it
    cut = durable(cut.withColumn("at", F.monotonically_increasing_id())).withColumn("slice", F.shiftright("at", 33))
    totals = cut.groupBy("slice").agg(F.sum("size").alias("size"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice of `slice_rows`
    ahead = totals.select("slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(ahead, "slice").withColumn("start", F.col("ahead") + F.col("own")).drop("slice", "at", "own", "ahead")


def write(
    pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least: int = LEAST_PAYLOAD, date: str = DATE, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Write the pages (page_id, url, html) as archives in a new folder; returns the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    made = durable(rows.mapInArrow(_made(date), MADE))

    narrow = made.select("row", "page_id", "url", "content", "payload_bytes", "digest", "size")
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("no_url"), "url", "row")
    firsts = narrow.where(F.col("payload_bytes") >= least).groupBy("content", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    firsts = durable(firsts.where("copies > 1").select("content", "payload_bytes", "first"))
    few = firsts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = narrow.join(F.broadcast(firsts) if few else firsts.hint("merge"), ["content", "payload_bytes"], "left")
    # copies alone go on to be shortened
    short = known.where("first is not null").select("row", "page_id", "url", "digest", "payload_bytes", "first").mapInArrow(_shortened(date), "row long, short binary, short_size long")
    short = durable(short.where("short is not null"))
    few = short.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sizes = short.select("row", "short_size")
    sized = narrow.join(F.broadcast(sizes) if few else sizes.hint("merge"), "row", "left")
    sized = sized.select("row", "page_id", "url", "digest", F.col("short_size").isNotNull().alias("again"), F.coalesce("short_size", "size").alias("size"))
    order = ["page_id", "url", "digest", "again", "row"]
    placed = durable(_starts(sized, slice_rows, order).select("row", F.floor(F.col("start") / file_bytes).alias("file"), "start", "again"))

    # the list says which pages become revisits, so the members meet it in one join
    few = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    put = lambda rows, again: rows.join(F.broadcast(again) if few else again.hint("merge"), "row")
    long = put(made.select("row", "member"), placed.where(~F.col("again")))
    full = long.unionByName(put(short.select("row", F.col("short").alias("member")), placed.where("again")))
    n_files = max(1, (placed.agg(F.max("file")).first()[0] or 0) + 1)
    by_file = full.select("file", "start", "member").repartition(n_files, "file").sortWithinPartitions("file", "start")
    written = durable(by_file.mapInArrow(_files(folder), FILES))
    done = written.repartition(max(1, min(n_files // 64, 1000))).mapInArrow(_committed(folder), FILES)
    done.select("file", "name", "records", "bytes", "sha256").write.parquet(f"{folder}/_manifest")
    spark.range(0, 1, 1, 1).mapInArrow(_swept(folder), "id long").count()  # one task
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file long, name string, records long, bytes long, sha256 string").parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in the manifest, a task per file; a file is streamed record by record."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for part in batches:
            for r in part.to_pylist():
                held, size, n = [], 0, 0
                with store.open_input_stream(f"{root}/{r['name']}", compression=None) as source:
                    watched = _Watched(source)
                    for data in members(watched):
                        held.append(parsed(data) | {"name": r["name"]})
                        size, n = size + len(data), n + 1
                        if size > 2 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_READ)
                            held, size = [], 0
                if (watched.size, watched.check.hexdigest(), n) != (r["bytes"], r["sha256"], r["records"]):
                    raise ValueError(f"{r['name']} is not what the manifest names")
                yield pa.RecordBatch.from_pylist(held, schema=_READ)

    files = manifest(spark, folder)
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, READ)


class _Watched:
    """A stream with the size and digest of what was read."""

    def __init__(self, source):
        self.source, self.size, self.check = source, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.source.read(n)
        self.size += len(data)
        self.check.update(data)
        return data


def archive_sql() -> str:
    """The contract's columns in DuckDB: five hex digits of the SHA-1 are four letters of base32."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h,
      row_number() OVER (PARTITION BY html ORDER BY page_id) AS nr, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)
    FOR i IN range(0, 32)], 'string_agg', '') AS payload_digest,
  CASE WHEN nr = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nr > 1 THEN first END AS refers_to FROM d
"""
