"""WARC archives and their two-level capture index."""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table_path

END = "\r\n\r\n"
#: Bytes that a range read takes at once, and the gap between two records that it reads over.
READ, GAP = 8 << 20, 64 << 10


def one_line(url: Column) -> Column:
    """A URL as a header field can hold it: line ends percent-encoded."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def url_key(url: Column) -> Column:
    """Reversed-host key: `com,example,www)/path?query`, host in lower case, without scheme, user, port and fragment. A string that
    has no scheme and host is its own key; null gives the empty key."""
    url = one_line(url)
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, pattern, 1)), r"\.")), ",")
    rest = F.regexp_extract(url, pattern, 2)
    return F.when(url.isNull(), "").when(url.rlike(pattern), F.concat(host, F.lit(")"), F.when(rest == "", "/").otherwise(rest))).otherwise(url)


def _rolled(archive_bytes: int):
    """Numbers the archives of a task: a record that would take one beyond archive_bytes begins the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = number = 0
        for b in batches:
            at = []
            for n in pa.compute.binary_length(b.column(0)).to_pylist():
                if used and used + n > archive_bytes:
                    used, number = 0, number + 1
                used += n + len(END)
                at.append(number)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32())], ["value", "archive"])

    return run


def write_warc(pages: DataFrame, path: str, *, archive_bytes: int = 32 << 20, least_bytes: int = 100) -> None:
    """Writes a record per row of pages (page_id, url, html; other columns, whatever their names, are ignored) as WARC files under path,
    of archive_bytes at most but for a record that is larger by itself.

    Of the rows with equal payloads of least_bytes or more, those with the smallest page_id are responses and the others
    revisit it; without an id among them all are responses. Null html: an empty payload. Null url: no target URI. Records are
    text and CRLFs, so Spark's text writer, whose line separator is the end of a record, commits them on any store. An empty table
    gives no records.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2(F.encode("html", "UTF-8"), 256)})
    light = rows.where(F.col("n") >= least_bytes).select("page_id", "digest")
    twice = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    twice = materialize(twice.select("digest", "first"), "warc-repeated")
    rows = rows.join(twice, "digest", "left")
    revisit = F.col("first").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", one_line(F.col("url"))), F.lit("")), line("WARC-Date", F.lit("2000-01-01T00:00:00Z")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", profile))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    records = rows.select(F.concat(head, block).alias("value")).mapInArrow(_rolled(archive_bytes), "value string, archive int")
    key = "spark.sql.maxConcurrentOutputFileWriters"  # the archives of a task come in order: no sort by archive is needed
    before = spark.conf.get(key, None)
    spark.conf.set(key, "64")
    try:
        records.write.partitionBy("archive").option("lineSep", END).text(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def records_of(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """Offset, length, header fields, HTTP head and payload of each record of an archive."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:cut].decode().split("\r\n")[1:])
        end = cut + 4 + int(fields["Content-Length"])
        http, _, payload = data[cut + 4 : end].partition(b"\r\n\r\n")
        if data[end : end + 4] != END.encode():
            raise ValueError(f"no end of record at {end}")
        yield at, end - at, fields, http, payload
        at = end + 4


def _page(name: str) -> int | None:
    inner = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if inner == "-" else int(inner)


CAPTURE = "url string, file string, offset long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_TYPES = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def capture(file: str, at: int, length: int, fields: dict[str, str], http: bytes, payload: bytes) -> tuple:
    """A response's size and digest come from its payload, a revisit's from what it says of the payload that it doesn't repeat."""
    kind = fields["WARC-Type"]
    said = next(int(x.split(":", 1)[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    n, digest = (said, fields["WARC-Payload-Digest"].removeprefix("sha256:")) if kind == "revisit" else (len(payload), hashlib.sha256(payload).hexdigest())
    return fields.get("WARC-Target-URI"), file, at, length, _page(fields["WARC-Record-ID"]), n, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _index_row(file: str, at: int, length: int, fields: dict[str, str], http: bytes, payload: bytes) -> tuple:
    return fields.get("WARC-Target-URI"), file, at, length, _page(fields["WARC-Record-ID"])


POINTER = "url string, file string, offset long, length long, page_id long"
_POINTERS = _NAMES[:5]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = [_index_row(file, *x) for x in records_of(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES[:5])], _POINTERS)


def read_pointers(spark: SparkSession, path: str) -> DataFrame:
    """A row (POINTER) per record of the archives under path; an archive is scanned by one task, in the memory of one archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), "content").mapInArrow(_read, POINTER)


@dataclass(frozen=True)
class CaptureIndex:
    """blocks: block, first, last (url keys), n, data (compressed JSON lines in key order); sorted by key over all blocks but that
    one key may go on in the next block. The directory is blocks without data; runs of `wide` blocks of it are segments."""

    blocks: DataFrame
    segments: DataFrame
    top: tuple[list[str], list[str], list[int]]

    @property
    def directory(self) -> DataFrame:
        return self.blocks.select("block", "first", "last")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Captures (key and POINTER) of each distinct key in `keys` (a column `key`; null finds nothing): a binary search of the sparse
        directory, of the segments of blocks that it names, and of the blocks that those name."""
        keys = keys.select("key").where("key is not null").distinct()
        table = keys.sparkSession.sparkContext.broadcast(self.top)  # most_segments entries, and one for each task of the index's making

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, last, segment = table.value
            for b in batches:
                out = [(k, segment[i]) for k in b.column(0).to_pylist() for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([i for _, i in out], pa.int64())], ["key", "segment"])

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for k, first, last, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out += [(k, block[i]) for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([i for _, i in out], pa.int64())], ["key", "block"])

        near = keys.mapInArrow(search, "key string, segment long").join(self.segments, "segment").select("key", "firsts", "lasts", "numbers")
        wanted = near.mapInArrow(narrow, "key string, block long").groupBy("block").agg(F.collect_set("key").alias("keys"))  # not more keys than a block has lines, but for misses
        return wanted.join(self.blocks, "block").select("keys", "data").mapInArrow(_some_lines, f"key string, {POINTER}")


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), *_TYPES[:5]))], ["key", *_POINTERS])


def _some_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            at = [r[0] for r in rows]
            yield _batch([r for k in sorted(keys) for r in rows[bisect.bisect_left(at, k) : bisect.bisect_right(at, k)]])


def build_index(pointers: DataFrame, *, block_lines: int = 1000, most_segments: int = 65_536) -> CaptureIndex:
    """Sorts pointers (POINTER) by url key over all partitions, so that a common key is spread too, and packs them into compressed blocks;
    the directory is cut into at most most_segments segments (and one more for each task), whose keys are all that the driver holds.
    Null urls have the empty key; repeated rows are lines of their own; no rows give an index that finds nothing."""
    # the key in code point order, as Python compares it: both sort by UTF-8 bytes or by code points, which is the same
    ranged = materialize(pointers.withColumn("key", url_key(F.col("url"))).select("key", *_POINTERS), "captures")  # dealing by range reads its input twice
    ranged = ranged.repartitionByRange(F.col("key"), F.col("page_id"), F.xxhash64("file", "offset")).sortWithinPartitions("key", "page_id", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, []
        schema = pa.schema([("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("data", pa.binary())])

        def block() -> pa.RecordBatch:
            nonlocal count
            now, held[:] = held[:block_lines], held[block_lines:]
            count += 1
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in now).encode(), 6)
            return pa.RecordBatch.from_pylist([{"block": (part << 32) + count, "first": now[0][0], "last": now[-1][0], "n": len(now), "data": data}], schema)

        for b in batches:
            held += [list(r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            while len(held) >= block_lines:
                yield block()
        if held:
            yield block()

    blocks = materialize(ranged.mapInArrow(pack, "block long, first string, last string, n long, data binary"), "capture-index")
    wide = -(-blocks.count() // most_segments) or 1
    part, number = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    segment = (F.shiftleft(part, 32) + F.floor((number - 1) / wide)).alias("segment")
    listed = blocks.groupBy(segment).agg(F.sort_array(F.collect_list(F.struct("block", "first", "last"))).alias("s"))  # `wide` in each
    segments = materialize(listed.select("segment", F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"), F.col("s.block").alias("numbers")), "capture-segments")
    top = segments.select("segment", F.get("firsts", F.lit(0)).alias("first"), F.element_at("lasts", -1).alias("last")).orderBy("segment").collect()
    return CaptureIndex(blocks, segments, ([r.first for r in top], [r.last for r in top], [r.segment for r in top]))


def _open(path: str) -> pa.NativeFile:
    """A file that can be read from any place on: of a folder that is mounted everywhere, or of a store that Arrow knows."""
    local = re.match(r"file:/+(.*)", path)
    if local:
        return pa.fs.LocalFileSystem().open_input_file("/" + local[1])
    store, at = pa.fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _ranges(batches: Iterator[pa.RecordBatch], columns: tuple[int, int, int]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the bytes of its (file, offset, length), in order of file and offset; near ranges of a file are read at once."""
    name, source = None, None
    for b in batches:
        files, offsets, lengths = (b.column(k).to_pylist() for k in columns)
        out, i = [], 0
        while i < len(files):
            j, end = i + 1, offsets[i] + lengths[i]
            while j < len(files) and files[j] == files[i] and offsets[j] <= end + GAP and max(end, offsets[j] + lengths[j]) - offsets[i] <= READ:
                end, j = max(end, offsets[j] + lengths[j]), j + 1
            if files[i] != name:
                if source is not None:
                    source.close()
                name, source = files[i], _open(files[i])
            data = source.read_at(end - offsets[i], offsets[i])
            out += [data[offsets[k] - offsets[i] : offsets[k] - offsets[i] + lengths[k]] for k in range(i, j)]
            i = j
        yield b, out
    if source is not None:
        source.close()


def read_records(found: DataFrame, *, payload: bool = False) -> DataFrame:
    """CAPTURE, and the payload (binary) if asked for, of each row of a lookup, read as ranges of the archives: tasks open a file once, seek
    and read, and hold READ bytes or one record. No rows give none; repeated rows are read each."""
    rows = found.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _ranges(batches, (0, 1, 2)):
            got = [next(iter(records_of(x + END.encode()))) for x in data]
            rows = [capture(file, at, length, *x[2:]) for file, at, length, x in zip(*(c.to_pylist() for c in b.columns), got, strict=True)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x[4] for x in got], pa.binary())] if payload else [])], [*_NAMES, *(["payload"] if payload else [])])

    return rows.mapInArrow(read, CAPTURE + (", payload binary" if payload else ""))


def archive_and_index(pages: DataFrame, path: str | None = None, **options: int) -> CaptureIndex:
    """Writes pages as WARC (see write_warc for nulls, repeated rows and an empty table), and indexes the archives."""
    spark = pages.sparkSession
    path = path or table_path(spark, "warc")
    write_warc(pages, path, **options)
    return build_index(read_pointers(spark, path))
