"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own.  Of records with equal payloads of MIN_REVISIT bytes or
more, that of the smallest page_id is a response, the others revisit it.  The index's first level are blocks: captures sorted
by reversed-host URL key (com,example,blog)/path), BLOCK lines to a zlib-compressed block, a file a partition.  The second is a
sparse directory: each block's first and last key and byte range beside its file, and each file's first and last key on top.
A look-up searches the files, then a file's blocks, then a block's lines by bisection, and reads the records' byte ranges;
reading everything looks up the key of every capture, in ranges.

Files go to the shared folder through pyarrow's file systems, under names that no second attempt of a task reuses; the rows
of the attempt that counts name its files, so those of a lost one are never read.
"""

from __future__ import annotations

import bisect
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import place, scratch_dir, sized, staged, table
from quarry.workers import ship

MIN_REVISIT, BLOCK = 100, 500
#: Digests of several records, 120 bytes each, that are broadcast at most; more are joined by shuffle.
MOST_COPIED = 200_000
DATE = "1970-01-01T00:00:00Z"  # pages have no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def clean_url(url: str) -> str:
    """White space and control characters as per cent codes: they can't stand in a header or an index line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: http://www.a.example.org:80/x?y is org,example,a,www:80)/x?y.  A null url has the empty key."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?(.*)", clean_url(url or ""))
    return f"{','.join(reversed(m[1].lower().split('.')))}{m[2] or ''}){m[3] or '/'}" if url else ""


def _record(page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes | None) -> bytes:
    urn = lambda x: f"<urn:uuid:{uuid.uuid5(_URN, str(x))}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + clean_url(url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers)}", f"X-Refers-To-Page: {refers}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers, by lower-case name, and the payload that the record carries."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda part: {k.lower(): v for k, _, v in (x.partition(": ") for x in part.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, size, refers_to, html (null for revisits).

    Of equal payloads of MIN_REVISIT bytes or more that of the smallest page_id is kept, and rows that repeat this id are too; a null page_id refers to it, and is kept where there is no other."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), html.alias("html"))
    copied = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copied, _ = sized(staged(copied, "op8-copied"), MOST_COPIED)
    rows = rows.join(copied, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return rows.select("page_id", "url", "digest", "size", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records; key, page_id, file, at, length of each."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
        out = None
        for b in batches:
            rows = []
            for page, url, digest, size, refers, html in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = _record(page, url, digest, size, refers, None if html is None else html.encode())
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "page_id", "file", "at", "length"])
        if out is not None:
            out.close()

    return staged(plan_records(pages).mapInArrow(run, "key string, page_id bigint, file string, at bigint, length bigint"), "op8-captures")


class Directory(NamedTuple):
    """The sparse directory's top: (first key, last key, name) of each index file, one a partition, in key order; and the table of captures."""

    files: list[tuple[str, str, str]]
    captures: DataFrame


def write_index(captures: DataFrame, folder: str) -> Directory:
    """Blocks of sorted captures, a file a partition, and beside each file the directory of its blocks: first, last (keys), at, length."""
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        name, at, out, lines, rows = f"index-{uuid.uuid4().hex}.cdxz", 0, None, [], []

        def close_block() -> None:
            nonlocal at, out
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            rows.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for key, page, file, spot, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                lines.append("\t".join((key, "-" if page is None else str(page), file, str(spot), str(length))))
                if len(lines) == BLOCK:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (rows[0][0], rows[-1][1], name)], ["first", "last", "file"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    files = staged(ranged.mapInArrow(run, "first string, last string, file string"), "op8-directory").collect()  # n rows at most
    return Directory(sorted(map(tuple, files)), captures)


def block_lines(block: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(block).decode().split("\n")]


def finder(files: list[tuple[str, str, str]], folder: str) -> Callable[[str], Iterator[tuple[str, int, int]]]:
    """find(key): file, at and length of each block that may hold the key, by binary search among the files and then among the
    blocks of those that span it.  The directory of one file, a line for each BLOCK captures of a partition, is held at a time."""
    fs, base = place(folder)
    held, blocks = None, []

    def find(key: str) -> Iterator[tuple[str, int, int]]:
        nonlocal held, blocks
        for first, _, name in files[bisect.bisect_left(files, key, key=lambda x: x[1]) :]:
            if first > key:
                return
            if name != held:
                with fs.open_input_stream(f"{base}/{name}.dir", compression=None) as f:
                    held, blocks = name, block_lines(f.read())
            for low, _, at, length in blocks[bisect.bisect_left(blocks, key, key=lambda x: x[1]) :]:
                if low > key:
                    break
                yield name, int(at), int(length)

    return find


def of_key(lines: list[list[str]], key: str) -> list[list[str]]:
    """A block's lines of one key."""
    return lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]


def read_keys(directory: Directory, folder: str, keys: DataFrame) -> DataFrame:
    """Captures of all keys (a column key, repeats count once): page_id, url, payload_bytes and payload_digest (of the full payload), record_type, refers_to, payload (null for revisits).

    Tasks look keys up in ranges; what they find is dealt by block, so that the blocks of a hot key are read by many tasks.
    Raises ValueError where a response's payload isn't that of its digest."""
    import hashlib

    files = directory.files

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(files, folder)
        for b in batches:
            rows = [(*block, key) for key in b.column(0).to_pylist() for block in find(key)]
            for i in range(0, len(rows), 10_000):
                part = list(zip(*rows[i : i + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["file", "at", "length", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        named = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for (file, at, length), of_block in itertools.groupby(named, key=lambda x: x[:3]):
            with fs.open_input_file(f"{base}/{file}") as f:
                lines = block_lines(f.read_at(length, at))
            captures = [x for _, _, _, key in of_block for x in of_key(lines, key)]
            rows, name, archive = [], None, None
            for _, _, own, spot, size in sorted(captures, key=lambda x: (x[2], int(x[3]))):
                if own != name:
                    if archive is not None:
                        archive.close()
                    name, archive = own, fs.open_input_file(f"{base}/{own}")
                warc, http, payload = parse_record(archive.read_at(int(size), int(spot)))
                digest, response = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"] == "response"
                if response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                    raise ValueError(f"{own} at {spot}: payload and digest differ")
                number = lambda x: int(x) if x else None
                rows.append((number(warc.get("x-page-id")), warc.get("warc-target-uri"), int(http["content-length"]), digest, warc["warc-type"], number(warc.get("x-refers-to-page")), payload if response else None))
            if rows:
                archive.close()
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    found = ranged.mapInArrow(look, "file string, at bigint, length bigint, key string")
    dealt = found.repartition(n, "file", "at").sortWithinPartitions("file", "at", "key")
    return dealt.mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def read_all(directory: Directory, folder: str) -> DataFrame:
    """Every capture, each looked up by its key; columns of read_keys."""
    return read_keys(directory, folder, directory.captures)


def look_up(directory: Directory, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """(WARC headers, payload) of all captures of a url; a revisit has no payload of its own."""
    key = url_key(url)
    fs, base = place(folder)
    out = []
    for name, at, length in finder(directory.files, folder)(key):
        with fs.open_input_file(f"{base}/{name}") as f:
            lines = block_lines(f.read_at(length, at))
        for _, _, file, spot, size in of_key(lines, key):
            with fs.open_input_file(f"{base}/{file}") as f:
                warc, _, payload = parse_record(f.read_at(int(size), int(spot)))
            out.append((warc, payload))
    return out


def archive(pages: DataFrame) -> tuple[Directory, str]:
    """Writes archives and index of all pages into a new shared folder; (directory, folder).

    Null html is an empty payload, a null url has none in its record, a null page_id is written without one and never referred
    to.  Rows of one page_id each get a record.  Other columns are not read; an empty table writes nothing."""
    folder = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write_index(write_archives(pages, folder), folder), folder


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, folder = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_all(directory, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
