"""WARC archives, written and read as streams of bounded chunks.

Both ways records travel as a chunked record table: rows of record identifier and chunk number. The writer
is given each payload as rows of at most a chunk, in order, and feeds them to a gzip member per record
while it carries the size and digest so far, which must end at what the record's head declares;
the reader turns archives into such rows, each with the digest and size so far. The last chunk of a
record has its totals. So a Python worker holds a batch of chunks, never a payload. Archives are sized by bytes and
written by the executors into a folder that all of them share; each task writes
under a name of its attempt and renames at the end, so a task run again leaves one archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import IO
from uuid import NAMESPACE_URL, uuid4, uuid5

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_heavy, n_parts, read, shared_dir, small_batches

CHUNKS = "archive string, record_id string, warc_type string, page_id long, refers_to long, chunk long, last boolean, bytes_so_far long, digest_so_far string, declared_digest string, chunk_bytes binary"
EMPTY_DIGEST = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}')}>"


def safe_uri(url: str | None, page_id: int) -> str:
    """The page's address on one header line, as it stands but for bytes that an address can't hold, which are
    percent-encoded; it is never parsed, so a malformed one stays malformed. What has none
    gets one from its id."""
    kept = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    return kept if "://" in kept else f"urn:page:{page_id}"


class RecordWriter:
    """Records written one after another to a sink, each a gzip member that its chunks are fed to."""

    def __init__(self, sink: IO[bytes]) -> None:
        self.sink, self.records, self.gzip = sink, 0, None

    def begin(self, headers: list[tuple[str, str]], size: int, digest: str | None) -> None:
        """``digest`` (SHA-1 in hex), if given, and ``size`` are what the chunks to come must add up to."""
        if self.gzip is not None:
            raise ValueError("a record begins before the one before it ends")
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {size}\r\n\r\n"
        self.gzip, self.left, self.sha, self.digest = zlib.compressobj(3, zlib.DEFLATED, 31), size, hashlib.sha1(), digest
        self.sink.write(self.gzip.compress(head.encode()))

    def add(self, data: bytes) -> None:
        self.left -= len(data)
        self.sha.update(data)
        self.sink.write(self.gzip.compress(data))

    def end(self) -> None:
        if self.left or (self.digest is not None and self.sha.hexdigest() != self.digest):
            raise ValueError("a record's chunks are not the payload that its head declares")
        self.sink.write(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.gzip = None
        self.records += 1


def _headers(x, refers: int | None) -> list[tuple[str, str]]:
    out = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(x.page_id)), ("WARC-Target-URI", safe_uri(x.url, x.page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    out += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(x.payload_hex)).decode()}"), ("X-Page-ID", str(x.page_id)), ("Content-Type", "text/html; charset=utf-8")]
    if refers is not None:
        out += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page-ID", str(refers))]
    return out


def _write(folder: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        name, trial = f"{root}/part-{part:06d}.warc.gz", f"{root}/.part-{part:06d}-{uuid4().hex}"
        known, refers = None, None
        with files.open_output_stream(trial, compression=None) as sink:
            out = RecordWriter(sink)
            for frame in frames:
                for x in frame.itertuples(index=False):
                    if known != (x.page_id, x.payload_hex):
                        known, refers = (x.page_id, x.payload_hex), None
                    if x.chunk < 0:
                        refers = x.number
                        continue
                    if x.chunk == 0:
                        out.begin(_headers(x, refers), x.number if refers is None else 0, x.payload_hex if refers is None else None)
                    if refers is None:
                        out.add(x.bytes)
                    if x.last:
                        out.end()
        files.move(trial, name)
        yield pd.DataFrame({"archive": [name], "records": [out.records]})

    return write


def chunked(pages: DataFrame, chunk: int) -> DataFrame:
    """Pages of (page_id, url, html) as chunk rows: page_id, url (on the first), payload_hex (SHA-1),
    number (the payload's bytes), record (a number of the row), chunk (from 0), last, bytes. Null payloads
    are empty; an empty one is one empty chunk."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("record"))
    keyed = keyed.withColumns({"payload_hex": F.sha1("payload"), "number": F.length("payload").cast("long")})
    most = F.greatest(F.ceil(F.col("number") / chunk), F.lit(1)) - 1
    rows = keyed.withColumns({"most": most, "chunk": F.explode(F.sequence(F.lit(0).cast("long"), most))})
    bytes_ = F.substring("payload", F.col("chunk").cast("int") * chunk + 1, chunk)
    return rows.select("page_id", F.when(F.col("chunk") == 0, F.col("url")).alias("url"), "payload_hex", "number", "record", "chunk", (F.col("chunk") == F.col("most")).alias("last"), bytes_.alias("bytes"))


def revisits(ids: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_hex, refers_to) of the pages (page_id, payload_hex, payload_bytes) that revisit another: of
    those whose payloads of at least ``least`` bytes are equal, all but the one with the largest id.

    A digest's largest id is an aggregate, and those of very many pages are joined back by broadcast, so no large
    group of equal payloads ever meets in one task.
    """
    large = ids.where(F.col("payload_bytes") >= least)
    firsts = cut(large.groupBy("payload_hex").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_heavy(large, firsts, "payload_hex", "n").where("refers_to <> page_id").select("page_id", "payload_hex", "refers_to").dropDuplicates(["page_id", "payload_hex"])


def write_archives(pages: DataFrame, folder: str, archives: int, chunk: int = 1 << 18, least: int = 0, archive_bytes: int = 1 << 28) -> DataFrame:
    """Write one record per page of (page_id, url, html) to files in ``folder``: at least ``archives``, and as many
    more as payloads of ``archive_bytes`` each need. Returns (archive, records), one row per file.
    Null payloads are empty; pages without an id are left out; repeated rows are records of their own.
    Whatever an address holds is kept on its line (``safe_uri``)."""
    spark = pages.sparkSession
    small_batches(spark, 64)
    pages = pages.where("page_id IS NOT NULL").select("page_id", "url", "html")
    payload = F.coalesce("html", F.lit(""))
    ids = cut(pages.select("page_id", F.sha1(payload.cast("binary")).alias("payload_hex"), F.octet_length(payload).cast("long").alias("payload_bytes")))
    total = ids.agg(F.sum("payload_bytes")).first()[0] or 0
    parts = max(1, archives, -(-total // archive_bytes))
    # What a page revisits comes as a chunk before its first: one exchange and one sort, and no join, order the records.
    heads = revisits(ids, least).select("page_id", F.lit(None).cast("string").alias("url"), "payload_hex", F.col("refers_to").alias("number"), F.lit(-1).cast("long").alias("record"), F.lit(-1).cast("long").alias("chunk"), F.lit(False).alias("last"), F.lit(None).cast("binary").alias("bytes"))
    ready = chunked(pages, chunk).unionByName(heads).repartition(parts, "page_id", "payload_hex").sortWithinPartitions("page_id", "payload_hex", "record", "chunk")
    return cut(ready.drop("record").mapInPandas(_write(folder), "archive string, records long"))


def inflated(source: IO[bytes], block: int) -> Iterator[bytes]:
    """The bytes of a file of gzip members, at most about ``block`` at a time."""
    member = zlib.decompressobj(31)
    while data := source.read(block):
        while data:
            if out := member.decompress(data, block):
                yield out
            if member.eof:
                data, member = member.unused_data, zlib.decompressobj(31)
            else:
                data = member.unconsumed_tail


def read_records(blocks: Iterator[bytes], chunk: int) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(headers, chunk number, bytes, whether it is the last) of each record of a WARC stream.
    A record without payload is one empty chunk. Holds a block and a chunk, never a record."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(blocks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > 1 << 20 or not fill(len(held) + 1):
                raise ValueError("a WARC header without an end")
        first, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
        del held[: end + 4]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left, number = int(headers["content-length"]), 0
        while True:
            n = min(left, chunk)
            if not fill(n):
                raise ValueError("a WARC record shorter than its length")
            data = bytes(held[:n])
            del held[:n]
            left -= n
            yield headers, number, data, left == 0
            number += 1
            if not left:
                break
        if not fill(4) or held[:4] != b"\r\n\r\n":
            raise ValueError("a WARC record without its closing lines")
        del held[:4]


def b32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of ``CHUNKS``, ids as whole numbers also where some are missing."""
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNKS.split(", ")], dtype=object)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "chunk": "int64", "last": bool, "bytes_so_far": "int64"})


def _read(chunk: int, with_bytes: bool):
    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["archive"]:
                files, path = filesystem(name)
                rows: list[tuple] = []
                held, size, sha = 0, 0, hashlib.sha1()
                with files.open_input_stream(path, compression=None) as source:
                    for h, number, data, last in read_records(inflated(source, 1 << 16), chunk):
                        if number == 0:
                            size, sha = 0, hashlib.sha1()
                        size += len(data)
                        sha.update(data)
                        refers = h.get("x-refers-to-page-id")
                        rows.append((name, h["warc-record-id"], h["warc-type"], int(h["x-page-id"]), refers and int(refers), number, last, size, b32(sha), h.get("warc-payload-digest", "").removeprefix("sha1:"), data if with_bytes else None))
                        held += len(data) if with_bytes else 0
                        if len(rows) >= 4096 or held >= 1 << 23:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    return chunks


def read_archives(archives: DataFrame, chunk: int = 1 << 16, with_bytes: bool = True) -> DataFrame:
    """The chunked record table of the files in column ``archive``: each record as rows of at
    most ``chunk`` bytes, numbered from 0, with bytes and digest up to each, and the digest its
    header declares. Files are read one after another within a task, each as a stream."""
    n = max(n_parts(archives.sparkSession), 1)
    small_batches(archives.sparkSession, 64)
    return archives.select("archive").repartition(n, "archive").mapInPandas(_read(chunk, with_bytes), CHUNKS)


def records(chunked: DataFrame) -> DataFrame:
    """One row per record from its last chunk; archives are read once. A response's size and digest are those
    counted while reading, a revisit's are those of the response it refers to."""
    last = cut(chunked.where("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to", "declared_digest"))
    responses = last.where("record_type = 'response'").drop("declared_digest")
    known = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("declared_digest")).dropDuplicates(["refers_to", "declared_digest"])
    # A table read from archives looks as small as the list of their names; it is not to be broadcast.
    revisits = last.where("record_type = 'revisit'").join(known.hint("merge"), ["refers_to", "declared_digest"], "left")
    return responses.unionByName(revisits.select("page_id", F.col("__bytes").alias("payload_bytes"), F.when(F.col("__bytes").isNotNull(), F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to"))


def op7_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = f"{shared_dir(spark)}/warc-{uuid4().hex}"
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    archives = write_archives(pages, folder, n_parts(spark))
    found = cut(records(read_archives(archives, with_bytes=False)))
    files.delete_dir(root)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest's bare base 32 from its 40 hex digits, five at a time.
OP7_SQL = r"""
WITH keyed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL),
firsts AS (SELECT hex, max(page_id) AS response FROM keyed GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM keyed JOIN firsts USING (hex)
"""
