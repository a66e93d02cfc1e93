"""WARC archives with revisit records, and a two-level capture index to read single records back from them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import small_batches, stored

#: Bytes after which an archive is closed, entries of an index block, and how hard records are compressed.
ARCHIVE_BYTES = 1 << 30
BLOCK_ENTRIES = 1_000
LEVEL = 4
#: The place of a page without an id in the order of the index.
NO_ID = -(1 << 63)
HOST = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)((?::[0-9]+)?)([^#]*)", re.I)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """The key a capture is sorted by: the host's labels reversed, then port, path and query; no fragment."""
    found = HOST.match(url or "")
    if not found:
        return url or ""
    labels = found[1].lower().rstrip(".").split(".")
    return f"{','.join(reversed(labels))}{found[2]}){found[3] or '/'}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed on its own: a response with its payload, or a revisit that names the response."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    block = HTTP + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a compressed record."""
    whole = gzip.decompress(raw)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Files:
    """Files of a shared folder, by whatever file system its URI names."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.system, self.root = FileSystem.from_uri(folder)
        self.path, self.handle = None, None

    def create(self, label: str):
        """(path, stream) of a new file; its name tells attempts apart, so a task that is run again harms no other."""
        self.system.create_dir(self.root, recursive=True)
        path = f"{self.root}/{label}-{uuid.uuid4().hex}"
        return path, self.system.open_output_stream(path, compression=None)

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.handle is not None:
                self.handle.close()
            self.path, self.handle = path, self.system.open_input_file(path)
        return self.handle.read_at(length, offset)


def write_archives(
    pages: DataFrame, folder: str, id_column: str, url_column: str, html_column: str, least: int = 0
) -> DataFrame:
    """(key, id, path, offset, length) of the record written for each row of `pages`, in archives under `folder`.

    A payload is the html in UTF-8, null counting as empty. Of records with equal payloads of at least `least` bytes
    that with the largest id is a response, and so are rows that repeat its id; the others revisit it.
    """
    html = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), html.alias("html"))
    payload = F.col("html").cast("binary")
    tagged = rows.withColumn("sha", F.unhex(F.sha1(payload))).withColumn("bytes", F.octet_length("html"))
    groups = stored(tagged.select("id", "sha", "bytes"), "payloads").where(F.col("bytes") >= least)
    shared = groups.groupBy("sha").agg(F.max("id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    tagged = tagged.join(shared.select("sha", "latest"), "sha", "left")
    tagged = tagged.select("id", "url", "html", "sha", F.when(F.col("id").eqNullSafe(F.col("latest")), None).otherwise(F.col("latest")).alias("of"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, stream, path, offset = _Files(folder), None, None, 0
        try:
            for batch in batches:
                out = []
                columns = (batch.column(c).to_pylist() for c in ("id", "url", "html", "sha", "of"))
                for page_id, url, html, sha, of in zip(*columns):
                    if stream is None or offset > ARCHIVE_BYTES:
                        if stream is not None:
                            stream.close()
                        (path, stream), offset = files.create("archive"), 0
                    raw = record(page_id, url, html.encode(), base64.b32encode(sha).decode(), of)
                    stream.write(raw)
                    out.append((url_key(url), NO_ID if page_id is None else page_id, path, offset, len(raw)))
                    offset += len(raw)
                yield _entries(out)
        finally:
            if stream is not None:
                stream.close()

    return tagged.mapInArrow(write, "key string, id long, path string, offset long, length long")


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "id": pa.int64(), "path": pa.string(), "offset": pa.int64(), "length": pa.int64()}
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def build_index(captures: DataFrame, folder: str) -> list[dict]:
    """Writes the index and returns its head: for each index file its first entry, and where its block directory is.

    Captures are sorted by (key, id) over all partitions; each writes one file: compressed blocks of BLOCK_ENTRIES
    entries, then the directory with the first entry and the place of each block. The head has a row for each partition.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path, stream, offset, directory, block = _Files(folder), None, None, 0, [], []

        def close_block():
            nonlocal path, stream, offset, block
            if stream is None:
                path, stream = files.create("index")
            raw = zlib.compress(json.dumps(block).encode(), LEVEL)
            stream.write(raw)
            directory.append((block[0][0], block[0][1], offset, len(raw)))
            offset += len(raw)
            block = []

        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "path", "offset", "length"))):
                block.append(entry)
                if len(block) == BLOCK_ENTRIES:
                    close_block()
        if block:
            close_block()
        if stream is not None:
            raw = zlib.compress(json.dumps(directory).encode(), LEVEL)
            stream.write(raw)
            stream.close()
            yield _entries([(directory[0][0], directory[0][1], path, offset, len(raw))])

    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "path", "offset")
    head = stored(ordered.mapInArrow(write, "key string, id long, path string, offset long, length long"), "directory")
    return sorted((r.asDict() for r in head.collect()), key=lambda r: (r["key"], r["id"]))


class Lookup:
    """Finds captures by (key, id): the head and a directory are searched in memory, then one block is read."""

    def __init__(self, head: list[dict], folder: str):
        self.files, self.head = _Files(folder), head
        self.firsts = [(r["key"], r["id"]) for r in head]
        self.part, self.directory, self.starts = -1, [], []
        self.at, self.block = None, []

    def _open(self, part: int) -> None:
        if part != self.part:
            r = self.head[part]
            self.directory = json.loads(zlib.decompress(self.files.read(r["path"], r["offset"], r["length"])))
            self.starts = [(d[0], d[1]) for d in self.directory]
            self.part = part

    def _load(self, number: int) -> None:
        if self.at != (self.part, number):
            _, _, offset, length = self.directory[number]
            self.block = json.loads(zlib.decompress(self.files.read(self.head[self.part]["path"], offset, length)))
            self.at = (self.part, number)

    def find(self, key: str, page_id: int) -> Iterator[tuple]:
        wanted = (key, page_id)
        part = bisect_right(self.firsts, wanted) - 1
        if part < 0:
            return
        self._open(part)
        # entries that repeat may begin in the block before and go on in those after
        number = max(0, bisect_left(self.starts, wanted) - 1)
        while number < len(self.directory) and self.starts[number] <= wanted:
            self._load(number)
            i = bisect_left(self.block, [key, page_id])
            while i < len(self.block) and (self.block[i][0], self.block[i][1]) == wanted:
                yield tuple(self.block[i])
                i += 1
            if i < len(self.block):
                return
            number += 1


def look_up(keys: DataFrame, head: list[dict], folder: str) -> DataFrame:
    """The captures of each distinct (key, id) of `keys`; sorted first, so that a task reads each block once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Lookup(head, folder)
        for batch in batches:
            pairs = zip(batch.column("key").to_pylist(), batch.column("id").to_pylist())
            yield _entries([found for key, page_id in pairs for found in index.find(key, page_id)])

    wanted = keys.select("key", "id").distinct().repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return wanted.mapInArrow(find, "key string, id long, path string, offset long, length long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """(id, type, of, digest, bytes, html) of each capture, read by its range; a response's digest is computed anew."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch, out = whole.slice(start, 500), []
                for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                    headers, payload = parsed(files.read(path, offset, length))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"record at {offset} of {path} does not have the payload its digest names")
                    ids = (int(headers[h]) if h in headers else None for h in ("X-Page-ID", "X-Refers-To-Page-ID"))
                    size, text = (len(payload), payload.decode()) if kind == "response" else (None, None)
                    out.append((*ids, kind, digest, size, text))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = list(zip(*out)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "of", "type", "digest", "bytes", "html"]
                )

    placed = captures.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(read, "id long, of long, type string, digest string, bytes long, html string")


def archive_round_trip(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least: int = 0,
) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) for each row of `pages`, read back from its archive.

    Writes the archives (see `write_archives`) and their index under `folder`, looks every page up by its key and id,
    and reads the records found. A revisit has no payload of its own; its size is that of the response it refers to.
    Ids are whole numbers; a null id is below all others, and in a group of null ids alone all are responses. A null url has the empty key. Rows repeated are records of their own, all read back. An empty table gives
    an empty result, other columns are ignored. `folder` is a URI of a store that driver and executors share.
    """
    small_batches(pages)
    captures = stored(write_archives(pages, folder, id_column, url_column, html_column, least), "captures")
    head = build_index(captures, folder)
    found = look_up(captures, head, folder)
    kept = stored(read_records(found, folder).drop("html"), "records")
    responses = kept.where("type = 'response'").groupBy("id", "digest").agg(F.max("bytes").alias("n"))
    responses = responses.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "n")
    revisits = kept.where("type = 'revisit'")
    sized = revisits.join(responses, (F.col("of") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    names: list[Column] = [
        F.col("id").alias(id_column), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("of").alias("refers_to"),
    ]
    both = kept.where("type = 'response'").select(*names, F.col("bytes").alias("payload_bytes")).unionByName(
        sized.select(*names, F.col("n").alias("payload_bytes"))
    )
    return both.select(id_column, "payload_bytes", "payload_digest", "record_type", "refers_to")
