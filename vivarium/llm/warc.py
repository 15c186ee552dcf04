"""WARC archives from pages, and a normaliser for archives that are one gzip stream.

Tasks first write each archive as a single gzip stream, as many crawlers did. The normaliser inflates such a stream
once from end to end, writes every record again as a gzip member of its own, and puts the members' offsets in a sidecar
index, so that a reader can fetch any record alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm import files
from vivarium.llm.common import map_columns, new_path, stage, unstage

#: An archive is closed when it holds so many bytes of payload.
ARCHIVE_BYTES = 16 << 20
#: Payloads of fewer bytes are stored again each time.
LEAST_REVISIT = 100
#: The pages carry no date of their own.
DATE = "2024-01-01T00:00:00Z"
BLOCK = INFLATED = 1 << 20
#: Index entries of a batch, bytes of html that a reader holds before it passes them on, and the most tasks that archives are dealt to.
ENTRIES, READ_BYTES, MOST_TASKS = 1000, 4 << 20, 4096


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or (refers_to given) a revisit without.

    Every record has an id of its own, also where pages repeat their page_id or have none; a field of its own carries
    the page_id, and a revisit names the page and URI it refers to.
    """
    revisit = refers_to is not None
    head = [f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {DATE}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _uri(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (lower-case names) and the payload behind its HTTP headers."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.lower()] = value.strip()
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file holds, in blocks of at most INFLATED bytes, however well it is packed; the file may have several members."""
    z = zlib.decompressobj(31)
    while block := stream.read(BLOCK):
        while block:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(block, INFLATED)
            block = z.unused_data if z.eof else z.unconsumed_tail
    yield z.flush()


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of bytes; no more than one record and one block is held."""
    held = bytearray()
    blocks = iter(blocks)
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            length = next(int(x.split(b":")[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            total = end + 4 + length + 4
            if len(held) >= total:
                yield bytes(held[:total])
                del held[:total]
                continue
        more = next(blocks, None)
        if more is None:
            if held:
                raise ValueError("the archive ends within a record")
            return
        held += more


def normalise(source: str, target: str) -> list[tuple[int, int, str]]:
    """Rewrite an archive with one member per record, and its index beside it: (offset, length, record id) each."""
    index, at = [], 0
    with files.open_input(source) as stream, files.open_output(target) as out:
        for raw in records(inflated(stream)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            index.append((at, len(member), parse(raw)[0]["warc-record-id"]))
            at += len(member)
    with files.open_output(f"{target}.idx") as out:
        out.write("".join(json.dumps(entry) + "\n" for entry in index).encode())
    return index


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to, refers_url) as archives of one gzip stream; a row per archive: path, n.

    Each try of a task writes under names of its own; the rows name what the successful try wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = None
        path, size, n, done = "", 0, 0, []

        def close() -> None:
            out.write(z.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, z, size, n = files.open_output(path), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                out.write(z.compress(record(*row)))
                size, n = size + len(row[2]), n + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "n"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(run, "path string, n long")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive; a row per new archive: path, n. Its sidecar index is the file path.idx."""

    def run(paths: list, _: list):
        for path in paths:
            target = f"{folder}/{uuid.uuid4().hex}-{path.rsplit('/', 1)[1]}"
            yield [[target], [len(normalise(path, target))]]

    return map_columns(archives.select("path", "n"), run, "path string, n long")


def sidecars(archives: DataFrame) -> DataFrame:
    """The sidecar indexes of archives (path): a row per record: path, offset, length, record_id."""

    def run(paths: list):
        for path in paths:
            with files.open_input(f"{path}.idx") as stream:
                entries = [json.loads(line) for line in stream.read().decode().splitlines()]
            for cut in range(0, len(entries), ENTRIES):
                own = entries[cut : cut + ENTRIES]
                yield [[path] * len(own), *([e[i] for e in own] for i in range(3))]

    return map_columns(archives.select("path"), run, "path string, offset long, length long, record_id string")


def read_records(index: DataFrame, html: bool = True) -> DataFrame:
    """Fetch each indexed record (path, offset, length) alone: page_id, record_type, refers_to, payload_digest, stored_bytes,
    and its html unless that isn't wanted.

    A response's digest is computed from the bytes read and must be the one in its header. Records are passed on every few
    megabytes, however many the index names.
    """

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(paths: list, offsets: list, lengths: list):
        handles = files.Handles()
        held: list[tuple] = []
        size = 0
        for path, offset, length in zip(paths, offsets, lengths):
            headers, payload = parse(zlib.decompress(handles.read(path, offset, length), 31))
            digest = headers["warc-payload-digest"].removeprefix("sha256:")
            response = headers["warc-type"] == "response"
            if response and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{path} at {offset}: the payload has another digest than its header")
            row = (number(headers.get("page-id")), headers["warc-type"], number(headers.get("refers-to-page-id")), digest, len(payload) if response else None)
            held.append((*row, payload.decode() if response else None) if html else row)
            size += len(payload) if html else 0
            if size > READ_BYTES:
                yield [list(c) for c in zip(*held)]
                held, size = [], 0
        handles.close()
        if held:
            yield [list(c) for c in zip(*held)]

    ddl = "page_id long, record_type string, refers_to long, payload_digest string, stored_bytes long" + (", html string" if html else "")
    return map_columns(index.select("path", "offset", "length"), run, ddl)


def archive(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as WARC, normalise the archives and return what there is of them then (path, n), dealt out for reading.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, that of the least page_id is a response and the others
    are revisits of it; rows that repeat that page_id are responses too, and so are pages without id if no page of the
    payload has one. A null html is an empty payload; a null url gives no target header; other columns are left out. Only
    payloads that a revisit is possible for are joined. The archives of one stream are deleted once they are rewritten.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = F.octet_length("payload") >= LEAST_REVISIT
    first = rows.filter(big).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"))
    marked = rows.filter(big).join(first.select("digest", "first.page_id", "first.url").toDF("digest", "first_page", "first_url"), "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first_page"))
    columns = ["page_id", "url", "payload", "digest"]
    marked = marked.select(*columns, F.when(other, F.col("first_page")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))
    small = rows.filter(~big).select(*columns, F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    spark = pages.sparkSession
    raw = new_path(spark, "warc")
    written = stage(write_archives(marked.unionByName(small), raw, archive_bytes), "archives")
    tasks = min(max(written.count(), 1), MOST_TASKS)
    out = stage(normalise_archives(written.repartition(tasks), new_path(spark, "warc-members")), "members")
    files.remove_folder(raw)
    unstage(written)
    return out.repartition(tasks)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """One row per row of pages, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Records are found by the sidecar indexes and fetched alone. A revisit's size is that of the stored response with its
    digest. An empty table gives no rows.
    """
    back = stage(read_records(sidecars(archive(pages, archive_bytes)), html=False), "records")
    is_response = F.col("record_type") == "response"
    stored = back.filter(is_response & (F.col("stored_bytes") >= LEAST_REVISIT)).groupBy("payload_digest").agg(F.max("stored_bytes").alias("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = back.filter(~is_response).join(stored, "payload_digest", "left").select(columns)
    return back.filter(is_response).withColumnRenamed("stored_bytes", "payload_bytes").select(columns).unionByName(revisits)
