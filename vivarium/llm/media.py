"""Media columns in a store of content-defined chunks.

A payload becomes a WAV file of 8-bit samples. A rolling gear hash cuts it into chunks, so that an insertion moves cuts
only near it. Tasks write the chunks they see to packs; Spark joins on the chunks' digests choose one copy of each, packs
are rewritten with those alone, and every file is an ordered list of chunks from which it is put together and verified.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm import files
from vivarium.llm.common import map_columns, new_path, stage, steps
from vivarium.llm.shingles import U, mix

#: Least and most bytes of a chunk; a cut falls where the upper CUT_BITS bits of the hash are 0, every 2**CUT_BITS bytes on average.
LEAST, MOST, CUT_BITS = 512, 16_384, 11
#: A pack is closed when it holds so many bytes.
PACK_BYTES = 32 << 20
UNIT, RATE = 64, 8000
GEAR = (mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash h[i] = (h[i-1] << 1) + GEAR[data[i]] of 32 bits, at every byte; by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(media: list[bytes]) -> list[list[int]]:
    """Where the chunks of each file end."""
    data = np.frombuffer(b"".join(media), np.uint8)
    hits = np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(data) > 32 else np.zeros(0, np.int64)
    out, offset = [], 0
    for m in media:
        ends, last = [], 0
        for at in (hits[np.searchsorted(hits, offset, "right") : np.searchsorted(hits, offset + len(m), "left")] - offset).tolist():
            while at - last > MOST:
                last += MOST
                ends.append(last)
            if at - last >= LEAST:
                last = at
                ends.append(last)
        while len(m) - last > MOST:
            last += MOST
            ends.append(last)
        if last < len(m):
            ends.append(len(m))
        out.append(ends)
        offset += len(m)
    return out


def _store(docs: DataFrame, folder: str, pack_bytes: int) -> DataFrame:
    """(doc_id, n_bytes, media_sha256, chunks) of each row; chunks that a task hadn't seen have their place in a pack."""
    piece = pa.struct([("digest", pa.string()), ("size", pa.int64()), ("pack", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        out, path, at, seen = None, "", 0, set()
        with contextlib.ExitStack() as opened:
            for batch in batches:
                ids, texts = (c.to_pylist() for c in batch.columns)
                for part in steps([len(t or "") for t in texts]):
                    data = [(t or "").encode() for t in texts[part]]
                    media = [to_wav(padded(d)) for d in data]
                    lists = []
                    for m, ends in zip(media, cuts(media)):
                        chunks = []
                        for a, b in zip([0, *ends], ends):
                            digest = hashlib.blake2b(m[a:b], digest_size=16).hexdigest()
                            chunk = {"digest": digest, "size": b - a}
                            if digest not in seen:
                                if out is None or at >= pack_bytes:
                                    path, at, seen = f"{folder}/{uuid.uuid4().hex}.pack", 0, set()
                                    out = opened.enter_context(files.open_output(path))
                                small = squeeze.compress(m[a:b])
                                out.write(small)
                                chunk |= {"pack": path, "offset": at, "length": len(small)}
                                at += len(small)
                                seen.add(digest)
                            chunks.append(chunk)
                        lists.append(chunks)
                    columns = [pa.array(ids[part], pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(lists, pa.list_(piece))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media_sha256", "chunks"])

    ddl = "doc_id long, n_bytes long, media_sha256 string, chunks array<struct<digest string, size long, pack string, offset long, length long>>"
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


HEAD = 40  # of a chunk in a final pack: its digest, and the size of what follows


def _rewrite(pack: str, places: list[dict]) -> list[tuple[str, str, int, int]]:
    """A pack with the given chunks only, in the place of the old one: (digest, pack, offset, length) of each.

    The new pack is complete before it gets its name, and only then the old one goes; if another try of the task has
    come so far, its pack is read instead. Each chunk in it is headed by its digest and its length.
    """
    final = pack.removesuffix(".pack") + ".chunks"
    out = []
    if not files.exists(final):
        part = f"{final}.{uuid.uuid4().hex}"
        handles = files.Handles(1)
        with files.open_output(part) as new:
            for p in sorted(places, key=lambda p: p["offset"]):
                new.write(f"{p['digest']}{p['length']:08d}".encode() + handles.read(pack, p["offset"], p["length"]))
        handles.close()
        files.move(part, final)
        files.remove(pack)
    with files.open_input(final) as f:
        at, end = 0, f.size()
        while at < end:
            head = f.read_at(HEAD, at).decode()
            length = int(head[32:])
            out.append((head[:32], final, at + HEAD, length))
            at += HEAD + length
    return out


def _features(payload: bytes) -> str:
    """Of the samples: least, greatest, sum, sum of squares around 128, and how often they cross 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    side = x >= 128
    return f"min={x.min()};max={x.max()};sum={x.sum()};energy={((x - 128) ** 2).sum()};crossings={int((side[1:] != side[:-1]).sum())}"


def _rebuild(shas: list, lists: list):
    import zstandard

    expand, handles = zstandard.ZstdDecompressor(), files.Handles()
    out: list[list] = [[], [], [], [], [], []]
    for sha, chunks in zip(shas, lists):
        parts = []
        for c in chunks:
            raw = expand.decompress(handles.read(c["pack"], c["offset"], c["length"]))
            if hashlib.blake2b(raw, digest_size=16).hexdigest() != c["digest"]:
                raise ValueError(f"chunk {c['digest']} in {c['pack']} was altered")
            parts.append(raw)
        media = b"".join(parts)
        if hashlib.sha256(media).hexdigest() != sha:
            raise ValueError(f"the chunks of {sha} don't give it again")
        payload = from_wav(media)
        row = sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), _features(payload)
        for column, x in zip(out, row):
            column.append(x)
    handles.close()
    yield out


def media_columns(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row per row of docs, read back from the store: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, n_chunks.

    A null text is an empty one (64 zero bytes). Equal texts give equal values; repeated rows and null ids each have
    their row; texts of any length are stored whole; other columns are left out; an empty table gives no rows.
    """
    held = stage(_store(docs, new_path(docs.sparkSession, "media"), pack_bytes), "media-lists")
    placed = held.select(F.explode("chunks").alias("c")).select("c.*").filter("pack IS NOT NULL")
    chosen = placed.groupBy("digest").agg(F.min(F.struct("pack", "offset", "length")).alias("at")).select("digest", "at.*")
    packs = chosen.groupBy("pack").agg(F.collect_list(F.struct("digest", "offset", "length")).alias("places"))  # at most PACK_BYTES / LEAST

    def rewrite(paths: list, places: list):
        for pack, chunks in zip(paths, places):
            yield list(map(list, zip(*_rewrite(pack, chunks))))

    store = stage(map_columns(packs, rewrite, "digest string, pack string, offset long, length long"), "media-store")
    lists = held.groupBy("media_sha256").agg(F.first("chunks").alias("chunks"))
    parts = lists.select("media_sha256", F.posexplode("chunks").alias("seq", "c")).select("media_sha256", "seq", F.col("c.digest").alias("digest"))
    found = parts.join(store, "digest").groupBy("media_sha256").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "pack", "offset", "length"))).alias("chunks"))
    near = found.repartition(F.col("chunks")[0]["pack"]).sortWithinPartitions(F.col("chunks")[0]["pack"], F.col("chunks")[0]["offset"])
    ddl = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
    rebuilt = map_columns(near.select("media_sha256", "chunks"), _rebuild, ddl)
    rows = held.select("doc_id", "n_bytes", "media_sha256", F.size("chunks").cast("long").alias("n_chunks"))
    return rows.join(rebuilt, "media_sha256").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
