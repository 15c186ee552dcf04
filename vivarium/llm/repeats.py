"""Removal of repeated passages by bucket-pointer refinement of a sparse suffix array.

A passage is a string of LENGTH bytes. Each one has an anchor: the q-gram in it whose hash is least, the leftmost of equals, so
equal passages have their anchors at the same place. The suffixes at anchors are the only ones sorted, and they come to lie in
buckets, by q-gram first. An anchor stands for all passages that have it, a run of starts. In a bucket

- a suffix that is alone is unique, and so are its passages;
- suffixes whose whole contexts (all bytes of their passages) have one identifier repeat each other;
- the others are refined: their buckets split by the identifier of the bytes at later offsets, first in steps of q, each step
  the bucket of the up to q passages that hold it, then byte by byte.

Every level does the same with shorter runs and longer common strings, from the identifiers that the level before left, until
a bucket's strings are the passages themselves. Identifiers are 64-bit hashes that are compared within a bucket only, so two
different passages are taken for equal with a probability of about 2 ** -64 for each pair of one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm.common import cleaned, stage, struct, unstage
from vivarium.llm.shingles import U, mix, powers

LENGTH, Q = 200, 25
#: Bytes that one numpy step holds, and requests; only memory depends on them. Places of a step take PLACE_BITS bits.
STEP, REQUESTS, PLACE_BITS = 600_000, 2000, 20
ANCHORS = "k1 long, k2 long, at int, lo int, hi int, bucket long, finer long"
PIECES = "k1 long, k2 long, at int, lo int, hi int, bucket long, finer long, sides binary"
PASSAGES = "k1 long, k2 long, lo int, hi int, bucket long"


def _values() -> np.ndarray:
    """A random number for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Along the last axis: sums of byte values times powers; a difference times an inverse power identifies a string."""
    up, _ = powers(data.shape[-1])
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), U)
    np.cumsum(_values()[data] * up[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` keys in a row, from running minima of blocks of that width in both directions."""
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(U).max, U)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, q-gram, context) of each run of passages of one anchor; valid: starts that are passages."""
    _, down = powers(len(data))
    sums = prefix_sums(data)
    grams = mix((sums[Q:] - sums[:-Q]) * down[: len(sums) - Q])
    place = U((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~place) | np.arange(len(grams), dtype=U), LENGTH - Q + 1)
    anchor = (least & place).astype(np.int64)
    starts = np.flatnonzero(valid[: len(anchor)])
    own = anchor[starts]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(starts) != 1)))) if len(own) else np.zeros(0, np.int64)
    lo, hi = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1] if len(new) else starts[:0]
    at = own[new]
    context = (sums[hi + LENGTH] - sums[lo]) * down[lo]
    shape = ((at - lo) * (LENGTH + 1) + (hi - at + LENGTH)).astype(U)
    return at, lo, hi, grams[at], mix(context ^ mix(shape + U(0x9FB21C651E98DF25)))


def _table(columns: list, ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(column.split() for column in ddl.split(", ")))
    of = {"int": pa.int32(), "long": pa.int64()}
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U else c, of[kind]) for c, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def anchors(docs: DataFrame) -> DataFrame:
    """ANCHORS of documents (k1, k2, data): a row for each anchor, in steps that overlap by a passage less a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            if offsets[-1] - offsets[0] < LENGTH:
                continue
            flat = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            last = offsets[1:] - LENGTH  # the last start in each document
            for begin in range(0, len(flat) - LENGTH + 1, STEP):
                part = flat[begin : begin + STEP + LENGTH - 1]
                first, to = np.searchsorted(offsets, [begin, begin + len(part)], side="right") - 1
                valid = np.zeros(len(part) + 1, np.int32)
                docs_here = np.arange(first, min(to + 1, len(last)))
                u, v = np.maximum(offsets[docs_here], begin), np.minimum(last[docs_here] + 1, begin + len(part) - LENGTH + 1)
                some = u < v
                np.add.at(valid, u[some] - begin, 1)
                np.add.at(valid, v[some] - begin, -1)
                at, lo, hi, gram, context = anchors_of(part, np.cumsum(valid)[: len(part) - LENGTH + 1] > 0)
                if len(at):
                    doc = np.searchsorted(offsets, lo + begin, side="right") - 1
                    shift = begin - offsets[doc]
                    yield _table([k1[doc], k2[doc], at + shift, lo + shift, hi + shift, gram, context], ANCHORS)

    return docs.select("k1", "k2", "data").mapInArrow(run, ANCHORS)


def refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with bucket and finer: those whose finer identifier repeats in their bucket; and for each bucket of several finer
    ones a row of each, whichever, to be split further. The second comes staged, the first from staged tables. Joins are with staged
    tables, so that Spark can split the rows of a bucket that many share."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("finer").alias("least"), F.max("finer").alias("most"))
    buckets = stage(sizes.filter("size > 1").select("bucket", (F.col("least") < F.col("most")).alias("several")), "sizes")
    kept = stage(rows.join(buckets, "bucket"), "buckets")
    unstage(buckets)
    several = kept.filter("several").drop("several")
    payload = [F.first(c).alias(c) for c in rows.columns if c not in ("bucket", "finer")]
    split = stage(several.groupBy("bucket", "finer").agg(F.count("*").alias("often"), *payload), "split")
    again = several.join(split.filter("often > 1").select("bucket", "finer"), ["bucket", "finer"])
    whole = kept.filter("NOT several").unionByName(again.withColumn("several", F.lit(True)))
    return whole.select("k1", "k2", "lo", "hi"), split


def pieces(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """PIECES of the requested anchors: their passages in runs of up to Q starts, which share all but Q - 1 bytes.

    bucket identifies the shared bytes, finer all bytes of the run's passages; sides are the Q - 1 bytes on either side of the shared.
    """
    wanted = requests.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "lo", "hi", "bucket")).alias("wanted"))
    before, width, shared = LENGTH - Q, 2 * LENGTH - Q, LENGTH - Q + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, down = powers(width)
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            flat = np.frombuffer(text.buffers()[2], np.uint8)
            lists = batch.column(3)
            every = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            fields = [np.asarray(every.field(i)) for i in range(4)]
            for cut in range(0, len(owner), REQUESTS):
                doc = owner[cut : cut + REQUESTS]
                at, lo, hi, gram = (f[cut : cut + REQUESTS].astype(np.int64) for f in fields)
                where = (offsets[doc] + at)[:, None] + np.arange(-before, LENGTH)[None, :]
                inside = (where >= offsets[doc][:, None]) & (where < offsets[doc + 1][:, None])
                near = np.where(inside, flat[np.clip(where, 0, len(flat) - 1)], 0).astype(np.uint8)
                sums = prefix_sums(near)
                span = lambda u, v, r: (sums[r, v] - sums[r, u]) * down[u]  # noqa: B023, E731
                for step in range(0, LENGTH - Q + 1, Q):
                    least, most = np.maximum(at - hi, step), np.minimum(at - lo, step + Q - 1)
                    r = np.flatnonzero(least <= most)
                    if not len(r):
                        continue
                    u, v = before - most[r], before - least[r] + LENGTH
                    core = mix(gram[r].view(U) ^ mix(span(np.full(len(r), before - step), np.full(len(r), before - step + shared), r) + U(step)))
                    finer = mix(span(u, v, r) ^ mix(((least * LENGTH + most)[r]).astype(U) + core))
                    edge = np.arange(Q - 1)
                    sides = near[r[:, None], np.concatenate((before - step - (Q - 1) + edge, before - step + shared + edge))[None, :]]
                    blobs = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((np.arange(len(r) + 1) * 2 * (Q - 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sides))])
                    yield _table([k1[doc[r]], k2[doc[r]], (at - step)[r], (at - most)[r], (at - least)[r], core, finer, blobs], PIECES)

    return docs.select("k1", "k2", "data").dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).mapInArrow(run, PIECES)


def passages(runs: DataFrame) -> DataFrame:
    """PASSAGES of the runs left open: bucket identifies the whole passage, by its run's shared bytes and its own share of the sides."""
    edge = Q - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, down = powers(2 * edge)
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, at, lo, hi, bucket = (np.asarray(batch.column(i)) for i in range(6))
            sides = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(at), 2 * edge)
            sums = prefix_sums(sides)
            for back in range(Q):  # passages that begin so many bytes before the shared ones
                start = at - back
                r = np.flatnonzero((lo <= start) & (start <= hi))
                u, v = edge - back, 2 * edge - back
                own = mix(mix((sums[r, v] - sums[r, u]) * down[u] + U(back)) ^ bucket[r].view(U))
                yield _table([k1[r], k2[r], start[r], start[r], own], PASSAGES)

    return runs.select("k1", "k2", "at", "lo", "hi", "bucket", "sides").mapInArrow(run, PASSAGES)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi) of runs of starts, in documents (k1, k2, data), whose passages begin elsewhere too. Runs may overlap."""
    anchored = stage(anchors(docs), "anchors")
    whole, open_runs = refine(anchored)
    first = stage(whole, "repeated")
    runs = stage(pieces(open_runs, docs), "pieces")
    unstage(anchored, open_runs)
    whole, open_runs = refine(runs)
    second = stage(whole, "repeated")
    single = stage(passages(open_runs), "passages")
    unstage(runs, open_runs)
    often = stage(single.groupBy("bucket").count().filter("count > 1").select("bucket"), "often")
    third = stage(single.join(often, "bucket").select("k1", "k2", "lo", "hi"), "repeated")
    unstage(single, often)
    return first.unionByName(second).unionByName(third)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans apart from each other, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1, k2 (128 bits of doc_id and text: rows that have both alike are the same document) and data, the text's bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("k2"), text.cast("binary").alias("data"))


def cut_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, with_bytes, kept: the bytes left.

    Removed is each byte covered by a string of LENGTH bytes that also begins anywhere else: in another row or at another place of
    the same one. A null text is empty; texts shorter than LENGTH stay; repeated rows, ids null or not, count each, so a
    row with its like loses all passages. Very long texts are read in steps of STEP bytes. Other columns of docs are left out;
    an empty table gives no rows.
    """
    spark, keys = docs.sparkSession, keyed(docs)
    with cleaned(spark):
        found = repeated_starts(keys)
        packed = F.collect_set(F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))).alias("runs")
        spans = stage(found.groupBy("k1", "k2").agg(packed), "spans")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    names = struct(ddl).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts, lists = batch.column(1), batch.column(2)
            for i in range(len(texts)):
                text, runs = texts[i].as_buffer(), lists[i].values
                begin = end = np.zeros(0, np.int64)
                if runs is not None and len(runs):
                    runs = np.asarray(runs)
                    begin, end = merged(runs >> 32, (runs & 0xFFFFFFFF) + LENGTH)
                data = memoryview(text)
                edges = [0, *np.column_stack((begin, end)).ravel().tolist(), len(data)]
                kept = b"".join([data[u:v] for u, v in zip(edges[::2], edges[1::2])])
                for column, value in zip(out, (len(data), len(data) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return keys.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "runs").mapInArrow(run, ddl)


