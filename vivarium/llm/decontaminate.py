"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size: class c holds those of more than 2**(c-1) and at most 2**c distinct shingles. A long
document is summarised for class c by windows of two neighbouring blocks of 2**c shingles each, so that what a window
holds is about as large as an item and a run of an item's length lies within one window. A window is a candidate for
an item when one of HASHES min-hashes agrees. If a document holds a share t of an item's q shingles, wherever they lie,
the expected number of agreements is at least HASHES * t * q / (2 * 2**c + q) >= 64 * 0.8 / 5 > 10, so a miss has a
probability below 5e-5. Candidates are then counted exactly. For that, classes begin at items of more than FEW shingles;
every shingle of a document is looked up among those of items of at most FEW, so that none of these is missed. An item of
under five words has one shingle, all its words, and every run of so many words of a document is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm.common import filter_rows, map_columns, stage, unstage
from vivarium.llm.shingles import WIDTH, U, shingle, word_runs

CONTAINMENT, HASHES, LEAST_CLASS = 0.8, 64, 4
#: Items of at most so many distinct shingles are searched exactly: half of a block of the least class, as in the larger classes.
FEW = 1 << (LEAST_CLASS - 1)
#: Items that one pass over the documents takes: at most so many, and their shingles; more items make more passes.
ITEMS_PER_PASS, SHINGLES_PER_PASS = 20_000, 2_000_000
FULL = np.iinfo(np.uint32).max


@dataclass
class Index:
    """Items of one pass, by size class: sorted min-hashes of each hash function, and the items they belong to.

    few has the sorted shingles of the items of at most FEW, the item of each, and which leading 16 bits occur; short has
    the same of the items of so many words, for each number of words below WIDTH that occurs.
    """

    ids: list
    sets: list[np.ndarray]
    classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    few: tuple[np.ndarray, np.ndarray, np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _short(shingles: np.ndarray) -> np.ndarray:
    """32 of the mixed bits; two shingles that share them can only make a candidate more."""
    return (shingles >> U(32)).astype(np.uint32)


#: An odd factor for each hash function: multiplying by it permutes the 32-bit numbers.
FACTORS = [np.uint32(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) >> 20 & 0xFFFFFFFF | 1) for i in range(HASHES)]


def _lookup(sets: list[np.ndarray], items: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items' shingles in order, the item of each, and which leading 16 bits occur."""
    every = np.concatenate([np.zeros(0, U), *(sets[i] for i in items)])
    order = np.argsort(every)
    seen = np.zeros(1 << 16, bool)
    seen[(every >> U(48)).astype(np.int64)] = True
    return every[order], np.repeat(items, [len(sets[i]) for i in items]).astype(np.int64)[order], seen


def build_index(ids: list, texts: list[str | None]) -> Index:
    s = shingle(texts)
    kept, sets, members, small, short = [], [], {}, [], {}
    for i, item in enumerate(ids):
        own = np.unique(s.shingles[s.first[i] : s.first[i + 1]])
        words = int(s.word_first[i + 1] - s.word_first[i])
        if not words:
            continue
        if words < WIDTH:
            short.setdefault(words, []).append(len(kept))
        elif len(own) <= FEW:
            small.append(len(kept))
        else:
            members.setdefault(int(len(own) - 1).bit_length(), []).append(len(kept))
        kept.append(item)
        sets.append(own)
    classes = {}
    for c, items in members.items():
        classes[c] = []
        for h in range(HASHES):
            least = np.array([(_short(sets[i]) * FACTORS[h]).min() for i in items], np.uint32)
            order = np.argsort(least)
            seen = np.zeros(1 << 16, bool)
            seen[(least >> 16).astype(np.int64)] = True
            classes[c].append((least[order], np.array(items)[order], seen))
    return Index(kept, sets, classes, _lookup(sets, small), {n: _lookup(sets, items) for n, items in short.items()})


def _looked_up(shingles: np.ndarray, first: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> set[tuple[int, int]]:
    """(document, item) pairs that share a shingle of the table; document d has shingles from first[d] on."""
    values, items, seen = table
    if not len(values) or not len(shingles):
        return set()
    maybe = np.flatnonzero(seen[(shingles >> U(48)).astype(np.int64)])
    left = np.searchsorted(values, shingles[maybe], "left")
    right = np.searchsorted(values, shingles[maybe], "right")
    hit = left < right
    found: set[tuple[int, int]] = set()
    owner = np.searchsorted(first, maybe[hit], "right") - 1
    for d, i, j in set(zip(owner.tolist(), left[hit].tolist(), right[hit].tolist())):
        found.update((d, int(item)) for item in items[i:j])
    return found


def _of_short(s, index: Index) -> set[tuple[int, int]]:
    """(document, item) pairs, for items of under WIDTH words: a run of the document's words is the item's."""
    found: set[tuple[int, int]] = set()
    for n, table in index.short.items():
        runs = word_runs(s.words, n)
        owner = np.searchsorted(s.word_first, np.arange(len(runs)), "right") - 1
        whole = s.word_first[owner + 1] - np.arange(len(runs)) >= n  # no run goes on into the next text
        kept = np.flatnonzero(whole)
        found |= _looked_up(runs[kept], np.searchsorted(kept, s.word_first), table)
    return found


def _candidates(s, index: Index) -> set[tuple[int, int]]:
    """(document, item) pairs of which some window and the item agree in a min-hash."""
    n = np.diff(s.first)
    base = 1 << LEAST_CLASS
    blocks = -(-n // base)
    first = np.concatenate(([0], np.cumsum(blocks)))
    if not first[-1] or not index.classes:
        return set()
    at = np.arange(first[-1] * base) - np.repeat(first[:-1] * base, blocks * base)  # a text's last block repeats its last shingle
    at = np.repeat(s.first[:-1], blocks * base) + np.minimum(at, np.repeat(n - 1, blocks * base))
    places = np.ascontiguousarray(_short(s.shingles[at]).reshape(-1, base).T)  # a row for each place in a block
    hashed = np.empty_like(places)
    plan = {}
    for c in index.classes:  # where blocks of 2**c begin, and which of them have a neighbour in their text
        wide = 1 << (c - LEAST_CLASS)
        count = -(-blocks // wide)
        owner = np.repeat(np.arange(len(n)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        plan[c] = np.repeat(first[:-1], count) + inner * wide, owner, np.concatenate((owner[1:] == owner[:-1], [False]))
    found: set[tuple[int, int]] = set()
    for h in range(HASHES):
        low = np.minimum.reduce(np.multiply(places, FACTORS[h], out=hashed), axis=0)
        for c, (begin, owner, joined) in plan.items():
            block = np.minimum.reduceat(low, begin)
            window = np.where(joined, np.minimum(block, np.concatenate((block[1:], [FULL]))), block)
            values, items, seen = index.classes[c][h]
            maybe = np.flatnonzero(seen[window >> np.uint32(16)])
            left = np.searchsorted(values, window[maybe], "left")
            right = np.searchsorted(values, window[maybe], "right")
            for w, i, j in zip(*(x[left < right].tolist() for x in (maybe, left, right))):
                found.update((int(owner[w]), int(item)) for item in items[i:j])
    return found


def matches(texts: list[str | None], index: Index, containment: float = CONTAINMENT) -> list[tuple[int, int, int]]:
    """(document, item, shared shingles) for the pairs that hold, exactly counted."""
    s = shingle(texts)
    out = []
    out += [(d, i, 1) for d, i in sorted(_of_short(s, index))]
    for d, i in sorted(_candidates(s, index) | _looked_up(s.shingles, s.first, index.few)):
        shared = int(np.isin(index.sets[i], s.shingles[s.first[d] : s.first[d + 1]]).sum())
        if shared >= containment * len(index.sets[i]) - 1e-9:
            out.append((d, i, shared))
    return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items, one for each block of items; only the stated query set comes to the driver, block by block."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(row.text or "") // 2
        if ids and (len(ids) >= ITEMS_PER_PASS or size + n > SHINGLES_PER_PASS):
            yield build_index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += n
    if ids:
        yield build_index(ids, texts)


def passes(benchmark: DataFrame) -> Iterator[tuple[object, bool]]:
    """(broadcast index, is it the last); each is taken from the driver and the executors before the next one is built."""
    blocks = indexes(benchmark)
    index = next(blocks, None)
    while index is not None:
        sent = benchmark.sparkSession.sparkContext.broadcast(index)
        following = next(blocks, None)
        yield sent, following is None
        if following is not None:
            sent.destroy()
        index = following


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, n_shared, n_item, containment.

    An item is contained if at least `containment` of its distinct five-word shingles occur in the document; an item of
    one to four words if they occur there in a row (n_shared and n_item are then 1). Items and documents without words
    (or null) match nothing. Very long documents are searched whole. Repeated documents or items give their rows each;
    other columns are left out; empty tables give no rows.
    """
    ddl = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    spark, out = docs.sparkSession, None
    for sent, last in passes(benchmark):

        def find(ids: list, texts: list, sent=sent):
            got, items = matches(texts, sent.value, containment), sent.value
            sizes = [len(items.sets[i]) for _, i, _ in got]
            yield [[ids[d] for d, _, _ in got], [items.ids[i] for _, i, _ in got], [x for _, _, x in got], sizes, [x / n for (_, _, x), n in zip(got, sizes)]]

        part = map_columns(docs.select("doc_id", "text"), find, ddl, by=1)
        part = part if last else stage(part, "contained")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ddl)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs, all columns (whatever their names), without the documents that contain an item; a pass for each block of items.

    Documents without words (or null) stay, very long ones are searched whole, repeated rows share their fate; without
    items, docs stays as it is, and an empty table empty.
    """
    before = None
    for sent, last in passes(benchmark):

        def clean(texts: list, sent=sent) -> list[bool]:
            bad = {d for d, _, _ in matches(texts, sent.value, containment)}
            return [i not in bad for i in range(len(texts))]

        docs = filter_rows(docs, "text", clean)
        if not last:
            docs = stage(docs, "clean")
            if before is not None:
                unstage(before)
            before = docs
    return docs
