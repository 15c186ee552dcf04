"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

One edit leaves a half intact. Let v be the shorter of two words one edit apart, s its length, and the edit's place the length of
the words' common prefix. An edit at s div 2 or later leaves the first half, an earlier one the last half. So the words enter
a forward dictionary, sorted by their first halves, and a reversed one, sorted by their reversed last halves, both for s = their own
length and for s = one less, and near words share a block of one of them. A range scan reads the sorted rows block by block.

A block that holds too many words is subdivided in the same way: of the letters that it leaves free, an edit leaves the first half or
the last half intact, so a block fixes `front` letters at the beginning and `back` at the end, down to one free letter. Each pair
belongs to exactly one block, that of its edit's place.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivarium.llm.common import CHARS_PER_STEP, cleaned, stage, unstage

RUN, NO_LETTER = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Every so many runs lose a letter; words have so many letters and occurrences at least; a form is so many times as frequent.
DAMAGED, LETTERS, OCCURRENCES, TIMES = 31, 7, 2, 10
#: Words of a block that is scanned as it is, and words that a task counts before it hands them on; results depend on neither.
BLOCK, COUNTED = 500, 400_000
ENTRY = "key string, word string, n long, s int, front int, back int, tail boolean"


def runs_of(text: str) -> Counter:
    """Runs of letters of a text and how often each occurs; long texts are cut between runs."""
    if len(text) <= CHARS_PER_STEP:
        return Counter(RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        cut = NO_LETTER.search(text, min(at + CHARS_PER_STEP, len(text)))
        end = cut.end() if cut else len(text)
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def spelled(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document, whatever their length: lower-cased runs, some of which lose a letter by a hash of doc_id (null: '') and run."""
    low, out = Counter(), Counter()
    for run, n in runs_of(text or "").items():
        low[run.lower() if run.isascii() else run.translate(LOWER)] += n
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in low.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in spelled(doc_id, text.as_py()).items():
                    if len(word) >= letters:
                        total[word] += n
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with (s, front, back, tail) and the key of their block: its fixed letters, the last ones reversed."""
    first, last = F.expr("left(word, front)"), F.reverse(F.expr("right(word, back)"))
    key = F.concat_ws(":", "s", "front", "back", F.col("tail").cast("string"), first, last)
    return rows.select(key.alias("key"), "word", "n", "s", "front", "back", "tail")


def dictionaries(words: DataFrame) -> DataFrame:
    """ENTRY rows of the forward and the reversed dictionary, for the word as the shorter or equal and as the longer of a pair.

    tail: an edit may stand behind the last free letter.
    """
    half = lambda s: F.floor(s / 2).cast("int")
    size = F.length("word")
    zero, one = F.lit(0), F.lit(1)
    entries = []
    for s in (size, size - one):
        entries.append(F.struct(s.alias("s"), half(s).alias("front"), zero.alias("back"), F.lit(True).alias("tail")))
        entries.append(F.struct(s.alias("s"), zero.alias("front"), (s - half(s)).alias("back"), F.lit(False).alias("tail")))
    return _keyed(words.withColumn("e", F.explode(F.array(*entries))).select("word", "n", "e.*"))


def subdivided(rows: DataFrame) -> DataFrame:
    """Both halves of blocks that hold too many words: those of edits in the later and in the earlier half of their free letters."""
    half = F.expr("(s - front - back) div 2").cast("int")
    later = F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("tail").alias("tail"))
    earlier = F.struct(F.col("front").alias("front"), (F.col("s") - F.col("front") - half).alias("back"), F.lit(False).alias("tail"))
    return _keyed(rows.withColumn("e", F.explode(F.array(later, earlier))).select("word", "n", "s", "e.*"))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """ENTRY rows in blocks of two words or more, subdivided until each holds at most `most` or leaves one letter free."""
    level, done = dictionaries(words), []
    while True:
        sizes = level.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        sized = stage(level.join(sizes, "key"), "blocks")
        wide = (F.col("size") > most) & (F.col("s") - F.col("front") - F.col("back") > 1)
        done.append(sized.filter(~wide).drop("size"))
        if sized.filter(wide).isEmpty():
            break
        level = subdivided(sized.filter(wide))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pairs_of(words: list[str], s: int, front: int, back: int, tail: bool) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart, of words of a block, whose edit's place is the block's; each once."""
    free = s - front - back
    short = {w for w in words if len(w) == s}
    alike = defaultdict(list)
    for w in short:
        for p in range(front, front + free):
            alike[p, w[:p] + w[p + 1 :]].append(w)
    for group in alike.values():
        if len(group) > 1:
            yield from itertools.combinations(group, 2)
    for w in words:
        if len(w) == s + 1:
            for p in range(front, front + free + tail):
                if (p == s or w[p] != w[p + 1]) and (v := w[:p] + w[p + 1 :]) in short:
                    yield v, w


def near_pairs(entries: DataFrame) -> DataFrame:
    """(word, other, other_n) of words one edit apart, both ways, by a scan of the sorted dictionaries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shape = None, {}, None
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(held) > 1:
                for a, b in pairs_of(list(held), *shape):
                    out[0].extend((a, b))
                    out[1].extend((b, a))
                    out[2].extend((held[b], held[a]))

        def table() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "other", "other_n"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != key:
                    close()
                    key, held, shape = row[0], {}, row[3:]
                    if len(out[0]) > 50_000:
                        yield table()
                held[row[1]] = row[2]
        close()
        yield table()

    return entries.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(scan, "word string, other string, other_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, (word, form) rows given; a form is more frequent each time, so there is no ring."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("changed")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("changed").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, most: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Near words are one inserted, deleted or replaced letter apart. form is the near word of largest n (of equals the first in
    code-point order) if that is at least `times` the word's n, else null; root follows forms to the last. Null and empty texts have
    no words; a null doc_id stands for ''; repeated rows count each; very long texts are read in steps, a run of letters
    stays whole; other columns are left out; an empty table gives no rows.
    """
    with cleaned(docs.sparkSession):
        words = stage(vocabulary(docs, letters, occurrences), "words")
        near = near_pairs(blocks(words, most))
        best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("other"))).alias("best")
        neighbours = stage(near.groupBy("word").agg(F.count("*").alias("n_near"), best), "neighbours")
        often = -F.col("best.minus")
        is_form = often >= times * F.col("n")
        formed = words.join(neighbours, "word", "left").select(
            "word", F.when(is_form, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, often).alias("form_n")
        )
        formed = stage(formed, "forms")
        unstage(words, neighbours)
        roots = roots_of(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
