"""Best-fit packing by the histogram of lengths.

The plan packs counts, not documents: from the longest length down, each length goes to the open sequences with the
least room that holds it, whole groups of equal sequences at a time. The plan is a list of runs of slots, at most a few
for each of the lengths; documents take their slots by a join on their rank within their length.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vivarium.llm.common import map_columns, stage

LENGTH, END = 4096, 1
#: Rows of one length that one task ranks, and ranks of one length that one join key holds.
PART, BLOCK = 50_000, 1024
#: Words whose ids a worker remembers.
REMEMBERED = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Signs at the end of a word that never merge with its letters: cut off before the word is looked up.
TAIL = ".,!?;:"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of texts by one tokenizer, as little-endian unsigned 32-bit numbers; a word's are worked out when it is first looked up.

    The tokenizer drops white space and merges within runs of letters only, so a text's ids are those of its words
    between spaces, and a word's ids are those of its letters and of the signs behind them. Runs of letters go to the
    tokenizer's model itself, without its slow splitting; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.cores: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(TAIL)
        ids = self._core(core) if core.isalpha() else None
        if ids is None:
            ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif len(core) < len(word):
            ids += self._tail(word[len(core) :])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def _core(self, core: str) -> bytes | None:
        """Ids of a run of letters, if lower-casing leaves it one and it is in composed form."""
        low = core.lower()
        if not core.isascii():
            if len(low) != len(core) or "Σ" in core:  # letters by themselves, as the tokenizer lower-cases
                low = "".join([c.lower() for c in core])
            if not low.isalpha() or not unicodedata.is_normalized("NFC", core):
                return None
        found = self.cores.get(low)
        if found is None:
            spelled = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            found = _packed([t.id for t in self.tokenize(spelled)])
            if len(self.cores) >= REMEMBERED:
                self.cores.clear()
            self.cores[low] = found
        return found

    def _tail(self, tail: str) -> bytes:
        found = self.cores.get(tail)
        if found is None:
            found = self.cores[tail] = _packed(self.tokenizer.encode(tail, add_special_tokens=False).ids)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id."""
        end, look = END.to_bytes(4, "little"), self.__getitem__
        return [b"".join(map(look, (t or "").replace("\n", " ").split(" "))) + end for t in texts]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encode(texts: list[str | None], path: str) -> list[bytes]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or default_tokenizer()

    def cut(ids: list, texts: list):
        out: list[list] = [[], [], [], [], []]
        for doc, got in zip(ids, encode(texts, path)):
            for k, at in enumerate(range(0, len(got), 4 * length)):
                part = got[at : at + 4 * length]
                for column, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    column.append(x)
        yield out

    return map_columns(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long", by=1)


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, rank after the last, sequence of the first, offset), rank by rank."""
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                space = rooms[k]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], rooms[k]
            else:
                space, first = capacity, sequences
                n = -(-left // (capacity // size))
                sequences += n
            each = space // size
            for bins, copies in ((min(n, left // each), each), (1, None)):
                copies = left if copies is None else copies
                if not bins or not copies or not n:
                    continue
                for c in range(copies):
                    slots.append((size, rank + c * bins, rank + (c + 1) * bins, first, capacity - space + c * size))
                rank, left = rank + bins * copies, left - bins * copies
                put(space - copies * size, first, bins)
                first, n = first + bins, n - bins
                if n and left >= each:
                    raise AssertionError("a full bin was left")
            if n:
                put(space, first, n)
    return slots


def in_parts(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Staged pieces with `part`: of each length as many parts as its PART rows need. Rows are dealt by where they are staged, so
    equal ones part too."""
    sizes = pa.table({"length": pa.array(list(counts), pa.int64()), "parts": pa.array([-(-n // PART) for n in counts.values()], pa.int64())})
    places = cut.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("at"))
    parts = F.broadcast(cut.sparkSession.createDataFrame(sizes))  # a row for each length
    return places.join(parts, "length").withColumn("part", F.pmod("at", F.col("parts"))).drop("at")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and the end id 1; over `length` ids it is cut, its last piece may be shorter. A null or empty text
    is the end id alone. Repeated rows and null ids are packed each for itself; pieces of one length may trade places;
    other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, length), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `length` rows
    slots = plan(counts, length)
    names = ("length", "rank_from", "rank_to", "first", "offset")
    columns = list(zip(*slots)) if slots else [[]] * 5
    runs = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}))
    runs = runs.withColumn("block", F.explode(F.expr(f"sequence(rank_from div {BLOCK}, (rank_to - 1) div {BLOCK})")))

    dealt = in_parts(cut, counts)
    before = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).withColumn("block", F.expr(f"rank div {BLOCK}"))
    placed = ranked.join(runs, ["length", "block"]).filter("rank >= rank_from AND rank < rank_to")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
