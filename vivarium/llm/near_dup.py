"""MinHash near-duplicates with DartMinHash.

Each shingle that occurs w times is a region of weight w. Darts fall on the regions as a Poisson process whose randomness
is a hash of the shingle and of the layer (0 .. w-1), so equal layers of different texts get equal darts. A dart has a
rank and a coordinate; a text's signature keeps the earliest dart of each coordinate. About k ln k + 2k darts are
thrown; a text with an empty coordinate is thrown again over twice the rank range. Two texts agree in a coordinate with
the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vivarium.llm.common import free_name, map_columns, stage, steps, unstage
from vivarium.llm.shingles import Shingled, U, content_keys, mix, multiset, shingle, weighted_jaccard

SIMILARITY, BANDS, ROWS = 0.8, 25, 5
#: Candidates of a bucket: each member with the bucket's centre, and with so many members before it in its part.
LAGS, PART = 3, 1000
#: Members and darts' layers of a block of an open bucket: only the work of a task depends on them, never a result.
BLOCK, BLOCK_LAYERS = 2000, 500_000
#: A text's darts take memory like so many characters, whatever its length.
CHARS_PER_SIGNATURE = 2000
#: A pair that is similar enough fails the comparison of sketches with at most this probability.
SKETCH_MISS = 1e-6


def layers(s: Shingled) -> np.ndarray:
    """A hash for each occurrence of a shingle in its text: of the shingle and of how often it came before."""
    owner = s.owner
    order = np.lexsort((s.shingles, owner))
    sh, own = s.shingles[order], owner[order]
    new = np.concatenate(([True], (sh[1:] != sh[:-1]) | (own[1:] != own[:-1]))) if len(sh) else np.zeros(0, bool)
    where = np.arange(len(sh))
    rank = where - np.maximum.accumulate(np.where(new, where, 0))
    return mix(sh ^ mix(rank.astype(U) + U(0xA0761D6478BD642F)))  # in the order of owner


def signatures(s: Shingled, k: int = BANDS * ROWS) -> np.ndarray:
    """A row of k dart ids for each text; zeros for a text without shingles."""
    cells, n = layers(s), np.diff(s.first)
    out = np.zeros((len(n), k), U)
    wanted = np.flatnonzero(n)
    reach = np.zeros(len(n))
    reach[wanted] = (k * math.log(k) + 2 * k) / n[wanted]
    while len(wanted):
        chosen = np.zeros(len(n), bool)
        chosen[wanted] = True
        own = s.owner
        pick = chosen[own]
        cell, own = cells[pick], own[pick]
        rank = np.zeros(len(cell))
        found = []
        toss = 0
        while len(cell):
            coin = mix(cell + U((2 * toss + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            rank = rank - np.log(((coin >> U(11)).astype(float) + 1) / (1 << 53))
            hit = rank < reach[own]
            cell, own, rank = cell[hit], own[hit], rank[hit]
            found.append((own, rank, mix(coin[hit] ^ U(0xE7037ED1A0B428DB))))
            toss += 1
        own, rank, dart = (np.concatenate(x) for x in zip(*found))
        slot = own * k + (dart % U(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        first = np.full(len(n) * k, -1, np.int64)
        first[slot[late_first]] = late_first  # the earliest dart is written last
        first = first.reshape(len(n), k)
        full = (first[wanted] >= 0).all(axis=1)
        out[wanted[full]] = dart[first[wanted[full]]]
        wanted = wanted[~full]
        reach[wanted] *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]) * U(0x2545F4914F6CDD1D)
    for i in range(parts.shape[2]):
        out = mix(out ^ parts[:, :, i])
    return out.view(np.int64)


def _sign(ids: list, rows: list, texts: list):
    s = shingle(texts)
    keys = content_keys(s)
    signed = signatures(s)
    sketches = [x.tobytes() for x in (signed >> U(56)).astype(np.uint8)]
    yield [ids, rows, keys, [b if k else [] for k, b in zip(keys, band_hashes(signed).tolist())], sketches, np.diff(s.first).tolist()]


def _verify(ka: list, kb: list, ta: list, tb: list):
    known: dict[str, tuple] = {}

    def of(key: str, text: str):
        if key not in known:
            if len(known) > 500:
                known.clear()
            known[key] = multiset(text)
        return known[key]

    yield [ka, kb, [weighted_jaccard(of(a, x), of(b, y)) for a, b, x, y in zip(ka, kb, ta, tb)]]


def bucket_members(bands: DataFrame) -> DataFrame:
    """Rows of (key, n_layers, at, band) in buckets of two or more, with the bucket's size and its centre, the least key."""
    size = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("key").alias("centre")).filter("size > 1")
    return bands.join(size, "band")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of content keys: star and chain of each bucket, hot buckets in parts."""
    star = members.select(F.col("centre").alias("a"), F.col("key").alias("b"))
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / F.lit(PART)))
    w = Window.partitionBy("band", "part").orderBy("key")
    chained = members.withColumn("part", part).withColumn("lags", F.array(*(F.lag("key", i).over(w) for i in range(1, LAGS + 1))))
    chain = chained.select(F.explode("lags").alias("a"), F.col("key").alias("b"))
    return star.unionByName(chain).filter("a < b").distinct()


def least_agreement(similarity: float, k: int = BANDS * ROWS, miss: float = SKETCH_MISS) -> int:
    """The coordinates of k in which a pair of that similarity agrees but for a probability of `miss`."""
    below, n = 0.0, 0
    while n < k and (below := below + math.comb(k, n) * similarity**n * (1 - similarity) ** (k - n)) <= miss:
        n += 1
    return n


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a cell; those of its only block twice."""
    block, i, j = (np.asarray(t[x]) for x in ("block", "i", "j"))
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def tiles(x: np.ndarray, y: np.ndarray, size: int = 500):
    """Parts of x with y; of a block with itself, every pair once (its places in y come after those in x)."""
    own = len(x) == len(y) and bool((x == y).all())
    for at in range(0, len(x), size):
        part = x[at : at + size]
        wanted = np.ones((len(part), len(y)), bool)
        if own:
            wanted = np.arange(len(y))[None, :] > np.arange(at, at + len(part))[:, None]
        yield part, wanted


def cells(members: DataFrame) -> DataFrame:
    """Members with `blocks` of their bucket, dealt to blocks by a hash; a row for each pair of blocks (i <= j) that a member's block is in."""
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return dealt.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with", "blocks")


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes and of which star and chain don't make every pair, with their root."""
    large = members.filter(F.col("size") > LAGS + 2).select("key", "band", "at", "n_layers")
    named = large.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_layers") / F.lit(BLOCK_LAYERS))).alias("blocks")
    several = named.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), blocks).filter("least <> most")
    return named.join(several.select("band", "blocks"), "band").drop("n_layers")


def promising(dealt: DataFrame, similarity: float) -> DataFrame:
    """(key, root, band, i, j, block): a cell's members that have a partner of another class with an alike sketch.

    All pairs of a cell are compared, but for those that share an earlier band too: they meet in that one's bucket,
    which holds both classes and so is open as well.
    """
    least = least_agreement(similarity)

    def find(t: pa.Table) -> pa.Table:
        x, y = _sides(t)
        roots = np.unique(t["root"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(t), -1).T.copy()
        earlier = np.array(t["earlier"].to_pylist(), np.int64).reshape(len(t), -1)
        used = np.zeros(len(t), bool)
        for part, wanted in tiles(x, y):
            agree = np.zeros(wanted.shape, np.uint8)
            for c in sketch:
                agree += c[part][:, None] == c[y][None, :]
            u, v = np.nonzero(wanted & (agree >= least) & (roots[part][:, None] != roots[y][None, :]))
            for at in range(0, len(u), 1 << 16):
                a, b = part[u[at : at + (1 << 16)]], y[v[at : at + (1 << 16)]]
                first = ~(earlier[a] == earlier[b]).any(axis=1)
                used[a[first]] = used[b[first]] = True
        return t.select(["key", "root", "band", "i", "j", "block"]).filter(pa.array(used))

    return dealt.groupBy("band", "i", "j").applyInArrow(find, "key string, root string, band long, i int, j int, block int")


def links_within(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (a < b, similarity) of a cell's pairs of different roots, by their whole texts.

    Every pair of the cell is counted exactly; of the links found, those are given that join classes not joined yet in
    this cell, so that classes come out whole and rows don't grow with the square of a class.
    """

    def find(t: pa.Table) -> pa.Table:
        x, y = _sides(t)
        keys = t["key"].to_pylist()
        names, roots = np.unique(t["root"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        texts = t["text"].to_pylist()
        parts = [shingle(texts[cut]) for cut in steps([len(x or "") for x in texts])]
        n = np.concatenate([np.diff(s.first) for s in parts])
        where, often = np.unique(np.concatenate([layers(s) for s in parts]), return_inverse=True, return_counts=True)[1:]
        shared = often[where] > 1  # a layer of one text only is in no intersection
        column = np.cumsum(often > 1)[where[shared]] - 1
        order = np.argsort(column, kind="stable")
        column, owner = column[order], np.repeat(np.arange(len(n)), n)[shared][order]
        top = np.arange(len(names))  # the class that a root is in by now
        out = []
        for part, wanted in tiles(x, y):
            wanted &= top[roots[part]][:, None] != top[roots[y]][None, :]
            if not wanted.any():
                continue
            both = np.zeros(wanted.shape)
            width = 1024
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                lo, hi = np.searchsorted(column, [c, c + width])
                held = np.zeros((len(keys), width), np.float32)
                held[owner[lo:hi], column[lo:hi] - c] = 1
                both += held[part] @ held[y].T
            value = both / np.maximum(n[part][:, None] + n[y][None, :] - both, 1)
            wanted &= value >= similarity
            for u in np.flatnonzero(wanted.any(axis=1)).tolist():  # one link to each class that is still apart
                v = np.flatnonzero(wanted[u])
                classes, at = np.unique(top[roots[y[v]]], return_index=True)
                own = top[roots[part[u]]]
                for o in v[at[classes != own]].tolist():
                    a, b = sorted((keys[part[u]], keys[y[o]]))
                    out.append((a, b, float(value[u, o])))
                top[np.isin(top, classes)] = own
        return pa.table({k: pa.array([o[i] for o in out], ty) for i, (k, ty) in enumerate((("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64())))})

    return dealt.groupBy("band", "i", "j").applyInArrow(find, "a string, b string, similarity double")


def remaining_links(members: DataFrame, roots: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links that join the classes found so far: every pair of every open bucket is compared, block by block.

    No pair of a bucket is left out but those of one class and those whose sketches (8 bits of each dart) agree in too
    few coordinates, which happens to a pair that is similar enough with a probability of at most SKETCH_MISS. Sketches
    are compared first; only members with a promising partner are met with their texts.
    """
    rest = stage(open_members(members, roots), "open_buckets")
    sketched = rest.join(texts.select(F.col("content_key").alias("key"), "sketch", "bands"), "key")
    dealt = cells(sketched.withColumn("earlier", F.slice("bands", 1, F.col("at"))).drop("bands", "at"))
    found = stage(promising(dealt, similarity), "promising")
    bodies = bodies_of(found.select(F.col("key").alias("content_key")).distinct(), rows, texts)
    return links_within(found.join(bodies, "key"), similarity).dropDuplicates(["a", "b"])


def bodies_of(used: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, text) of the content keys in `used`."""
    wanted = texts.join(used, "content_key").select(F.col("content_key").alias("key"), F.col("rep.row_id").alias("row_id"))
    return stage(rows.select("row_id", "text").join(wanted, "row_id").select("key", "text").dropDuplicates(["key"]), "bodies")


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, similarity) that are similar enough, by their whole texts."""
    used = pairs.select(F.col("a").alias("content_key")).unionByName(pairs.select(F.col("b").alias("content_key"))).distinct()
    bodies = bodies_of(used, rows, texts)
    joined = pairs.join(bodies.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    joined = joined.join(bodies.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return map_columns(joined, _verify, "a string, b string, similarity double", by=2).filter(F.col("similarity") >= similarity)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of its component. Labels take the least label next to them, then jump."""
    both = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = table = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("least"))
        lower = labels.join(near, labels.node == near.u).select("node", "root", F.least("root", "least").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        moved = stage(lower.join(up, "next", "left").select("node", F.coalesce("jump", "next").alias("root"), (F.coalesce("jump", "next") != F.col("root")).alias("changed")), "labels")
        unstage(table)
        table, labels = moved, moved.select("node", "root")
        if moved.filter("changed").isEmpty():
            unstage(both)
            return labels


def row_id():
    """128 bits of doc_id and text: rows that have both alike are the same row."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nulls = F.concat(F.col("doc_id").isNull().cast("string"), F.col("text").isNull().cast("string"))
    return F.unhex(F.md5(F.concat_ws(":", nulls, known("doc_id"), known("text")))).alias("row_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, row_id, class_id, class_size, n_links, is_kept.

    class_id is the least doc_id of the class: texts joined by exact copies and by chains of links, a link being a
    weighted Jaccard similarity (five-word shingles with their counts) of at least `similarity`. n_links counts a text's
    found links to different texts: once two classes are joined, further links between them need not be found. is_kept marks the row of the least (doc_id, text hash) of the class. A text without
    words (or null) is a class of its own and kept (class_id its doc_id). A class without any doc_id has a null class_id.
    Repeated rows share a class and all count in class_size. Very long texts are used whole; other columns of docs,
    whatever their names, are left out; an empty table gives no rows.
    """
    rows = docs.select("doc_id", row_id(), "text")
    ddl = "doc_id long, row_id binary, content_key string, bands array<long>, sketch binary, n_layers long"
    signed = stage(map_columns(rows, _sign, ddl, by=2, least=CHARS_PER_SIGNATURE), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")
    texts = signed.filter("content_key <> ''").groupBy("content_key").agg(F.min(order).alias("rep"), F.count("*").alias("copies"), *(F.first(x).alias(x) for x in ("bands", "sketch", "n_layers")))
    texts = stage(texts, "texts")
    bands = texts.select(F.col("content_key").alias("key"), "n_layers", F.posexplode("bands").alias("at", "band"))
    members = stage(bucket_members(bands), "members")
    pairs = stage(candidate_pairs(members), "pairs")
    links = stage(verified(pairs, rows, texts, similarity), "verified")
    unstage(pairs)
    roots = components(links)
    more = stage(remaining_links(members, roots, rows, texts, similarity), "verified")
    unstage(members)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    roots = roots.withColumnRenamed("node", "content_key")
    degree = links.select(F.explode(F.array("a", "b")).alias("content_key")).groupBy("content_key").agg(F.count("*").alias("n_links"))
    named = texts.select("content_key", "rep", "copies").join(roots, "content_key", "left").withColumn("root", F.coalesce("root", "content_key"))
    classes = named.groupBy("root").agg(F.min("rep").alias("first"), F.sum("copies").alias("class_size"))
    of_text = named.join(classes, "root").join(degree, "content_key", "left").select("content_key", "first", "class_size", "n_links")
    found = signed.select("doc_id", "row_id", "content_key").join(stage(of_text, "classes"), "content_key", "left")
    alone = F.col("content_key") == ""
    return found.select(
        "doc_id", "row_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row_id") == F.col("first.row_id"))).alias("is_kept"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns (whatever their names), with one row of each class.

    A repeated row (equal doc_id and text) stays once, whichever of them; texts without words, or null, are classes of
    their own and stay. Very long texts are used whole; an empty table stays empty.
    """
    name = free_name(docs, "row_id")
    kept = near_duplicates(docs, similarity).filter("is_kept").select(F.col("row_id").alias(name))
    return docs.withColumn(name, row_id()).join(kept.distinct(), name, "left_semi").dropDuplicates([name]).drop(name)
