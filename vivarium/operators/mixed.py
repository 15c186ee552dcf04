"""Models with random intercepts by maximum likelihood, from sums that Spark adds up.

value ~ group * timepoint, with an intercept for each subject and, where told, one for each litter or cage that holds subjects.
A subject of n rows enters the likelihood through its sums over the cells of group and time point, and its weight depends on
n alone; a litter enters through its subjects' sums, weighted by their n. Each pass over these sums gives the likelihood
of many pairs of variance ratios at once, so the driver gets a few numbers by pair and cells, never rows of subjects,
sizes or litters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A design has at most so many cells of group x time point; more is refused.
MOST_CELLS = 200
SCHEMA = "term string, estimate double, se double, z double, p double"
#: Ratios of variances searched, and numbers that one task adds up at once (pairs of ratios x cells x cells).
LEAST, MOST, HELD = 1e-6, 1e6, 2_000_000
#: Sums that one task of a pass reads, tasks whose results the driver adds up itself, and rows whose subjects one task puts in turn.
PASSED, TASKS, PART = 500_000, 4, 500_000


@dataclass
class Sums:
    """What a model needs: cells in order, totals by cell, `in_turn` rows, Spark's tables of sums by subject size and by litter, and
    whether a subject is in several litters."""

    cells: list[tuple[str, str]]
    rows: np.ndarray
    values: np.ndarray
    squares: float
    subjects: DataFrame
    sizes: DataFrame
    blocks: DataFrame | None
    shared: bool
    held: list[DataFrame] = field(default_factory=list)

    @property
    def n(self) -> float:
        return float(self.rows.sum())

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def cell_sums(df: DataFrame) -> DataFrame:
    """n, y and yy by subject, block, group and timepoint of (subject, block, group, timepoint, value) rows, block null or absent
    for no litter."""
    rows = df.withColumn("block", F.lit(None).cast("string")) if "block" not in df.columns else df
    rows = rows.dropna(subset=["subject", "group", "timepoint", "value"])
    return rows.groupBy("subject", "block", "group", "timepoint").agg(F.count("*").alias("n"), F.sum("value").alias("y"), F.sum(F.col("value") * F.col("value")).alias("yy"))


def in_turn(numbered: DataFrame, n: float) -> DataFrame:
    """(key, cell, n, y, block) of (subject, block, cell, n, y) rows, from n rows in all: each subject's rows stand together in one
    part. Neighbours are told apart by key: the subject itself where it is a whole number, else its hash of 64 bits."""
    whole = numbered.schema["subject"].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col("subject").cast("long") if whole else F.xxhash64("subject")
    sorted_rows = numbered.repartition(int(n // PART) + 1, "subject").sortWithinPartitions("subject")
    return sorted_rows.select(key.alias("key"), "cell", "n", "y", "block")


def whole_subjects(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray, int]]:
    """Of `in_turn` rows, for some subjects at a time: n and y as matrices of subjects x cells, names of litters, each
    subject's place among them, and rows with another litter than the row before. The last subject waits for the next batch."""
    last, n_open, y_open, name = None, np.zeros(k), np.zeros(k), None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell, n, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
        coded = batch.column(4).dictionary_encode()
        names = coded.dictionary.to_pylist()
        own = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)  # the place after all: no litter
        before = names.index(name) if name in names else len(names) + (name is not None)
        names += [None, name]
        first = np.append(last is None or key[0] != last, key[1:] != key[:-1])
        other = ~first & (own != np.append(before, own[:-1]))
        who = np.cumsum(first)  # 0: the subject left open
        m = int(who[-1]) + 1
        x, v = (np.bincount(who * k + cell, w.astype(float), minlength=m * k).reshape(m, k) for w in (n, y))
        x[0] += n_open
        v[0] += y_open
        code = np.append(before, own[first])
        since = 1 if last is None else 0
        last, n_open, y_open, name = key[-1], x[-1].copy(), v[-1].copy(), names[code[-1]]
        yield x[since:-1], v[since:-1], names, code[since:-1], int(np.count_nonzero(other))
    if last is not None:
        yield n_open[None], y_open[None], [name], np.zeros(1, np.int64), 0


def subject_sums(rows: DataFrame, k: int) -> DataFrame:
    """(block, size, place, s) of `in_turn` rows. Without a block, for subjects of a size: the sums of n x n of each two cells
    (places i x k + j), of n x total, of total squared, and of subjects; place -1 of size 0 counts rows with another litter.
    With one, for its subjects of a size: the sums of n by cell (places below k), of subjects, and of totals. A task adds up whole
    batches as products of matrices and hands on a matrix by size and a row by litter and size."""
    width = k * k + k + 2

    def table(held: dict[tuple[str | None, int], np.ndarray], wide: int) -> pa.RecordBatch:
        which, place = np.nonzero(np.array(list(held.values())).reshape(-1, wide))
        keys, s = list(held), np.array(list(held.values())).reshape(-1, wide)[which, place]
        block, size = pa.array([b for b, _ in keys], pa.string()).take(pa.array(which)), np.array([z for _, z in keys], np.int64)[which]
        return pa.RecordBatch.from_arrays([block, pa.array(size), pa.array(place, pa.int32()), pa.array(s, pa.float64())], names=["block", "size", "place", "s"])

    def add(held: dict, key: tuple[str | None, int], part: np.ndarray) -> None:
        held[key] = held[key] + part if key in held else part

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, by_litter, others = {}, {}, 0
        for x, v, names, code, other in whole_subjects(batches, k):
            others += other
            if not len(x):
                continue
            order = np.lexsort((code, x.sum(axis=1)))
            x, y, code = x[order], v.sum(axis=1)[order], code[order]
            size = x.sum(axis=1).astype(np.int64)
            found, starts = np.unique(size, return_index=True)
            for z, a, b in zip(found.tolist(), starts, [*starts[1:], len(size)]):
                add(by_size, (None, z), np.concatenate(((x[a:b].T @ x[a:b]).ravel(), x[a:b].T @ y[a:b], [y[a:b] @ y[a:b], b - a])))
                if len(by_size) * width > HELD:
                    yield table(by_size, width)
                    by_size = {}
            starts = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (code[1:] != code[:-1])))
            for c, z, part in zip(code[starts].tolist(), size[starts].tolist(), np.add.reduceat(np.column_stack((x, np.ones(len(x)), y)), starts)):
                if names[c] is not None:
                    add(by_litter, (names[c], z), part)
            if len(by_litter) * (k + 2) > HELD:
                yield table(by_litter, k + 2)
                by_litter = {}
        yield table(by_size, width)
        yield table(by_litter, k + 2)
        if others:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([float(others)])], names=["block", "size", "place", "s"])

    return rows.mapInArrow(products, "block string, size long, place int, s double").groupBy("block", "size", "place").agg(F.sum("s").alias("s"))


def few_parts(df: DataFrame, weight) -> DataFrame:
    """A persisted table in as many parts as its sums need: each of the many passes over it runs a task by part."""
    n = df.agg(F.sum(weight)).first()[0] or 0
    return df.coalesce(int(n // PASSED) + 1)


def design_sums(cells: DataFrame, litters: bool) -> Sums | None:
    """Sums of `cell_sums`, with those of litters if told; None for fewer than four rows."""
    cells = cells.persist()
    found = cells.groupBy("group", "timepoint").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy")).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"group and time point make over {MOST_CELLS} cells")
    if sum(r["n"] for r in found) < 4:
        cells.unpersist()
        return None
    found = sorted(found, key=lambda r: (r["group"], r["timepoint"]))
    names = [(r["group"], r["timepoint"]) for r in found]
    # an Arrow table needs no Python task to become a broadcast
    index = cells.sparkSession.createDataFrame(pa.table({"group": [g for g, _ in names], "timepoint": [t for _, t in names], "cell": pa.array(range(len(names)), pa.int32())}))
    numbered = cells.join(F.broadcast(index), ["group", "timepoint"])  # at most MOST_CELLS rows
    block = F.col("block") if litters else F.lit(None).cast("string")
    subjects = in_turn(numbered.select("subject", block.alias("block"), "cell", "n", "y"), sum(r["n"] for r in found))
    every = subject_sums(subjects, len(names)).persist()
    sizes = every.filter("block IS NULL AND place >= 0").select("size", "place", "s").persist()
    held, blocks, shared = [cells, every, sizes], None, False
    if litters:
        shared = every.filter("place < 0").count() > 0
        blocks = every.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("size", "place", "s")).alias("parts")).persist()  # sizes x cells of a litter
        held.append(blocks)
        blocks = few_parts(blocks, F.size("parts"))
    sizes = few_parts(sizes, F.lit(1))
    at = lambda name: np.array([float(r[name]) for r in found])
    return Sums(names, at("n"), at("y"), float(at("yy").sum()), subjects, sizes, blocks, shared, held)


def added_up(df: DataFrame, block, width: int, pieces=iter) -> np.ndarray:
    """The sum over all batches (or pieces(batches)) of block(batch), an array of `width` doubles, added up by task and then by few tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for piece in pieces(batch for batch in batches if batch.num_rows):
            total += block(piece).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["z"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for z in batch.column(0).to_pylist():
                total += np.frombuffer(z)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["z"])

    few = df.mapInArrow(part, "z binary")
    if df.rdd.getNumPartitions() > TASKS:
        few = few.repartition(TASKS).mapInArrow(merge, "z binary")
    return np.sum([np.frombuffer(r["z"]) for r in few.collect()] or [np.zeros(width)], axis=0)


def likelihoods(sums: Sums, ratios: list[tuple[float, float]]) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
    """For pairs of ratios (subject, litter) to the variance within: loss, cell means, their inverse covariance by s2, and s2."""
    k = len(sums.cells)
    width = k * k + k + 2  # matrix, vector, squares, logarithms
    step = max(1, HELD // width)
    out = []
    for cut in range(0, len(ratios), step):
        some = ratios[cut : cut + step]

        def by_size(batch: pa.RecordBatch) -> np.ndarray:
            size, place, s = (np.asarray(batch.column(c)) for c in range(3))
            total = np.zeros((len(some), width))
            for c, (r, _) in enumerate(some):  # noqa: B023
                weight = np.where(place == k * k + k + 1, np.log1p(r * size), r / (1 + r * size))
                total[c] = np.bincount(place, weight * s, minlength=width)
            return total

        def by_block(batch: pa.RecordBatch) -> np.ndarray:
            lists = batch.column(0)
            every = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            size, place, x = (np.asarray(every.field(c)) for c in range(3))
            cells, whole, totals = place < k, place == k, place == k + 1
            total = np.zeros((len(some), width))
            for c, (r, rb) in enumerate(some):  # noqa: B023
                w = 1 / (1 + r * size)
                n = len(lists)
                s = np.bincount(owner[whole], (x * size * w)[whole], minlength=n)
                v = np.bincount(owner[totals], (x * w)[totals], minlength=n)
                u = np.bincount(owner[cells] * k + place[cells], (x * w)[cells], minlength=n * k).reshape(n, k)
                h = rb / (1 + rb * s)
                total[c] = np.concatenate((((u * h[:, None]).T @ u).ravel(), (u * h[:, None]).T @ v, [h @ (v * v), np.log1p(rb * s).sum()]))
            return total

        taken = added_up(sums.sizes.select("size", "place", "s"), by_size, len(some) * width).reshape(len(some), width)
        if sums.blocks is not None and any(rb for _, rb in some):
            taken = taken + added_up(sums.blocks.select("parts"), by_block, len(some) * width).reshape(len(some), width)
        for t in taken:
            a, b = np.diag(sums.rows) - t[: k * k].reshape(k, k), sums.values - t[k * k : k * k + k]
            beta = np.linalg.solve(a, b)
            s2 = max(sums.squares - t[k * k + k] - float(beta @ b), 1e-300) / sums.n
            out.append((sums.n * math.log(s2) + t[k * k + k + 1], beta, a, s2))
    return out


def best_ratios(sums: Sums, litters: bool) -> tuple[float, float]:
    """The pair of ratios of the greatest likelihood: a grid over all orders of magnitude, then ever finer ones around the best."""
    grid = [0.0, *np.geomspace(LEAST, MOST, 13)]
    axes = [grid, grid if litters else [0.0]]
    best, loss, width = (0.0, 0.0), math.inf, 10.0
    for _ in range(24):
        pairs = [(float(a), float(b)) for a in axes[0] for b in axes[1]]
        for pair, found in zip(pairs, likelihoods(sums, pairs)):
            if found[0] < loss - 1e-12 * abs(loss if math.isfinite(loss) else 0):
                best, loss = pair, found[0]
        if width < 1 + 1e-7:
            break
        around = np.linspace(-1, 1, 9)
        axes = [[0.0] if b == 0 else [b, *(b * width**around)] for b in best]
        axes[1] = axes[1] if litters else [0.0]
        width = width ** (0.35 if litters else 0.25)
    return best


def clustered(sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """Cell means by least squares, and their covariance with errors that hang together within a subject."""
    k = len(sums.cells)
    beta = sums.values / sums.rows

    def outer(piece) -> np.ndarray:
        score = piece[1] - piece[0] * beta
        return np.concatenate(((score.T @ score).ravel(), [len(score)]))

    total = added_up(sums.subjects, outer, k * k + 1, lambda batches: whole_subjects(batches, k))
    g, n = total[-1], sums.n
    factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else 1.0
    bread = np.diag(1 / sums.rows)
    return beta, factor * bread @ total[:-1].reshape(k, k) @ bread


def contrasts(cells: list[tuple[str, str]]) -> list[tuple[str, np.ndarray | None]]:
    """Terms of group * timepoint as weights of cell means; None where a term needs an empty cell."""
    order = {c: i for i, c in enumerate(cells)}
    groups, times = sorted({g for g, _ in cells}), sorted({t for _, t in cells})
    g0, t0 = groups[0], times[0]
    terms = [("Intercept", {(g0, t0): 1})]
    terms += [(f"group[{g}]", {(g, t0): 1, (g0, t0): -1}) for g in groups[1:]] + [(f"time[{t}]", {(g0, t): 1, (g0, t0): -1}) for t in times[1:]]
    terms += [(f"group[{g}]:time[{t}]", {(g, t): 1, (g, t0): -1, (g0, t): -1, (g0, t0): 1}) for g in groups[1:] for t in times[1:]]
    out = []
    for name, weights in terms:
        w = None
        if all(c in order for c in weights):
            w = np.zeros(len(cells))
            for c, v in weights.items():
                w[order[c]] = v
        out.append((name, w))
    return out


def estimates(cells: list[tuple[str, str]], beta: np.ndarray, cov: np.ndarray) -> list[tuple]:
    """(term, estimate, se, z, p) of every term."""
    out = []
    for name, w in contrasts(cells):
        if w is None:
            out.append((name, None, None, None, None))
            continue
        estimate, se = float(w @ beta), math.sqrt(max(float(w @ cov @ w), 0.0))
        z = estimate / se if se > 0 else None
        out.append((name, estimate, se, z, None if z is None else math.erfc(abs(z) / math.sqrt(2))))
    return out


def texts(df: DataFrame, *more: str) -> DataFrame:
    plain = [F.col(c).cast("string").alias(c) for c in ("group", "timepoint")]
    return df.select("subject", *more, *plain, F.col("value").cast("double").alias("value"))


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of a term and numbers, by Arrow: no Python task has to start for them."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array(c, pa.float64() if i else pa.string()) for i, c in enumerate(zip(*rows))], names=names))


def mixed_effects(df: DataFrame) -> DataFrame:
    """(term, estimate, se, z, p) of value ~ group * timepoint + (1 | subject), by maximum likelihood.

    The first group and time point, in order of their texts, are the reference. Rows with a null in any of the four
    columns don't count; with fewer than four rows there is no result. A term that needs an empty cell has nulls. Two
    rows more give the variances within and between subjects.
    """
    spark = df.sparkSession
    sums = design_sums(cell_sums(texts(df)), False)
    if sums is None:
        return spark.createDataFrame([], SCHEMA)
    ratio, _ = best_ratios(sums, False)
    _, beta, a, s2 = likelihoods(sums, [(ratio, 0.0)])[0]
    sums.release()
    out = estimates(sums.cells, beta, s2 * np.linalg.inv(a))
    out += [("variance within", float(s2), None, None, None), ("variance between", float(ratio * s2), None, None, None)]
    return few_rows(spark, out, SCHEMA)


NESTED = SCHEMA + ", low double, high double, q double, model string, estimation string, litters string"


def nested_effects(df: DataFrame, dam: str | None = None, cage: str | None = None) -> DataFrame:
    """Terms of value ~ group * timepoint with intercepts for subjects and for their litters, by maximum likelihood.

    Litters are cages within dams where both columns are named, else dams (or cages). term, estimate, se, z, p, the 95 %
    interval (low, high), q (Benjamini and Hochberg's, over the terms but the intercept), model, estimation and what became of
    the litters. They are left out, and litters says so, where there is but one, where a subject is in several, or where
    their variance is nil; where that of subjects is nil too, least squares are used, with errors clustered by subject.
    Rows with a null in any column used don't count; with fewer than four rows there is no result.
    """
    spark = df.sparkSession
    names = [c for c in (dam, cage) if c]
    rows = texts(df, *names)
    none = "not modeled"
    if names:
        block = F.concat_ws("::", *(F.col(c).cast("string") for c in names))
        rows = rows.dropna(subset=names).withColumn("block", block).drop(*names)
    sums = design_sums(cell_sums(rows), bool(names))
    if sums is None:
        return spark.createDataFrame([], NESTED)
    if names and (sums.shared or sums.blocks.limit(2).count() < 2):
        names, none = [], "not modeled (a subject in several litters)" if sums.shared else "not modeled (a single litter)"
    litters = none
    ratio, block_ratio = best_ratios(sums, bool(names))
    if names and block_ratio == 0:
        names, litters = [], "not modeled (singular litter variance)"
    elif names:
        litters = "variance of " + " > ".join(names) + " included"
    fixed = " + ".join(t for t, many in (("group", len({g for g, _ in sums.cells}) > 1), ("timepoint", len({t for _, t in sums.cells}) > 1)) if many) or "1"
    fixed += " + group:timepoint" if fixed.count("+") else ""
    model, estimation = f"value ~ {fixed} + (1 | subject)" + (f" + (1 | {':'.join(names)})" if names else ""), "maximum likelihood"
    variances = []
    if ratio == 0 and not names:
        beta, cov = clustered(sums)
        model, estimation = f"value ~ {fixed} [errors clustered by subject]", "least squares, errors clustered by subject (no variance between subjects)"
    else:
        _, beta, a, s2 = likelihoods(sums, [(ratio, block_ratio)])[0]
        cov = s2 * np.linalg.inv(a)
        variances = [("variance within", s2), ("variance between", ratio * s2)] + ([("variance of litters", block_ratio * s2)] if names else [])
    sums.release()
    out = [(*e, None if e[2] is None else e[1] - 1.959963984540054 * e[2], None if e[2] is None else e[1] + 1.959963984540054 * e[2]) for e in estimates(sums.cells, beta, cov)]
    out += [(name, float(v), None, None, None, None, None) for name, v in variances]
    found = few_rows(spark, out, SCHEMA + ", low double, high double").withColumn("counted", F.when(F.col("term") != "Intercept", F.col("p")))
    last = Window.orderBy(F.col("counted").desc_nulls_first())  # a row for each term
    ranked = found.withColumn("m", F.count("counted").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.col("counted").asc_nulls_last())))
    q = F.when(F.col("counted").isNotNull(), F.min(F.when(F.col("counted").isNotNull(), F.least(F.col("counted") * F.col("m") / F.col("rank"), F.lit(1.0)))).over(last))
    return ranked.select("term", "estimate", "se", "z", "p", "low", "high", q.alias("q"), F.lit(model).alias("model"), F.lit(estimation).alias("estimation"), F.lit(litters).alias("litters"))
