"""Helpers that the operators share: the shared folder, staged tables and Arrow mapping."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from vivarium.llm import files

#: Characters of text that one numpy step holds at a time; only memory depends on it, never a result.
CHARS_PER_STEP = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may leave it unset:
    a temporary folder then takes its place; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vivarium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps start there, whatever executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """While it holds, the shuffle files of a query go once the query has ended: each stage() then leaves its table alone on disk.
    The session's setting is put back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unstage(*staged: DataFrame) -> None:
    """Delete tables that stage() wrote, once what was made from them is staged itself."""
    for df in staged:
        files.remove_folder(df.staged_at)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def steps(lengths: list[int], budget: int = CHARS_PER_STEP) -> Iterator[slice]:
    """Slices of consecutive rows whose lengths sum to about the budget (a longer row stands alone)."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > budget:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def map_columns(df: DataFrame, fn: Callable[..., Iterable[list]], ddl: str | StructType, by: int | None = None, least: int = 0) -> DataFrame:
    """Run fn over lists of df's columns, in Arrow batches cut by the text lengths of column `by`, each text counted as
    `least` characters at least (for work that takes memory for every text, however short).

    fn takes one list per column and yields lists of output columns in the order of ddl.
    """
    schema = struct(ddl) if isinstance(ddl, str) else ddl
    types = [f.type for f in to_arrow_schema(schema)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            if not columns or not columns[0]:
                continue
            cuts = [slice(None)] if by is None else steps([max(len(x or ""), least) for x in columns[by]])
            for cut in cuts:
                for out in fn(*(c[cut] for c in columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types)], names=names)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows of df, all columns as they are, for which keep(values of column) is true; one pass, no join."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            good: list[bool] = []
            for cut in steps([len(x or "") for x in values]):
                good += keep(values[cut])
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(mod)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
