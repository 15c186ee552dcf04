"""Sequential walks along sessions: sorted rows stream through a task, which keeps one session's state and no more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task hands on at once.
HANDED_ON = 20_000


def along_sessions(df: DataFrame, columns: list[str], begin: Callable[[], object], out: str, order: str = "frame", session: str = "session") -> DataFrame:
    """(session, *out) of a walker along each session's rows in the order of `order`.

    begin() makes a walker for a session; walker.step(*columns) yields rows of `out` for each row, walker.end() for the
    session. A session is walked by one task, in batches: memory holds a batch and the walker, however long the session is.
    """
    kind = df.schema[session].dataType.simpleString()
    schema = StructType.fromDDL(f"{session} {kind}, {out}")
    types, names = [f.type for f in to_arrow_schema(schema)], schema.names

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walker, done = None, None, []
        for batch in batches:
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if walker is None or key != at:
                    if walker is not None:
                        done += [(at, *r) for r in walker.end()]
                    at, walker = key, begin()
                done += [(key, *r) for r in walker.step(*values)]
                if len(done) >= HANDED_ON:
                    yield table(done)
                    done = []
        if walker is not None:
            done += [(at, *r) for r in walker.end()]
        yield table(done)

    rows = df.select(session, *dict.fromkeys([order, *columns])).repartition(session).sortWithinPartitions(session, order)
    return rows.select(session, *columns).mapInArrow(walk, schema)
