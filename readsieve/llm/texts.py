"""Words, lines and task helpers shared by the operators on texts.

White space is the six ASCII characters ``[\\x20\\x09-\\x0D]`` throughout, which is
what ``bytes.split()`` splits at; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

BLANKS = " \t\n\v\f\r"
BLOCK = 1 << 20
ROWS_OUT = 1 << 16
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000
BATCH_BYTES = "16m"


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that break no word."""
    start = 0
    while len(data) - start > size:
        end = start + size
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a block at a time."""
    for block in blocks(data):
        yield block.split()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held small enough for texts.

    Several copies of a batch exist at a time, in the executor and in the worker.
    """
    conf = df.sparkSession.conf
    conf.set(RECORDS, min(int(conf.get(RECORDS)), BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def struct(**types: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in types.items()])


def batch_of(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def per_row(
    df: DataFrame, columns: list[str], schema: StructType, make: Callable[[], Callable[..., tuple]]
) -> DataFrame:
    """One row out for each row in. ``make()`` runs once in each task and returns
    the function that turns the values of ``columns`` into those of ``schema``."""
    names = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        function = make()
        for batch in batches:
            sources = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            rows = [function(*(s[i].as_py() for s in sources)) for i in range(batch.num_rows)]
            arrays = [pa.array([r[j] for r in rows], fields.field(n).type) for j, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return small_batches(df).select(*columns).mapInArrow(task, schema)
