"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

GROUP_BYTES = 1_000_000


def per_batch(df: DataFrame, columns: dict[str, str], schema: str, work: Callable[[dict[str, list]], dict[str, list]],
              group_bytes: int = GROUP_BYTES, weigh: str | None = None) -> DataFrame:
    """Apply ``work`` to lists of the named columns (new name -> input column), Arrow batch by Arrow batch.

    Only those columns are read, so further columns of any name do no harm. With ``weigh`` (a string column)
    a batch is cut into groups of about ``group_bytes`` bytes, which bounds what one step holds in memory;
    one longer text is a group of its own. ``work`` returns lists under the names of ``schema``.
    """
    chosen = df.select(*[df[source].alias(name) for name, source in columns.items()])
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in groups(batch, weigh, group_bytes):
                part = batch.slice(first, last - first)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], target.field(n).type) for n in names], schema=target)

    return chosen.mapInArrow(run, schema)


def groups(batch: pa.RecordBatch, weigh: str | None, most: int) -> Iterator[tuple[int, int]]:
    if weigh is None or not batch.num_rows:
        yield 0, batch.num_rows
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(weigh))), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    yield first, batch.num_rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by a hash of ``keys`` over the shuffle partitions of the session."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])
