"""Sequential work on many small groups: each group is gathered on the JVM side and batches of groups go to Python.

Calling Python once a group costs milliseconds each; here a batch holds thousands of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def map_groups(df: DataFrame, key: list[str], fn: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """Applies fn to the rows of every group (in any order); it returns rows of the same columns."""
    schema = df.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for rows in batch.column("rows").to_pylist() for r in fn(rows)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.groupBy(*key).agg(F.collect_list(F.struct(*df.columns)).alias("rows")).select("rows").mapInArrow(run, schema)
