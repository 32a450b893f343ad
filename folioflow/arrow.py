"""mapInArrow kernels over whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., list]], rows: int = 0) -> DataFrame:
    """Apply a kernel to Arrow batches of ``df``.

    ``make()`` runs once in each task and gives ``kernel(*columns)``, which
    takes the batch's columns as Python lists and returns as many lists as
    ``schema`` has fields. Empty batches are passed over. With ``rows`` a call
    gets no more rows than that, for kernels whose memory grows with them. A
    kernel that sums up over its task has the rest as ``kernel.last()``.
    """
    out = to_arrow_schema(_parse_datatype_string(schema), prefers_large_types=False) if _large() else to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        made = lambda cols: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)
        for whole in batches:
            step = rows or max(1, whole.num_rows)
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                yield made(kernel(*(c.to_pylist() for c in b.columns)))
        if hasattr(kernel, "last"):
            yield made(kernel.last())

    return df.mapInArrow(run, schema)


def _large() -> bool:
    import inspect

    return "prefers_large_types" in inspect.signature(to_arrow_schema).parameters
