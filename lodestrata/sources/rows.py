"""Row-wise stages over Arrow batches, for the few places that call out of Spark."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROWS = 1000


def in_flight(one: Callable, rows: Iterator, threads: int) -> Iterator:
    """`one` of each row, in order, with up to `threads` calls at a time and as many rows ahead."""
    if threads <= 1:
        yield from map(one, rows)
        return
    with ThreadPoolExecutor(threads) as pool:
        waiting: deque = deque()
        for row in rows:
            waiting.append(pool.submit(one, row))
            if len(waiting) >= 2 * threads:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def map_rows(df: DataFrame, schema: T.StructType, work: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """`work` takes a partition's rows as dicts and yields rows of `schema`; missing names are null."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        rows, out = (row for batch in batches for at in range(0, batch.num_rows, ROWS) for row in batch.slice(at, ROWS).to_pylist()), []
        for row in work(rows):
            out.append(row)
            if len(out) == ROWS:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return df.mapInArrow(run, schema)
