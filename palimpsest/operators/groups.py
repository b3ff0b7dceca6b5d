"""Sequential folds over small groups: rows are dealt by key, sorted, and streamed, so a task holds one group at a time and many groups share an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.lineage import on_path

ROWS = 10_000


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[tuple]], Iterable[tuple]], out: str) -> DataFrame:
    """What `fold(key, rows)` gives for each group of `df`, as rows of the schema `out`. `rows` are in `order` and have all columns of `df` but the keys, in theirs."""
    on_path(df.sparkSession)
    rest = [c for c in df.columns if c not in keys]
    schema = to_arrow_schema(T.StructType.fromDDL(out))
    width = len(keys)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made = None, [], []
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != now:
                    if held:
                        made += fold(now, held)
                    now, held = row[:width], []
                    if len(made) >= ROWS:
                        yield batch_of(made)
                        made = []
                held.append(row[width:])
        if held:
            made += fold(now, held)
        if made:
            yield batch_of(made)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
