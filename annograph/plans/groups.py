"""Streaming over bounded groups inside a sorted partition.

Cheaper than one pandas frame per group: Spark partitions and sorts, Arrow batches arrive, consecutive rows of one key go
to the function as plain lists. Callers must have moved unbounded groups to another path first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    function: Callable[[tuple, dict[str, list]], Iterable[tuple]],
    schema: str,
) -> DataFrame:
    """Apply `function(key values, columns)` to each group; it yields output tuples in `schema` order."""
    target = _parse_datatype_string(schema)
    assert isinstance(target, StructType)
    arrow = to_arrow_schema(target)
    names = list(df.columns)
    keys = list(keys)

    def run(batches):
        pending: dict[str, list] | None = None

        def emit(groups):
            rows = [row for key, columns in groups for row in function(key, columns)]
            if rows:
                arrays = [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), arrow)]
                return pa.RecordBatch.from_arrays(arrays, schema=arrow)
            return None

        for batch in batches:
            data = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            if pending is not None:
                data = {n: pending[n] + data[n] for n in names}
            ids = list(zip(*[data[k] for k in keys]))
            starts = [0] + [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]] if ids else []
            done = []
            for a, b in zip(starts, starts[1:]):
                done.append((ids[a], {n: data[n][a:b] for n in names}))
            pending = {n: data[n][starts[-1]:] for n in names} if starts else None
            out = emit(done)
            if out is not None:
                yield out
        if pending is not None:
            out = emit([(tuple(pending[k][0] for k in keys), pending)])
            if out is not None:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def changes(*columns: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each row but the first differs from the row before in any of the columns; null is a value of its own."""
    codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
    return np.any([c[1:] != c[:-1] for c in codes], axis=0)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group number of each row, from 0) of batches sorted by `keys`; many groups at once, none of them cut."""
    held: list[pa.RecordBatch] = []

    def closed(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        rows = rows.combine_chunks()
        return rows, np.concatenate([[0], np.cumsum(changes(*[rows.column(k) for k in keys]))])

    for batch in batches:
        if not batch.num_rows:
            continue
        joint = [*([held[-1].slice(held[-1].num_rows - 1)] if held else []), batch]
        cuts = np.flatnonzero(changes(*[pa.chunked_array([b.column(b.schema.get_field_index(k)) for b in joint]) for k in keys]))
        if len(cuts):
            done = int(cuts[-1]) + 1 - (len(joint) - 1)
            yield closed(pa.Table.from_batches([*held, batch.slice(0, done)]))
            held = [batch.slice(done)]
        else:
            held.append(batch)
    if held:
        yield closed(pa.Table.from_batches(held))
