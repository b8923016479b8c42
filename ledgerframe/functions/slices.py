"""Python functions on columns that hold what few rows become, however many rows come at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of input that are worked on at once, and rows.
CHARACTERS, ROWS = 1 << 19, 1_000


def _sizes(column: pd.Series | pa.Array) -> np.ndarray:
    if isinstance(column, pa.Array):
        return np.asarray(pc.fill_null(pc.utf8_length(column), 0), dtype="int64")
    return column.map(lambda v: len(v) if isinstance(v, str) else 0).to_numpy("int64")


def _part(column: pd.Series | pa.Array, start: int, end: int) -> pd.Series:
    return pd.Series(column[start:end].to_pylist(), dtype=object) if isinstance(column, pa.Array) else column.iloc[start:end]


def slices(columns: tuple[pd.Series | pa.Array, ...]) -> Iterator[tuple[pd.Series, ...]]:
    """Consecutive rows of columns, as many as fit the limits, one at least. Of Arrow's columns of texts only a slice at a time becomes Python's texts."""
    size = sum(map(_sizes, columns)).tolist()
    start = held = 0
    for k, n in enumerate(size):
        if k > start and (held + n > CHARACTERS or k - start >= ROWS):
            yield tuple(_part(c, start, k) for c in columns)
            start, held = k, 0
        held += n
    if start < len(size):
        yield tuple(_part(c, start, len(size)) for c in columns)


def packed(made: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    """A column in Arrow's form; a frame becomes a column of structs."""
    if isinstance(made, pd.Series):
        return pa.Array.from_pandas(made, type=kind)
    return pa.StructArray.from_arrays([pa.Array.from_pandas(made[f.name], type=f.type) for f in kind], fields=list(kind))


def sliced_udf(kind: T.DataType):
    """`pandas_udf` of a function of columns of texts that is called on a slice of a batch at a time, as what a page becomes is many times its size.

    A batch itself stays in Arrow's form, as its texts in Python, beside it, would hold it twice and more.
    """

    def made(one: Callable):
        form = to_arrow_type(kind)

        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                for part in slices(batch if isinstance(batch, tuple) else (batch,)):
                    yield packed(one(*part), form)

        return F.arrow_udf(run, kind)

    return made
