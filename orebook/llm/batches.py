"""Arrow helpers for the operators that work on record batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_AT_ONCE = 1000


def give_back() -> None:
    """Return to the system what a finished task held: Python workers live on, and Arrow and malloc keep freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries do without
    if trim:
        trim(0)


def add_columns(df: DataFrame, inputs: list[str], new: T.StructType, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``df`` with the columns ``new``; ``make()`` gives a function from lists of ``inputs`` to rows of new values.

    ``make`` runs once per task, so it may build tables that all batches of the task share. Rows, their order and
    all other columns stay as they are; a column of ``df`` with the name of a new one is replaced.
    """
    names = set(new.fieldNames())
    kept = [f.name for f in df.schema.fields if f.name not in names]
    read = [c for c in dict.fromkeys([*kept, *inputs])]
    out = T.StructType([df.schema[c] for c in kept] + list(new.fields))
    fresh = to_arrow_schema(new)

    def run(batches):
        work = make()
        # Slices keep the Python copies of long texts small beside the batch itself.
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, max(1, whole.num_rows), ROWS_AT_ONCE)):
            rows = work(*[batch.column(c).to_pylist() for c in inputs])
            made = list(zip(*rows)) or [()] * len(fresh)
            arrays = [batch.column(c) for c in kept] + [pa.array(v, type=f.type) for v, f in zip(made, fresh)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *fresh.names])
        # The worker may serve another operator next; the memos of this task refer to themselves, so they are collected.
        work = rows = made = arrays = batch = None
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, out)


class Memo(dict):
    """A dictionary that fills itself by ``make`` and starts anew when it is full, so that its size is bounded.

    ``trim`` is called between documents; a single document may let it grow by its own distinct keys.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, key):
        value = self[key] = self._make(key)
        return value

    def trim(self) -> None:
        if len(self) > self._most:
            self.clear()
