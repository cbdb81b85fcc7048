"""One pass over histories that lie sorted, cut wherever the cut falls.

Rows are sorted by ranges of (place, time), so a place with any share of all rows is spread over as many ranges as it needs.
A range is read in batches, and each batch sums up every place it holds in one row, a segment: what it starts with,
what happens inside, what it ends with. The segments of a place, one for thousands of rows, are then put together by
column work: that settles what happens between two batches, two tasks or two ranges alike. Nothing is counted or looked
up beforehand, and no row is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal entries of a column without nulls begins, and where it ends."""
    n = len(column)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    differs = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.flatnonzero(differs) + 1)).astype(np.int64)
    return starts, np.append(starts[1:], n)


def first_in(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """In each stretch the place of its first flag, or -1."""
    set_ = np.append(np.flatnonzero(flags), len(flags))
    found = set_[np.searchsorted(set_, starts)]
    return np.where(found < ends, found, -1)


def taken(column: pa.Array, places: np.ndarray) -> pa.Array:
    """Entries of a column, null where the place is negative."""
    return column.take(pa.array(places, pa.int64(), mask=places < 0))


Summary = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, pa.Array]]


def segments(rows: DataFrame, key: str, order: Sequence[str], summary: Summary, fields: T.StructType) -> DataFrame:
    """One row for each run of ``key`` in a batch of ``rows``, sorted by key and order: the key and what ``summary`` says.

    ``summary`` gets a batch and where its runs begin and end. Rows without key are left out.
    """
    kind = T.StructType([T.StructField(key, rows.schema[key].dataType), *fields.fields])
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            starts, ends = runs(keys)
            if len(starts):
                found = {key: keys.take(pa.array(starts)), **summary(batch, starts, ends)}
                yield pa.RecordBatch.from_arrays([found[n] for n in names], names=names)

    known = rows.filter(F.col(key).isNotNull())
    ranged = known.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    return ranged.mapInArrow(run, kind)


def in_order(segment: Column, at: str) -> Column:
    """The segments of a place as an array, in the order of their field ``at``. One place has few, for any number of rows."""

    def ahead(a: Column, b: Column) -> Column:
        return F.when(a[at] < b[at], F.lit(-1)).when(a[at] > b[at], F.lit(1)).otherwise(F.lit(0))

    return F.array_sort(F.collect_list(segment), ahead)


def first_place(entries: Column, test: Callable[[Column], Column]) -> Column:
    """The place, from 1, of the first entry that passes; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(entries, test), True), F.lit(0)).cast("int")
