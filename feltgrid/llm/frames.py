"""Arrow and row helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 24 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` cut where the bytes of column ``text`` pass ``limit``; one row is never cut."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        start = total = 0
        for i, n in enumerate(sizes.to_pylist()):
            if total and total + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The values of a text column, null as the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_ids(ids: Column) -> Column:
    """Ids as texts, distinct, in text order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(ids, lambda x: x.cast("string")))), ",")
