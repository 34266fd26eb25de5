"""How many rows of text become Python objects at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ``rows`` rows, without a copy.

    Spark bounds a batch by bytes and by 10,000 rows, which is meant for numbers: that many documents, as
    Python strings and words, may fill a worker's memory. An empty batch gives no slice.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
