"""Batches of word lists in slices that are bounded by their words, whatever the length of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts and words of a slice; a text with more words is a slice of its own.
ROWS, WORDS = 2_000, 1_000_000


def sliced(batch: pa.RecordBatch, lists: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order; lists: the number of the column of word lists."""
    bounds = batch.column(lists).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[at] + WORDS, side="right")) - 1
        end = max(at + 1, min(end, at + ROWS, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end
