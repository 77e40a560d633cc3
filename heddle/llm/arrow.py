"""Small helpers for functions that stream Arrow batches through Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what a function holds at once stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8.

    ``bytes`` methods lower-case ASCII letters only and split at just these
    six white-space bytes.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()
