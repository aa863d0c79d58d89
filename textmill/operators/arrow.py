"""Arrow batches in parts of bounded size, so that what a map holds does not grow with the length of its rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text, or values of lists, in a part.
PART = 1 << 21


def offsets(col: pa.Array) -> np.ndarray:
    """Where the rows of a column of strings or lists begin and end in its values."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_list(col.type)
    kind, n = np.int64 if wide else np.int32, len(col)
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)


def parts(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole rows with about limit bytes (of lists: values) in a column; a longer row comes alone."""
    for batch in batches:
        at, lo = offsets(batch.column(column)), 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts one after another, and the bounds of its rows among them; a null one is empty."""
    col = col.fill_null("") if col.null_count else col
    at, raw = offsets(col), col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists one after another, and the bounds of its rows among them; a null one is empty."""
    col = col.fill_null([]) if col.null_count else col
    at = offsets(col)
    return col.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def lists(flat: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """A column of lists of numbers from their values and bounds."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))


def gathered(pool: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of pool one after another, and their bounds."""
    stop = np.cumsum(length)
    n = int(stop[-1]) if len(stop) else 0
    return pool[np.repeat(first - (stop - length), length) + np.arange(n)], np.concatenate([[0], stop])
