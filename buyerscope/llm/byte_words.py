"""Words of many texts at once, cut from their UTF-8 bytes with numpy.

A word is a run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. All bytes of a non-ASCII character are
above 0x7F, so the rule can be read byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The same rule as a pattern, for texts that are already in lower case.
LOWER_WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
CHUNK_BYTES = 1 << 21  # bytes of text that are cut at a time

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_LOWER >= 128)


@dataclass
class Words:
    """Words of a piece of a batch: ``data[offsets[i]:offsets[i + 1]]`` is word i; ``rows[i]`` is its row of the batch.

    ``continues`` says that the piece goes on with the row in which the piece before it ended.
    """

    data: np.ndarray
    offsets: np.ndarray
    rows: np.ndarray
    continues: bool

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def array(self) -> pa.Array:
        """The words as an Arrow array of binary values."""
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.data)])


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words one after another, their offsets, and the number of words in each row ``data[bounds[i]:bounds[i + 1]]``."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A word ends with its row.
    begin, end = bounds[:-1][bounds[:-1] < len(data)], bounds[1:][bounds[1:] > 0] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    return _LOWER[data[inside]], offsets, np.diff(np.searchsorted(starts, bounds))


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the bounds of its rows; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _cut_points(data: np.ndarray, start: int, stop: int, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of one long row of about ``limit`` bytes that end between words."""
    while start < stop:
        end, step = min(start + limit, stop), limit
        while end < stop:
            free = np.flatnonzero(~_IN_WORD[data[max(start, end - step) : end]])
            if len(free):
                end = max(start, end - step) + int(free[-1]) + 1
                break
            end = min(end + step, stop)
        yield start, end
        start = end


def words_of(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of all rows, in pieces of about ``limit`` bytes; one word is never cut, a longer row comes in several pieces."""
    if not len(column):
        return
    data, bounds = _text_bytes(column)
    row = 0
    while row < len(column):
        until = max(int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1, row + 1)
        if bounds[until] - bounds[row] <= limit:
            found, offsets, counts = cut(data[bounds[row] : bounds[until]], bounds[row : until + 1] - bounds[row])
            yield Words(found, offsets, np.repeat(np.arange(row, until), counts), False)
        else:
            for start, stop in _cut_points(data, int(bounds[row]), int(bounds[until]), limit):
                found, offsets, counts = cut(data[start:stop], np.array([0, stop - start]))
                yield Words(found, offsets, np.full(counts[0], row), start > bounds[row])
        row = until
