"""The words of an Arrow column of texts as numbers, by numpy and Arrow's dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the given ranges, both ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    begin = 0
    while begin < len(texts):
        limit = (ends[begin - 1] if begin else 0) + size
        end = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
        yield begin, end
        begin = end


def coded_words(texts: pa.Array, inside: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each word in order, the distinct words by number, words of each text).

    A word is a longest run of bytes that ``inside`` marks, after each byte was put
    through ``fold``. It never goes on into the next text. Null is an empty text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    none = np.zeros(0, np.int64), [], np.zeros(len(texts), np.int64)
    if not len(texts):
        return none
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[-1] == at[0]:
        return none
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    raw = raw if fold is None else fold[raw]
    held = inside[raw]
    opens = held.copy()
    opens[1:] &= ~held[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    opens[heads] = held[heads]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none
    ends = np.cumsum(np.add.reduceat(held.view(np.uint8), starts, dtype=np.int64))
    offsets = np.concatenate([[0], ends])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[held])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), np.diff(np.searchsorted(starts, at))
