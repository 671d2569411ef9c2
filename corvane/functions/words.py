"""Words of Arrow strings, cut in their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cut(texts: pa.Array, letters: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The longest runs of characters that ``letters`` (code point) marks, of all texts one after the other, encoded by distinct words; and how many each text has.

    Words are cut in the texts' UTF-8 bytes, without a string of each. A null text has no words.
    """
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), none), none, space)  # a space ends each text, and its last word
    ends = np.frombuffer(spaced.buffers()[1], np.int64)[: len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[: ends[-1]]
    inside = np.where(np.arange(256) < 128, letters[:256], False)[data]
    wide = np.flatnonzero(data >= 0xC0)  # first bytes of longer characters
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = wide[(data[wide] >= low) & (data[wide] < high)]
        point = (data[at] - low).astype(np.int32)
        for k in range(1, size):
            point = point << 6 | (data[at + k] & 63)
        at = at[letters[point]]
        for k in range(size):
            inside[at + k] = True
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts = edges[::2]
    places = np.concatenate([[0], np.cumsum(edges[1::2] - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[inside]))
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, ends))
