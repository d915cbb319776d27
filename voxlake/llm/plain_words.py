"""Lower-cased words of letters and digits, as arrays over a batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import UPPER, text_bytes

#: Bytes of words, after A-Z are lower-cased: 0-9, a-z and all that isn't ASCII.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, where each word starts and ends in them, and each text's number of words."""
    flat, text_ends = text_bytes(texts)
    if not len(flat):
        return flat, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    flat = UPPER[flat]
    inside = np.append(IN_WORD[flat], False)
    fresh = np.append(True, ~inside[:-1])  # a word may begin here: after another byte, or where a text begins
    fresh[text_ends[text_ends < len(fresh)]] = True
    starts = np.flatnonzero(inside & fresh)
    ends = np.flatnonzero(inside[:-1] & (fresh[1:] | ~inside[1:])) + 1
    return flat, starts, ends, np.diff(np.searchsorted(starts, text_ends), prepend=0)
