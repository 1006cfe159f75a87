"""Word shingles of whole texts as 64-bit hashes, over whole arrays.

Words are runs of letters and digits of the text in lower case. A shingle is five words in a row; a text of one to
four words has one shingle, of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from .byte_bpe import LETTER, NUMBER, classes
from .textcore import Packed, mix

WORDS = 5
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(pack: Packed, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles in order, number of shingles of each text). The texts are in lower case."""
    kind = classes()[pack.cps]
    starts, ends = pack.runs((kind == LETTER) | (kind == NUMBER))
    hashes, counts = pack.span_hash(starts, ends), pack.counts(starts)
    if not len(hashes):
        return hashes, np.zeros(len(counts), np.int64)
    begin = np.cumsum(counts) - counts
    size = np.minimum(counts, words)
    made = np.where(counts > 0, counts - size + 1, 0)
    of = np.repeat(np.arange(len(counts)), made)
    at = begin[of] + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = k < size[of]
        out = np.where(inside, out * _STEP + hashes[np.minimum(at + k, len(hashes) - 1)], out)
    return mix(out + size[of].astype(np.uint64)), made
