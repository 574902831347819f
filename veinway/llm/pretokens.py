"""Byte-level BPE pre-tokens as array operations over code points.

The rule is that of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The code points that Unicode calls white space.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# The endings split off after an apostrophe, in the pattern's order.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for cp in range(sys.maxunicode + 1):
        if 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3:
            table[cp] = LETTER
        elif 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000:
            continue
        else:
            table[cp] = kind.get(unicodedata.category(chr(cp))[0], OTHER)
    table[WHITE] = SPACE
    return table


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of every pre-token of a chunk, and the offsets of pre-tokens per document (n + 1).

    The pre-tokens of a document tile its bytes. Documents must be valid UTF-8.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) == len(data):
        cp = data.astype(np.int32)
    else:
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    n = len(cp)
    kind = classes()[cp]
    head = np.zeros(n + 1, bool)  # first code point of a document, or the end
    head[np.searchsorted(lead, offsets)] = True
    nxt = np.empty(n, np.uint8)
    nxt[:-1] = kind[1:]
    nxt[-1] = SPACE
    nxt[head[1:]] = SPACE  # past the end of a document counts as space
    is_space = kind == SPACE
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= head[:-1]
    # a plain space right before another class opens that class's token
    joins = (cp == 32) & (nxt != SPACE)
    start = change.copy()
    after_join = np.zeros(n, bool)
    after_join[1:] = joins[:-1]
    after_join &= ~head[:-1]
    start[after_join] = False
    # the last white space before another class stands alone or joins
    start |= is_space & (nxt != SPACE)
    # an apostrophe that opens a run of others, has no joined space and comes before an ending
    quote = np.flatnonzero((cp == 39) & change & ~after_join)
    if len(quote):
        ends = np.concatenate((np.flatnonzero(head[1:]) + 1,))
        limit = ends[np.searchsorted(ends, quote, side="right")]
        taken = np.zeros(len(quote), bool)
        for ending in ENDINGS:
            fits = ~taken & (quote + len(ending) < limit)
            for j, c in enumerate(ending, 1):
                fits &= cp[np.minimum(quote + j, n - 1)] == ord(c)
            q = quote[fits]
            start[q + 1] = False
            after = q + 1 + len(ending)
            start[after[after < n]] = True
            taken |= fits
    at = np.flatnonzero(start)
    begin = lead[at]
    return begin, np.searchsorted(begin, offsets)
