"""Simple-8b: runs of unsigned integers packed into 64-bit words.

The low four bits of a word are its selector, the other sixty hold as many values as the
selector says. Selector 15 is an escape: the next word is one raw 64-bit value. Values are
packed in blocks that start on a word of their own, so a reader can begin at any block.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8192
ESCAPE = 15
# Fixed values of the format: selector -> (values in a word, bits of each).
WIDTHS = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7),
    8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
_LIMITS = np.array([1 << bits for _, bits in WIDTHS.values()], np.uint64)
_NEED = np.array([bits for _, bits in WIDTHS.values()] + [64], np.int8)
_COUNT = np.array([0] + [n for n, _ in WIDTHS.values()] + [1])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    return _NEED[np.searchsorted(_LIMITS, values, side="right")]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block). Every word takes as many values as it can."""
    values = np.asarray(values, np.uint64)
    words, offsets, at = [], [], 0
    for first in range(0, len(values), block):
        part = _encode_block(values[first : first + block])
        offsets.append(at)
        at += len(part)
        words.append(part)
    return (np.concatenate(words) if words else np.empty(0, np.uint64)), np.array(offsets, np.int64)


def _encode_block(values: np.ndarray) -> np.ndarray:
    n = len(values)
    need = _bits(values)
    # Behind the end stand values of no width: the last word may be partly filled.
    padded = np.concatenate([need, np.zeros(64, np.int8)])
    span, widest = 1, {1: padded}
    while span < 32:
        widest[2 * span] = np.maximum(widest[span][: len(padded) - span], widest[span][span:])
        span *= 2
        widest[span] = np.concatenate([widest[span], np.zeros(len(padded) - len(widest[span]), np.int8)])
    selector = np.full(n, ESCAPE, np.int8)
    for s in sorted(WIDTHS, reverse=True):
        count, bits = WIDTHS[s]
        half = 1 << (count.bit_length() - 1)
        reach = np.maximum(widest[half][:n], widest[half][count - half : count - half + n])
        np.putmask(selector, reach <= bits, s)
    steps = _COUNT[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = selector[starts]
    wide = np.concatenate([values, np.zeros(64, np.uint64)])
    words = chosen.astype(np.uint64)
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        count, bits = WIDTHS[int(s)]
        which = np.flatnonzero(chosen == s)
        lanes = wide[starts[which][:, None] + np.arange(count)]
        words[which] |= np.bitwise_or.reduce(lanes << (np.arange(count) * bits + 4).astype(np.uint64), axis=1)
    raw = np.flatnonzero(chosen == ESCAPE)
    return np.insert(words, raw + 1, values[starts[raw]]) if len(raw) else words


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ``n`` values that ``encode`` packed, or those of blocks ``first`` to ``last`` - 1 alone."""
    last = len(offsets) if last is None else last
    ends = np.append(offsets, len(words))
    parts = [
        _decode_block(words[ends[b] : ends[b + 1]], min(block, n - b * block)) for b in range(first, last)
    ]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _decode_block(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words & np.uint64(15)).astype(np.int64)
    if (selector == ESCAPE).any():
        # A raw word may end in any bits: only a walk tells it from a packed one.
        heads, i = [], 0
        while i < len(words):
            heads.append(i)
            i += 2 if selector[i] == ESCAPE else 1
        heads = np.array(heads)
    else:
        heads = np.arange(len(words))
    chosen = selector[heads]
    counts = _COUNT[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + 64, np.uint64)
    for s in np.unique(chosen):
        which = chosen == s
        if s == ESCAPE:
            out[starts[which]] = words[heads[which] + 1]
            continue
        count, bits = WIDTHS[int(s)]
        shifts = (np.arange(count) * bits + 4).astype(np.uint64)
        lanes = (words[heads[which]][:, None] >> shifts) & np.uint64((1 << bits) - 1)
        out[starts[which][:, None] + np.arange(count)] = lanes
    return out[:n]
