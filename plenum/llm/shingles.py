r"""Word shingles of UTF-8 texts as sorted arrays of distinct 64-bit hashes, whole batches at a time.

Words are runs of bytes outside ``[\x20\x09-\x0D]`` after lower-casing A-Z.  A text with at least ``width``
words has the distinct runs of ``width`` words; a shorter one the whole sequence as one; without words, none.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A random number for each byte, after lower-casing.
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes that are hashed in one go; a longer text is cut at a blank.
SPAN = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SPAN)
        _POWERS[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))[:-1]]) for b in (_BASE, _BACK)
        ]
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; ``buf`` ends with a blank."""
    blank = (buf == 0x20) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, back = _powers(len(buf))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[buf] * up)])
    words = (total[ends] - total[starts]) * back[starts]
    return mix(words + (ends - starts).astype(np.uint64) * _PLACE[63]), starts


def _spans(joined: bytes):
    at = 0
    while at < len(joined):
        end = min(at + SPAN, len(joined))
        if end < len(joined):
            cut = max(joined.rfind(b, at, end) for b in (b" ", b"\n"))
            if cut < 0:  # a word longer than a span
                nxt = [k for k in (joined.find(b, end) for b in (b" ", b"\n")) if k >= 0]
                cut = min(nxt)
            end = cut + 1
        yield at, np.frombuffer(joined, np.uint8, end - at, at)
        at = end


def sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    joined = b"\n".join(texts) + b"\n"
    parts = [(w, s + at) for at, buf in _spans(joined) for w, s in [_span_words(buf)]]
    words = np.concatenate([p[0] for p in parts])
    starts = np.concatenate([p[1] for p in parts])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * _PLACE[k]
    full = mix(full)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(mix(np.array([short], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
