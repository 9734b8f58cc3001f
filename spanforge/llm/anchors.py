"""Content-defined anchors for exact long-match search (numpy kernel).

Two equal windows of ``window`` elements hold equal seeds (``seed`` elements
each) at equal places, so the leftmost smallest seed hash lies at the same
offset in both.  That place is the window's *anchor*.  Neighbouring windows
mostly share an anchor, hence one row (anchor, first start, last start) stands
for a whole run of windows: about ``2 / (window - seed + 2)`` rows an element
instead of one.

The row's ``key`` is a 64-bit hash of the seed at the anchor, equal for all equal
windows.  What the run's windows cover (its *stretch*) is digested by the caller
from the bytes themselves, with a hash of another family.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_IDX_BITS = 22  # elements of a chunk; the rest of a packed word is hash
CHUNK = 1 << 20


def _odd_constants(count: int, state: int) -> list[np.uint64]:
    """A fixed stream of odd multipliers (splitmix64 from ``state``)."""
    out = []
    for _ in range(count):
        state = (state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append(U((z ^ (z >> 31)) | 1))
    return out


_C = _odd_constants(40, 1)
_BYTE = np.array(_odd_constants(256, 77), dtype=U)


def byte_elements(data: bytes) -> np.ndarray:
    """One 64-bit value per byte."""
    return _BYTE[np.frombuffer(data, dtype=np.uint8)]


def _mix(x: np.ndarray, c: np.uint64) -> np.ndarray:
    y = x >> U(29)
    y ^= x
    y *= c
    return y


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def block_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``values[i:i+width]`` for each i (ends hold partial garbage)."""
    h, size, level = _mix(values, _C[0]), 1, 1
    while size * 2 <= width:
        left = _mix(h, _C[level])
        left[: max(len(h) - size, 0)] += h[size:]
        h, size, level = left, size * 2, level + 1
    if size < width:
        gap = width - size
        left = _mix(h, _C[level + 1])
        left[: max(len(h) - gap, 0)] += h[gap:]
        h = left
    return _mix(h, _C[20])


def _window_min(packed: np.ndarray, width: int) -> np.ndarray:
    m, size = packed, 1
    while size * 2 <= width:
        nxt = m.copy()
        if len(m) > size:
            np.minimum(m[:-size], m[size:], out=nxt[:-size])
        m, size = nxt, size * 2
    if size < width:
        gap = width - size
        nxt = m.copy()
        if len(m) > gap:
            np.minimum(m[:-gap], m[gap:], out=nxt[:-gap])
        m = nxt
    return m


@dataclass(frozen=True)
class Geometry:
    """Window and seed length in elements."""

    window: int
    seed: int

    @property
    def reach(self) -> int:
        return self.window - self.seed + 1


#: 400-byte windows with 128-byte seeds, and 20-word windows with 5-word seeds.
BYTES_400 = Geometry(400, 128)
WORDS_20 = Geometry(20, 5)
MOST = 4000


def geometry(window: int, words: bool) -> Geometry:
    """A geometry for a window length (in bytes or words) of at most ``MOST``."""
    if not 0 < window <= MOST:
        raise ValueError(f"windows have 1 to {MOST} elements")
    for known in (BYTES_400, WORDS_20):
        if known.window == window and words == (known is WORDS_20):
            return known
    return Geometry(window, max(1, window // 4 if words else window // 3))


def find(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, geo: Geometry) -> dict[str, np.ndarray]:
    """Anchor rows of the sequences ``values[starts[i]:starts[i]+lengths[i]]``.

    Returns arrays ``seq`` (index of the sequence), ``pos`` (anchor), ``lo`` and
    ``hi`` (first and last window start, inclusive; all relative to the
    sequence) and ``key``.
    """
    n = len(values)
    if n >= 1 << _IDX_BITS:
        raise ValueError("chunk too long")
    counts = np.maximum(lengths - geo.window + 1, 0)
    total = int(counts.sum())
    empty = {k: np.zeros(0, np.int64) for k in ("seq", "pos", "lo", "hi", "key")}
    if not total:
        return empty
    seq = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    s = np.arange(total) - first[seq] + starts[seq]
    seeds = block_hashes(values, geo.seed)
    packed = ((seeds >> U(_IDX_BITS)) << U(_IDX_BITS)) | np.arange(n, dtype=U)
    owner = (_window_min(packed, geo.reach)[s] & U((1 << _IDX_BITS) - 1)).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (seq[1:] != seq[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], total) - 1
    lo, hi, pos, seq = s[at], s[last], owner[at], seq[at]
    base = starts[seq]
    return {"seq": seq, "pos": pos - base, "lo": lo - base, "hi": hi - base, "key": seeds[pos].view(np.int64)}


def chunks(lengths: list[int], geo: Geometry, limit: int = CHUNK):
    """Lists of (sequence, from, to): parts of about ``limit`` elements; longer
    sequences are cut with an overlap, so that each window start is in one part."""
    part, size = [], 0
    for i, n in enumerate(lengths):
        a = 0
        while True:
            b = min(n, a + limit)
            if part and size + b - a > limit:
                yield part
                part, size = [], 0
            part.append((i, a, b))
            size += b - a
            if b == n:
                break
            a = b - geo.window + 1
    if part:
        yield part
