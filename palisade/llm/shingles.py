"""Word shingles and minwise signatures of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from .common import LOWER

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, base)]))


_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)
_PLACES = np.array([pow(int(_BASE), 7 * (i + 1), 1 << 64) | 1 for i in range(16)], dtype=_U)


def word_hashes(texts: list[str | None], tails: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of all texts in order, and the words' offsets by text (one more than texts).

    tails: also the last two bytes of each word, as one number.
    """
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    joined = b" " + b" ".join(data) + b" "
    raw = np.frombuffer(joined.translate(LOWER), dtype=np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    at = np.cumsum([0, *(len(d) + 1 for d in data)])
    offsets = np.searchsorted(starts, at)
    # a word's polynomial hash from running sums, moved to place 0 by the inverse power
    lengths = ends - starts
    h = np.zeros(len(starts), dtype=_U)
    if len(starts):
        step = len(_UP)  # powers are taken in stretches, so that their tables stay small
        up, down = _UP, _DOWN
        first = 0
        while first < len(starts):
            begin = starts[first]
            last = max(int(np.searchsorted(ends, begin + step, side="right")), first + 1)
            stop = ends[last - 1]
            if stop - begin > len(up):
                up, down = _powers(_BASE, int(stop - begin)), _powers(_INVERSE, int(stop - begin))
            sums = np.concatenate([[_U(0)], np.cumsum((raw[begin:stop].astype(_U) + _U(1)) * up[: stop - begin])])
            s, e = starts[first:last] - begin, ends[first:last] - begin
            h[first:last] = (sums[e] - sums[s]) * down[s]
            first = last
    hashes = _mix(h + lengths.astype(_U) * _BASE)
    if tails:
        return hashes, offsets, raw[ends - 1].astype(np.int64) * 256 + np.where(lengths > 1, raw[ends - 2], 0)
    return hashes, offsets


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; one with fewer words has its whole sequence as one."""
    hashes, offsets = word_hashes(texts)
    n = len(hashes) - k + 1
    runs = np.zeros(max(n, 0), dtype=_U)
    for i in range(k):
        if n > 0:
            runs += hashes[i : i + n] * _PLACES[i]
    runs = _mix(runs)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(_mix(np.array([np.sum(hashes[a:b] * _PLACES[: b - a]) + _U(b - a)], dtype=_U)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def set_digest(values: np.ndarray) -> bytes:
    """16 bytes that two sets share only if they are equal (but for a chance of 2**-128)."""
    import hashlib

    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


class Signer:
    """Signatures of `symbols` minwise hashes of `bits` bits each."""

    def __init__(self, symbols: int, bits: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, symbols, dtype=np.uint32) | np.uint32(1)
        self.mask = _U((1 << bits) - 1)

    def sign(self, values: np.ndarray) -> np.ndarray:
        x = (values >> _U(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            least = np.minimum(least, (part[None, :] * self.a[:, None]).min(axis=1))
        return _mix(least.astype(_U) + self.a.astype(_U)) & self.mask
