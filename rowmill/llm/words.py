"""Words of whole columns of texts at once: boundaries and hashes as arrays, no loop over rows or words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at a time (a longer text is a block of its own).
BLOCK_BYTES = 1 << 18
# Longer words get a keyed digest instead of the polynomial, which equal-valued long words could be built for.
LONG_WORD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# Word bytes after lowering: everything but space and the five ASCII control spaces.
BETWEEN_SPACES = np.ones(256, bool)
BETWEEN_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Word bytes after lowering: digits, letters and all that is not ASCII.
LETTERS_AND_DIGITS = np.zeros(256, bool)
LETTERS_AND_DIGITS[0x30:0x3A] = LETTERS_AND_DIGITS[0x61:0x7B] = LETTERS_AND_DIGITS[0x80:] = True

_FACTOR = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(kind: str, factor: int, n: int, of: type = np.uint64) -> np.ndarray:
    """The first ``n`` powers of a factor, in wrapping arithmetic; remembered under their kind."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), factor, of)
        steps[0] = 1
        _powers[kind] = have = np.cumprod(steps, dtype=of)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some consecutive rows: ``rows`` texts from ``row`` on."""

    row: int
    rows: int
    data: np.ndarray  # bytes, A-Z lowered
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    bounds: np.ndarray  # first word of each row, and the number of words

    @property
    def of(self) -> np.ndarray:
        """The row (counted from ``row``) of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return hashed(self.data, self.starts, self.ends)

    def text(self, first: int, last: int) -> str:
        """Words ``first`` to ``last - 1`` joined by spaces."""
        pairs = zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True)
        return b" ".join(self.data[a:b].tobytes() for a, b in pairs).decode("utf-8", "replace")


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    n = len(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers("up", _FACTOR, n), out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * powers("down", pow(_FACTOR, -1, 1 << 64), n)[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive hashes (over row ends too: see ``inside``)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    weights = powers("gram", 0xD6E8FEB86659FD93, n + 1)
    out = hashes[:m] * weights[1]
    for i in range(1, n):
        out += hashes[i : i + m] * weights[i + 1]
    return mix(out + np.uint64(n))


def inside(of: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from each word on are in one row."""
    m = max(0, len(of) - n + 1)
    return of[:m] == of[n - 1 : n - 1 + m]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return all_bytes[at[0] : at[-1]] if len(at) else all_bytes, at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``size`` bytes."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def words(texts: pa.Array, word_bytes: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """The words of a string array, block by block."""
    data, offsets = raw_bytes(texts)
    for first, last in blocks(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        yield cut(first, LOWER[part] if lower else part, at, word_bytes)


def cut(row: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Find words: runs of word bytes that do not cross a text's end."""
    n = len(data)
    inner = np.zeros(n + 2, bool)
    inner[1:-1] = word_bytes[data]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins = inner[1:] & ~inner[:-1]
    begins[cuts] |= inner[1:][cuts]
    stops = inner[:-1] & ~inner[1:]
    stops[cuts] |= inner[:-1][cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    bounds = np.searchsorted(starts, offsets)
    bounds[-1] = len(starts)
    return Words(row, len(offsets) - 1, data, starts, ends, bounds)
