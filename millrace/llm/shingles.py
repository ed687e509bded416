"""Word shingles of Arrow text columns, hashed to 64 bits with numpy.

Words are runs of other bytes than blank and the control characters 9 to 13, with A-Z lower-cased. A text's set has
its distinct five-word shingles; a text with fewer words has its whole sequence as one; without words it is empty.
Two different shingles share a hash with a chance of 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Bytes of text hashed at once; a longer text is hashed alone, in segments of this size.
CHUNK_BYTES = 2 << 20

U64 = np.uint64
_MULTIPLIER, _STEP = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
_PLACE = mix(np.arange(1, SHINGLE_WORDS + 1, dtype=U64) * U64(_MULTIPLIER)) | U64(1)
_SHORT = mix(np.arange(1001, 1001 + SHINGLE_WORDS, dtype=U64) * U64(_STEP))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            self.up, self.down = (
                np.concatenate([np.ones(1, dtype=U64), np.cumprod(np.full(n - 1, base, dtype=U64))]) for base in (_MULTIPLIER, inverse)
            )
        return self.up, self.down


_POWERS = _Powers()


def _word_hashes(data: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = np.empty(len(starts), dtype=U64)
    done, at = 0, 0
    while done < len(starts):
        stop = int(np.searchsorted(ends, at + CHUNK_BYTES, side="right"))
        stop = max(stop, done + 1)
        begin, end = int(starts[done]), int(ends[stop - 1])
        up, down = _POWERS.first(end - begin + 1)
        sums = np.zeros(end - begin + 1, dtype=U64)
        np.cumsum(_BYTE_VALUE[data[begin:end]] * up[: end - begin], out=sums[1:])
        s, e = starts[done:stop] - begin, ends[done:stop] - begin
        hashes[done:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(_STEP))
        done, at = stop, end
    return hashes


def _sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' sets, and their members, sorted within each text."""
    texts, n = len(bounds) - 1, len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    padded = np.concatenate([[True], space, [True]])
    starts = np.flatnonzero(~space & (padded[:n] | edge[:n]))
    ends = np.flatnonzero(~space & (padded[2:] | edge[1:])) + 1
    words = _word_hashes(data, space, starts, ends)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    counts = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    n_shingles = max(0, len(words) - SHINGLE_WORDS + 1)
    hashed = np.zeros(n_shingles, dtype=U64)
    for i in range(SHINGLE_WORDS):
        hashed += words[i : i + n_shingles] * _PLACE[i]
    hashed = mix(hashed)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    whole = np.zeros(texts, dtype=U64)
    for i in range(SHINGLE_WORDS - 1):
        has = short[counts[short] > i]
        whole[has] += words[first[has] + i] * _PLACE[i]
    members, sizes = [], np.zeros(texts, dtype=np.int64)
    for text in range(texts):
        count = counts[text]
        if count >= SHINGLE_WORDS:
            own = np.sort(hashed[first[text] : first[text] + count - SHINGLE_WORDS + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:
            own = mix(whole[text : text + 1] + _SHORT[count])
        else:
            continue
        members.append(own)
        sizes[text] = len(own)
    return sizes, np.concatenate(members) if members else np.zeros(0, dtype=U64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the row of the first one, the sizes of their sets, and all members one after the other.

    The column must have no nulls.
    """
    texts = texts.cast(pa.large_string())
    _, places, content = texts.buffers()
    bounds = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, len(texts))
        yield row, *_sets(data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row])
        row = stop
