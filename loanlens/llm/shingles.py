"""Sets of hashed word shingles of whole Arrow batches, in NumPy.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A set
holds the distinct five-word shingles, or the whole sequence if there are fewer words.
Shingles are known by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are hashed at once; a longer text stands alone.
CHUNK = 500_000

_U = np.uint64
_RANDOM = np.random.RandomState(20_240_601)
_BYTE = _RANDOM.randint(1, 2**63, size=256, dtype=np.int64).astype(_U)
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def folded(values: np.ndarray) -> np.ndarray:
    """One hash of each row's values, in their order."""
    out = np.full(len(values), values.shape[1], dtype=_U)
    for k in range(values.shape[1]):
        out = mixed(out * _STEP + values[:, k])
    return out


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _word_hashes(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text (with the end)."""
    lower = text + ((text >= 65) & (text <= 90)).astype(np.uint8) * np.uint8(32)
    space = (lower == 32) | ((lower >= 9) & (lower <= 13))
    first = np.zeros(len(lower) + 1, dtype=bool)
    first[offsets] = True
    begins = ~space
    begins[1:] &= space[:-1] | first[1:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.append(at, len(lower)))
    place = np.arange(at[0], len(lower)) - np.repeat(at, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _STEP | _U(1), dtype=_U))
    terms = _BYTE[lower[at[0] :]] * powers[place]
    terms[space[at[0] :]] = 0
    return mixed(np.add.reduceat(terms, at)), np.searchsorted(at, offsets)


def _chunk_sets(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, starts = _word_hashes(text, offsets)
    counts = np.diff(starts)
    n = max(len(words) - WIDTH + 1, 0)
    hashes = folded(np.lib.stride_tricks.sliding_window_view(words, WIDTH)) if n else np.zeros(0, _U)
    sets = []
    for begin, count in zip(starts[:-1].tolist(), counts.tolist()):
        if count >= WIDTH:
            own = np.sort(hashes[begin : begin + count - WIDTH + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif count:
            sets.append(folded(words[None, begin : begin + count]))
        else:
            sets.append(np.zeros(0, _U))
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.array([len(s) for s in sets], np.int64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, sorted distinct hashes of all, set sizes."""
    text, offsets = _text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        piece = offsets[first : last + 1]
        hashes, sizes = _chunk_sets(text[piece[0] : piece[-1]], piece - piece[0])
        yield first, hashes, sizes
        first = last


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number that two sets share if they are equal; of empty sets, that of size 0."""
    ends = np.cumsum(sizes)
    total = np.append(_U(0), np.cumsum(mixed(hashes ^ _STEP), dtype=_U))
    other = np.append(_U(0), np.cumsum(mixed(hashes + _STEP), dtype=_U))
    sums = np.stack([x[ends] - x[ends - sizes] for x in (total, other)] + [sizes.astype(_U)], axis=1)
    return folded(sums)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set, the parity of the number of its members in each of its bits.

    Two sets differ in at least as many members as their sketches differ in bits. A set
    has as many bits as members at least, in powers of two.
    """
    out, ends = [], np.cumsum(sizes)
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        bits = max(64, 1 << max(0, end - begin - 1).bit_length())
        own = (hashes[begin:end] & _U(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(own, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter."""
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    low = 8 * min(len(a), len(b))
    while bits > low:
        bits //= 2
        mask = (1 << bits) - 1
        if len(a) > len(b):
            x = (x >> bits) ^ (x & mask)
        else:
            y = (y >> bits) ^ (y & mask)
    return (x ^ y).bit_count()
