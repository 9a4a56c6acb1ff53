"""Words of a whole Arrow batch as numpy arrays: bounds and 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes hashed at once
SLICE = 1 << 20  # bytes of documents handled together; a longer document is a slice of its own

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_code = np.arange(256)
# Digits, letters and every byte of a character beyond ASCII; the rest separates words.
WORD_CHARS = ((_code >= 48) & (_code <= 57)) | ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
NOT_SPACE = ~((_code == 32) | ((_code >= 9) & (_code <= 13)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes above which a word is hashed on its own: the polynomial modulo 2^64 can part short words only.
LONG_WORD = 128


def _long_hash(word: np.ndarray) -> int:
    return int.from_bytes(blake2b(LOWER[word].tobytes(), digest_size=8).digest(), "little")


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= CHUNK + 1:
            _powers[name] = have
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row comes alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(buf: np.ndarray, cuts: np.ndarray, is_word: np.ndarray, hashes: bool = True):
    """Starts, ends and hashes of the words of ``buf``, with A-Z lowered.

    ``cuts`` are the sorted offsets of documents, where a word ends in any case. The bytes are
    hashed in chunks cut between words, so that memory follows the number of words.
    """
    starts, ends, hashed = [], [], []
    n, pos = len(buf), 0
    while pos < n:
        size = CHUNK
        while True:
            end = min(n, pos + size)
            mask = is_word[buf[pos:end]]
            if end == n:
                break
            free = np.flatnonzero(~mask[-65536:])
            if len(free):
                end = max(end - 65536, pos) + int(free[-1]) + 1
                mask = mask[: end - pos]
                break
            size *= 2  # a word longer than the chunk
        edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = cuts[np.searchsorted(cuts, pos, "right") : np.searchsorted(cuts, end, "left")] - pos
        inner = np.unique(inner[mask[inner] & mask[inner - 1]]) if len(inner) else inner
        if len(inner):
            s, e = np.sort(np.concatenate((s, inner))), np.sort(np.concatenate((e, inner)))
        starts.append(s + pos)
        ends.append(e + pos)
        if hashes:
            m = end - pos
            value = (LOWER[buf[pos:end]].astype(np.uint64) + np.uint64(1)) * _power("p", _P, m)[:m]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
            value = mix((total[e] - total[s]) * _power("inv", _INV, m + 1)[s])
            for k in np.flatnonzero(e - s > LONG_WORD):
                value[k] = _long_hash(buf[pos + s[k] : pos + e[k]])
            hashed.append(value)
        pos = end
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(starts, np.int64), join(ends, np.int64), join(hashed, np.uint64)


def text_words(text: str | None, is_word: np.ndarray) -> list[bytes]:
    """The same words of one short text as bytes."""
    if not text:
        return []
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return np.where(is_word[raw], raw, np.uint8(32)).tobytes().split()


def hash_words(items: list[bytes]) -> np.ndarray:
    """Hashes of given words, equal to those of ``words``."""
    raw = np.frombuffer(b"\x00".join(items), np.uint8) if items else np.zeros(0, np.uint8)
    lengths = np.array([len(w) for w in items], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if not items:
        return np.zeros(0, np.uint64)
    value = (LOWER[raw].astype(np.uint64) + np.uint64(1)) * _power("p", _P, len(raw))[: len(raw)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    out = mix((total[ends] - total[starts]) * _power("inv", _INV, len(raw) + 1)[starts])
    for k in np.flatnonzero(lengths > LONG_WORD):
        out[k] = _long_hash(raw[starts[k] : ends[k]])
    return out
