"""Words of a text as arrays of 64-bit hashes, and sliding windows over them."""

from __future__ import annotations

from itertools import accumulate

import numpy as np

#: Fixed values of the SplitMix64 finaliser and a 64-bit odd multiplier.
_A, _B, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
MOST = 300_000


class Hashes(dict):
    """XXH64 of words, kept while there are at most MOST."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: ASCII white space; bytes of text that are hashed at a time.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
HELD = 1 << 22


def hashed(texts, powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word between ASCII white space, words of each text) of an Arrow array of strings; nulls have none."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    word, edge = ~_SPACE[raw], np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    after[-1:], after[:-1] = False, word[1:]
    first = np.flatnonzero(word & (~before | edge[:-1]))
    last = np.flatnonzero(word & (~after | edge[1:])) + 1
    out, i = np.zeros(len(first), np.uint64), 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + HELD, "right")))
        base = first[i]
        out[i:j] = mix(powers.hashes(raw[base : last[j - 1]], first[i:j] - base, last[i:j] - base))
        i = j
    return out, np.diff(np.searchsorted(first, at))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position that has as many after it."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + words[j : j + n]
    return mix(h)


def sliding(x: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Least (or most) of every w consecutive values."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= w:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[:n], x[w - span : w - span + n])


def owners(lengths: list[int] | np.ndarray) -> np.ndarray:
    """The index of the text that each word of the concatenated texts is from."""
    return np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def inside(owner: np.ndarray, size: int) -> np.ndarray:
    """True where `size` words from the position on are of one text."""
    n = len(owner) - size + 1
    return owner[:n] == owner[size - 1 :] if n > 0 else np.zeros(0, bool)


def winnow(hashes: np.ndarray, valid: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing over the windows of w hashes that are valid.

    Returns each window's minimum, and a mask of the hashes that are the
    minimum of a valid window (all of them, where several are equal).
    """
    low = sliding(hashes, w)
    known = np.where(valid[: len(low)], low, np.uint64(0))
    ends = np.zeros(w - 1, np.uint64)
    high = sliding(np.concatenate([ends, known, ends]), w, np.maximum) if len(low) else hashes[:0]
    picked = np.zeros(len(hashes), bool)
    picked[: len(high)] = (high == hashes[: len(high)]) & (high > 0)
    return low, picked


def starts(lengths) -> list[int]:
    return [0, *accumulate(lengths)]
