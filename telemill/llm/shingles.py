"""Word shingles as hashes, for many texts at once with numpy.

Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased; a shingle is five words.
A text of one to four words is one shingle of all of them; a text without words has none.
Word hashes are differences of prefix sums, so the work per byte is a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join([*raws, b""]), np.uint8)
    ends_at = np.cumsum([len(r) + 1 for r in raws])
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.cumprod(np.full(len(data), _BASE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * place)])
    back = np.cumprod(np.full(len(data) + 1, _BASE_INV, np.uint64))
    hashes = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, ends_at), prepend=0)
    return hashes, counts


def shingle_runs(texts: list[str]) -> list[np.ndarray]:
    """Of each text its shingle hashes in order, repeats kept; none where there are fewer than five words."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(0, len(hashes) - WORDS + 1)
    runs = mix(sum(hashes[k : k + n] * _MULT[k] for k in range(WORDS))) if n else hashes[:0]
    return [runs[e - c : max(e - WORDS + 1, e - c)] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Of each text the sorted distinct shingle hashes."""
    hashes, counts = word_hashes(texts)
    if len(hashes) >= WORDS:
        n = len(hashes) - WORDS + 1
        runs = mix(sum(hashes[k : k + n] * _MULT[k] for k in range(WORDS)))
    out, at = [], 0
    for count in counts.tolist():
        if count >= WORDS:
            out.append(np.unique(runs[at : at + count - WORDS + 1]))
        elif count:
            out.append(mix((hashes[at : at + count] * _MULT[:count]).sum(dtype=np.uint64)[None] + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
