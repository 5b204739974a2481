"""Words and word shingles as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}
#: Bytes hashed at once; a longer text is cut at white space.
CHUNK = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes."""
    b = np.frombuffer(data, np.uint8)
    up, down = _powers(len(b) + 1)
    space = np.concatenate(([True], _SPACE[b], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_TABLE[b] * up[: len(b)], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z as a-z."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []

    def flush() -> None:
        if waiting:
            starts, hashes = _hash_words(b" ".join(waiting))
            at = np.searchsorted(starts, np.cumsum([0, *(len(w) + 1 for w in waiting)]))
            out.extend(hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
            waiting.clear()

    size = 0
    for text in texts:
        text = text.lower()
        if len(text) > CHUNK:
            flush()
            parts, at = [], 0
            while at < len(text):
                end = at + CHUNK
                while end < len(text) and not _SPACE[text[end]]:
                    end += 1
                parts.append(_hash_words(text[at:end])[1])
                at = end
            out.append(np.concatenate(parts))
            size = 0
            continue
        if size + len(text) > CHUNK:
            flush()
            size = 0
        waiting.append(text)
        size += len(text) + 1
    flush()
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than ``width`` are one shingle, none gives none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(width, n)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = mixed(h + words[k : n - size + 1 + k] + np.uint64(k + 1 + 64 * size))
    return np.unique(h)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    for words in word_hashes([(t or "").encode() for t in texts]):
        yield shingle_set(words, width)
