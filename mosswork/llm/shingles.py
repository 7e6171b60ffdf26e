"""Word shingles of text batches in numpy, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_words: dict[str, int] = {}


def word_hashes(words: list[str], most: int = 700_000) -> np.ndarray:
    """64-bit hashes; remembered by the worker process, up to `most` words."""
    try:
        got = [_words[w] for w in words]
    except KeyError:
        if len(_words) > most:
            _words.clear()
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        got = [_words[w] for w in words]
    return np.array(got, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles: words are cut at white space, case goes. A text
    of fewer words is one shingle; one without words has none."""
    words = [t.lower().split() for t in texts]
    hashed = word_hashes([w for ws in words for w in ws])
    out, at = [], 0
    chained = hashed[: max(0, len(hashed) - n + 1)].copy() if len(hashed) >= n else hashed[:0]
    for k in range(1, n):
        chained = chained * _MIX[0] + hashed[k : k + len(chained)] if len(chained) else chained
    chained = mixed(chained)
    for ws in words:
        if len(ws) >= n:
            out.append(np.unique(chained[at : at + len(ws) - n + 1]))
        elif ws:
            out.append(np.array([xxhash.xxh3_64_intdigest("\n".join(ws))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(ws)
    return out


class MinHash:
    def __init__(self, size: int, seed: int = 7):
        draw = np.random.RandomState(seed)
        self.a = draw.randint(0, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.randint(0, 2**63, size, np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of `size` 32-bit minima for each set; sets are not empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, i] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
        return out
