"""Words of many texts as 64-bit hashes, in whole arrays.

Texts are joined and cut into blocks at white space, so memory is bounded by the
block (or one longer word) however long a text is. Hashes depend on the bytes of
the word alone and are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 2 << 20
SPACE_BYTES = [9, 10, 11, 12, 13, 32]
_GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed random 64-bit numbers."""
    at = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mixed(at * np.uint64(_GOLDEN))


class WordHasher:
    def __init__(self, seed: int = 1):
        self.byte = numbers(256, seed)
        self.factor = int(numbers(1, seed + 1000)[0]) | 1
        self.powers = self._powers(256)
        self.space = np.zeros(256, dtype=bool)
        self.space[SPACE_BYTES] = True

    def _powers(self, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate((
            np.ones(1, np.uint64), np.full(n - 1, self.factor, np.uint64))))

    def of_bytes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words of ``data``."""
        raw = np.frombuffer(data, np.uint8)
        inside = ~self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        sizes = ends - starts
        if sizes.max() > len(self.powers):
            self.powers = self._powers(int(sizes.max()) * 2)
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        terms = self.byte[raw[inside]] * self.powers[place]
        return mixed(np.add.reduceat(terms, first)), starts, ends

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, text after text, and the number of words of each."""
        hashes, counts = [], np.zeros(len(texts), np.int64)
        for first, group in _blocks(texts):
            joined = b" ".join(group)
            bounds = np.cumsum([len(t) + 1 for t in group])
            for low, high in _cuts(joined):
                h, starts, _ = self.of_bytes(joined[low:high])
                hashes.append(h)
                owner = np.searchsorted(bounds, starts + low, side="right")
                counts[first:first + len(group)] += np.bincount(owner, minlength=len(group))[
                    :len(group)]
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text) + 1
        if size >= BLOCK_BYTES:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of parts of about a block, cut after a space byte."""
    low = 0
    while low < len(data):
        high = low + BLOCK_BYTES
        if high >= len(data):
            high = len(data)
        else:
            places = [p for p in (data.find(s, high) for s in (b" ", b"\n", b"\t", b"\r")) if p >= 0]
            high = min(places) + 1 if places else len(data)
        yield low, high
        low = high


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of texts, empty for missing ones."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within each text, and the number of runs of each.

    A text with fewer words, but at least one, is one run of all its words.
    """
    n_runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not len(hashes):
        return np.zeros(0, np.uint64), n_runs
    padded = np.concatenate((hashes, np.zeros(size - 1, np.uint64)))
    factors = numbers(size, 77) | np.uint64(1)
    first = np.cumsum(counts) - counts
    run_first = np.cumsum(n_runs) - n_runs
    at = np.repeat(first - run_first, n_runs) + np.arange(int(n_runs.sum()))
    out = np.zeros(len(at), np.uint64)
    left = np.repeat(np.minimum(counts, size), n_runs)
    for j in range(size):
        part = mixed(padded[at + j]) * factors[j]
        out += np.where(j < left, part, np.uint64(0))
    return mixed(out), n_runs
