"""Linear support vector machines and n-gram features of bytes, vectorised over many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of texts whose features are in memory at once.
CHUNK = 1 << 20


Sparse = tuple[np.ndarray, np.ndarray]


def svm(rows: list[Sparse], y: np.ndarray, size: int, cost: float = 100.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent (Hsieh et al., 2008).

    rows are (indices, values) of features; y is 1 or -1.
    """
    rng = np.random.default_rng(seed)
    weights, alpha = np.zeros(size), np.zeros(len(y))
    diagonal = [float(v @ v) + 0.5 / cost for _, v in rows]
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            at, values = rows[i]
            slope = y[i] * float(values @ weights[at]) - 1 + alpha[i] * 0.5 / cost
            if alpha[i] == 0 and slope >= 0:
                continue
            new = max(alpha[i] - slope / diagonal[i], 0.0)
            worst = max(worst, abs(new - alpha[i]) * diagonal[i])
            weights[at] += (new - alpha[i]) * y[i] * values
            alpha[i] = new
        if worst < 1e-3:
            break
    return weights


#: ASCII bytes that are no letters count as blanks, capital letters as small ones; bytes of other characters stay.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.int64)


class Grams:
    """Hashed two- and three-byte sequences; a run of blanks counts once."""

    def __init__(self, bits: int = 13):
        self.mask, self.half = (1 << bits) - 1, 1 << bits
        self.size = 2 * self.half

    def codes(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For stretches of the text, which bound memory: of each position, between blanks, its two-byte and its three-byte feature.

        The last two bytes of a stretch begin the next, so that the features are those of the whole text wherever it is cut.
        """
        kept = np.full(1, 32)
        for start in range(0, len(data) + 1, CHUNK):
            piece = _FOLD[np.frombuffer(data[start : start + CHUNK] + (b"  " if start + CHUNK > len(data) else b""), np.uint8)]
            f = np.concatenate([kept, piece])
            keep = np.ones(len(f), bool)
            keep[1:] = (f[1:] != 32) | (f[:-1] != 32)
            f = f[keep]
            if len(f) >= 3:
                two = (f[:-2] * 31 + f[1:-1] * 1009) & self.mask
                three = ((f[:-2] * 7919 + f[1:-1] * 104729 + f[2:] * 1299709) >> 3) & self.mask
                yield two, three + self.half
            kept = f[-2:]

    def vector(self, data: bytes) -> np.ndarray:
        """Frequencies of the features in a whole text."""
        counts, n = np.zeros(self.size), 0
        for two, three in self.codes(data):
            counts += np.bincount(two, minlength=self.size) + np.bincount(three, minlength=self.size)
            n += len(two)
        return counts / max(1, n)

    def margins(self, data: bytes, weights: np.ndarray) -> np.ndarray:
        """weights (features by classifiers) times the frequencies."""
        total, n = np.zeros(weights.shape[1]), 0
        for two, three in self.codes(data):
            total += (np.take(weights, two, axis=0) + np.take(weights, three, axis=0)).sum(axis=0, dtype=np.float64)
            n += len(two)
        return total / max(1, n)
