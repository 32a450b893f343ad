"""Interpolated character n-gram models in hashed tables.

Orders 1 to ``ORDERS`` are interpolated after Witten and Bell. The tables hold
them in back-off form: the finished log probability of every gram seen, and
the weight that a context gives to what it hasn't seen, so that a text is
scored by a few look-ups a character and an unseen gram costs what the shorter
ones say.
"""

from __future__ import annotations

import zlib

import numpy as np

ORDERS = 5
#: Shortest gram that tells for a model in a ratio.
KNOWN = 4
#: Log probability of a character never seen at all.
FLOOR = float(np.log(1e-4))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, each after ORDERS - 1 opening marks and before a closing one; where each text begins, and the end)."""
    padded = ["\x02" * (ORDERS - 1) + t + "\x03" for t in texts]
    x = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return x, np.cumsum([0] + [len(t) for t in padded])


def grams(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of the ``n`` characters that end at each place."""
    h = np.full(len(x), n, np.uint64)
    for k in range(n - 1, -1, -1):
        if k:
            y = np.zeros(len(x), np.uint64)
            y[k:] = x[:-k]
        else:
            y = x
        h = (h ^ y) * _MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def before(h: np.ndarray) -> np.ndarray:
    """The values of the place before each."""
    return np.concatenate((h[:1], h[:-1]))


def real(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place of codes() is a character or a closing mark."""
    out = np.ones(len(x), bool)
    for k in range(ORDERS - 1):
        out[at[:-1] + k] = False
    return out


_CHAR, _LAST = 21, (1 << 21) - 1


def tally(x: np.ndarray, at: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, count) of each gram of ORDERS characters: two numbers that spell it, and how often it occurs; they tell all that Model() needs of the texts."""
    ends = np.flatnonzero(real(x, at))
    a, b, c, d, e = (x[ends - k].astype(np.int64) for k in range(ORDERS - 1, -1, -1))
    n = np.ones(len(ends), np.int64) if weights is None else np.repeat(weights, np.diff(at))[ends]
    return merged(a << _CHAR | b, c << 2 * _CHAR | d << _CHAR | e, n)


def merged(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of tally(), one for each gram."""
    if not len(high):
        return high, low, n
    by = np.lexsort((low, high))
    high, low = high[by], low[by]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    return high[first], low[first], np.add.reduceat(n[by], first)


class Model:
    """Log probabilities of characters after up to ORDERS - 1 others."""

    def __init__(self, texts: list[str], bits: int = 20, weights: np.ndarray | None = None):
        """weights: how often each text counts (once by default)."""
        x, at = codes(texts)
        self._fit(x, real(x, at), np.repeat(weights if weights is not None else np.ones(len(texts)), np.diff(at)), bits)

    @classmethod
    def of(cls, counted: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int = 20) -> Model:
        """The model of all texts whose grams tally() has counted, in any number of pieces."""
        out, (high, low, n) = cls.__new__(cls), counted
        x = np.stack([high >> _CHAR, high & _LAST, low >> 2 * _CHAR, low >> _CHAR & _LAST, low & _LAST], axis=1).astype(np.uint64).ravel()
        out._fit(x, np.arange(len(x)) % ORDERS == ORDERS - 1, np.repeat(n.astype(np.float64), ORDERS), bits)
        return out

    def _fit(self, x: np.ndarray, real: np.ndarray, w: np.ndarray, bits: int) -> None:
        self.bits, size = bits, 1 << bits
        w = w[real]
        self.seen, self.left = [], []
        lower = np.full(int(real.sum()), np.exp(FLOOR))
        for n in range(1, ORDERS + 1):
            g = grams(x, n, bits)[real]
            c = before(grams(x, n - 1, bits))[real] if n > 1 else np.zeros(len(g), np.int64)
            count, total = np.bincount(g, w, size), np.bincount(c, w, size)
            kinds = np.bincount(np.unique(c * size + g) // size, minlength=size)
            p = (count[g] + kinds[c] * lower) / (total[c] + kinds[c])
            seen = np.full(size, np.nan, np.float32)
            seen[g] = np.log(p)
            with np.errstate(divide="ignore", invalid="ignore"):
                left = np.where(total > 0, np.log(kinds / (total + kinds)), 0.0).astype(np.float32)
            self.seen.append(seen), self.left.append(left)
            lower = p

    def __getstate__(self):
        """Half precision, packed, on the way to the workers: most of a table is unseen."""
        return {"bits": self.bits} | {k: [zlib.compress(t.astype(np.float16).tobytes(), 1) for t in getattr(self, k)] for k in ("seen", "left")}

    def __setstate__(self, state):
        self.bits = state["bits"]
        self.seen, self.left = ([np.frombuffer(zlib.decompress(t), np.float16).astype(np.float32) for t in state[k]] for k in ("seen", "left"))

    def log(self, hashed: list[np.ndarray]) -> np.ndarray:
        """Log probability of each character; ``hashed`` is of all_grams(), in this model's bits."""
        out = np.full(len(hashed[0]), FLOOR + self.left[0][0], np.float32)
        for n in range(1, ORDERS + 1):
            s = self.seen[n - 1][hashed[n]]
            if n > 1:
                out += self.left[n - 1][before(hashed[n - 1])]
            np.copyto(out, s, where=s == s)
        return out

    def ratio(self, hashed: list[np.ndarray], other: np.ndarray, share: float) -> np.ndarray:
        """Log ratio of each character: this model, mixed with the other by ``share``, against the other (of log()).

        A gram of KNOWN characters that this model hasn't seen speaks for
        nothing: its ratio is 0 at most.
        """
        r = self.log(hashed)
        r -= other
        np.exp(np.minimum(r, 60, out=r), out=r)
        r *= np.float32(share)
        r += np.float32(1 - share)
        np.log(r, out=r)
        return np.where(np.isnan(self.seen[KNOWN - 1][hashed[KNOWN]]), np.minimum(r, 0), r)


def all_grams(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """grams() of the orders 0 to ORDERS."""
    return [grams(x, n, bits) if n else np.zeros(len(x), np.int64) for n in range(ORDERS + 1)]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, its opening marks left out."""
    cum = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return cum[at[1:]] - cum[at[:-1] + ORDERS - 1]
