"""Words of whole texts as arrays: code points, word bounds and 64-bit word hashes of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters that end a word: space, and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_RUN = 1 << 16


def splitmix(x: np.ndarray) -> np.ndarray:
    """A well mixing bijection of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SEP = np.zeros(128, bool)
_SEP[list(SEPARATORS)] = True
_CODE = splitmix(np.arange(0x10000, dtype=np.uint64))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one newline after each, and where each text starts (one entry more for the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = "\n".join(texts) + "\n" if texts else ""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def lowered(codes: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)


@dataclass
class Words:
    codes: np.ndarray
    text_start: np.ndarray  # of each text in codes, one entry more for the end
    start: np.ndarray  # of each word in codes
    end: np.ndarray
    text: np.ndarray  # number of the word's text
    first: np.ndarray  # of each text's words, one entry more for the end

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        sizes = self.end - self.start
        out = np.zeros(len(sizes), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(sizes), _RUN):  # words at a time: bounded memory for a very long text too
                s, n = self.start[lo:lo + _RUN], sizes[lo:lo + _RUN]
                a, b = s[0], s[-1] + n[-1]
                codes = self.codes[a:b]
                h = _CODE[np.minimum(codes, 0xFFFF)]
                if codes.max(initial=0) > 0xFFFF:
                    h = np.where(codes > 0xFFFF, splitmix(codes.astype(np.uint64)), h)
                # place in the word decides the factor
                place = np.arange(len(codes)) - np.repeat(s - a, np.diff(np.append(s, b)))
                h = h * _powers(int(n.max()) + 1)[np.minimum(place, n.max())]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
                out[lo:lo + _RUN] = splitmix(sums[s - a + n] - sums[s - a] + n.astype(np.uint64))
        return out

    def windows(self, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(number of its first word, hash) of each run of size words inside one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        with np.errstate(over="ignore"):
            h = hashes[at]
            for k in range(1, size):
                h = splitmix(h) + hashes[at + k]
            return at, splitmix(h)


def _powers(n: int, made: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006  (kept on purpose)
    size = 1 << max(6, (n - 1).bit_length())
    if size not in made:
        with np.errstate(over="ignore"):
            made[size] = np.cumprod(np.full(size, _POWER, np.uint64), dtype=np.uint64)
    return made[size]


def split_words(texts: list[str], lower: bool = False) -> Words:
    codes, text_start = code_points(texts)
    if lower:
        codes = lowered(codes)
    sep = (codes < 128) & _SEP[np.minimum(codes, 127)]
    edge = np.flatnonzero(np.diff(sep, prepend=True))  # word starts and ends in turn: the last character is a newline
    start, end = edge[0::2], edge[1::2]
    text = np.searchsorted(text_start, start, "right") - 1
    return Words(codes, text_start, start, end, text, np.searchsorted(text, np.arange(len(texts) + 1)))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
