"""Vectorised word helpers over UTF-8 bytes, used inside tasks."""

from __future__ import annotations

import numpy as np

# ASCII whitespace: \x20 and \x09-\x0D. bytes.split() separates at exactly these.
WHITESPACE = b" \t\n\r\x0b\x0c"


def _plain_table() -> bytes:
    """A-Z to a-z; 0-9, a-z and bytes of non-ASCII characters stay; every other byte to a space."""
    out = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


PLAIN = _plain_table()
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def plain_words(data: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return data.translate(PLAIN).split()


def spaced_words(data: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text."""
    return data.split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word by XXH64, remembered between texts; starts afresh when full."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 7)
        return out


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def longer(rolled: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of every k consecutive word hashes, from those of k - 1: one multiplication and one addition each."""
    n = max(0, len(hashes) - k + 1)
    return rolled[:n] * np.uint64(_BASE) + hashes[k - 1 : k - 1 + n]


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling polynomial hash of every k consecutive word hashes, finalised; empty if there are fewer."""
    out = np.zeros(len(hashes), np.uint64)
    for j in range(1, k + 1):
        out = longer(out, hashes, j)
    return mix(out)
