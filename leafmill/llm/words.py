"""Words of a text, their hashes, and hashes of word shingles."""

from __future__ import annotations

import re

import numpy as np

from leafmill.llm.storage import claim

WORD = re.compile(r"\w+")
#: Entries kept of the word hashes of a worker; it bounds memory, not results.
KEPT = 200_000
# Odd multipliers that tell the places of a shingle apart.
PLACE = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def words(text: str | None) -> list[str]:
    """Lower-case runs of word characters."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hash of a word, kept once seen."""

    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= KEPT:
            self.clear()
        self[word] = found
        return found


HASHES = WordHashes()


def hashed(tokens: list[str]) -> np.ndarray:
    claim(HASHES, HASHES.clear)
    return np.fromiter(map(HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def place(k: int) -> np.uint64:
    turn = (k // len(PLACE)) * 2
    return PLACE[k % len(PLACE)] + np.uint64(turn * 0x632BE59B)


def shingles(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each run of width words, in order; of all words together if there are fewer."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    width = min(width, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total += word_hashes[k : n - width + 1 + k] * place(k)
    return mix(total)
