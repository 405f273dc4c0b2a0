"""Text for fonts that lack characters, and titles in two balanced lines, by the widths of a font's characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain spellings of raised characters and of signs that have no decomposition; sizes that are tried, and the least one.
RAISED, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁱⁿ", "0123456789+-=()in"
SIGNS = {"−": "-", "‐": "-", "‑": "-", "×": "x", "⁄": "/", "∼": "~", "⟨": "〈", "⟩": "〉"}
ONE_LINE = (1.0, 0.96, 0.92, 0.88, 0.84, 0.80, 0.76)
TWO_LINES = (1.0, 0.94, 0.88, 0.82, 0.76)
LEAST_SIZE = 4.0


def spellings(char: str) -> Iterator[str]:
    """Plainer spellings of a character, the closest first."""
    if char in RAISED:
        yield PLAIN[RAISED.index(char)]
    if char in SIGNS:
        yield SIGNS[char]
    if unicodedata.combining(char):
        yield ""
    if plain := "".join(c for c in unicodedata.normalize("NFKD", char) if c.isascii()):
        yield plain


def portable(text: str, has: Callable[[str], bool]) -> str:
    """The text with every character that the font lacks in its first spelling that the font has; others stay."""

    def spelt(char: str) -> str:
        if char.isspace() or has(char):
            return char
        return next((s for s in spellings(char) if all(map(has, s))), char)

    return "".join(map(spelt, text))


def balanced_title(text: str, width: float, size: float, widths: Mapping[str, float]) -> str:
    """A title that does not fit one line at any allowed size, broken where both lines fit and differ least in width.

    Both lines have three characters or more; at the largest size at which there is such a break. Breaks are at blanks;
    a title without blanks breaks anywhere."""
    long = lambda s, at: sum(widths.get(c, 0.0) for c in s) * at
    if not text or "\n" in text or width <= 1 or any(long(text, size * k) <= width + 0.25 for k in ONE_LINE):
        return text
    spots = [k for k, c in enumerate(text) if c.isspace() and (k == 0 or not text[k - 1].isspace())] or range(3, len(text) - 2)
    halves = [(text[:k].rstrip(), text[k:].lstrip()) for k in spots]
    halves = [(a, b) for a, b in halves if min(len("".join(a.split())), len("".join(b.split()))) >= 3]
    for k in TWO_LINES:
        at = max(LEAST_SIZE, size * k)
        fits = [(abs(long(a, at) - long(b, at)), n) for n, (a, b) in enumerate(halves) if max(long(a, at), long(b, at)) <= width + 0.25]
        if fits:
            return "\n".join(halves[min(fits)[1]])
    return text


def portable_text(c: Column, charset: str) -> Column:
    """portable() for a font that has the characters of charset."""
    own = frozenset(charset)

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if x is None else portable(x, own.__contains__) for x in part.to_pylist()], pa.string())

    return run(c)


def title_lines(c: Column, width: Column, size: float, widths: dict[str, float]) -> Column:
    """balanced_title() of each row's text in its width; widths: of characters at size 1, a bounded table."""

    @F.arrow_udf("string")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, rooms in parts:
            yield pa.array([None if x is None or w is None else balanced_title(x, w, size, widths) for x, w in zip(texts.to_pylist(), rooms.to_pylist(), strict=True)], pa.string())

    return run(c, width.cast("double"))
