"""Text primitives as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.arrays import let

#: Markup tags that a page normaliser drops, and Greek letters by command name.
PAGE_MARK = "<PAGE>"
SPECIAL = r"<\|[^|]*\|>"
IMAGE_REF = r"!\[[^\]]*\]\([^)]*\)"


def strip_ws(c: Column) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def nonempty_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip_ws), lambda x: x != "")


def normalize_latin(c: Column) -> Column:
    """Lower case, letters and digits only: the form in which texts are compared."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def strip_tags(c: Column) -> Column:
    """Without HTML tags that start with a letter or a slash; a tag does not cross a line."""
    return F.regexp_replace(c, r"</?[A-Za-z][^>\n]*>", "")


def align_norm(c: Column) -> Column:
    """normalize_latin after special tokens and image references are dropped."""
    return normalize_latin(strip_tags(F.regexp_replace(F.regexp_replace(c, SPECIAL, " "), IMAGE_REF, " ")))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank."""
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def chars(c: Column) -> Column:
    """Characters of a text; empty for an empty text."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.expr("cast(array() as array<string>)"))


def char_bigrams(c: Column) -> Column:
    """All pairs of neighbouring characters, in order; a text of one character has none."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(..))"), F.lit(1))


def probes(c: Column, width: int, most: int) -> Column:
    """At most `most` pieces of `width` characters, evenly spread over a text of at least that length."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        count = F.least(F.lit(most), F.floor(n / width)).cast("int")
        at = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.floor(k * (n - width) / F.greatest(count - 1, F.lit(1))).cast("int"))
        return F.when(n >= width, F.transform(at, lambda p: F.substring(t, p + 1, F.lit(width)))).otherwise(F.expr("cast(array() as array<string>)"))

    return let(c, cut)


def found_share(pieces: Column, text: Column) -> Column:
    """Share of the pieces that the text contains; null without pieces."""
    return F.when(F.size(pieces) > 0, F.size(F.filter(pieces, lambda p: F.contains(text, p))) / F.size(pieces))


def words_of(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sanitize(c: Column, rounds: int = 4) -> Column:
    """Special tokens stripped until none is left (nested ones in bounded rounds), page marks made harmless."""
    for _ in range(rounds):
        c = F.regexp_replace(c, SPECIAL, "")
    c = F.when(c.rlike(SPECIAL), F.translate(c, "<", " ")).otherwise(c)
    return F.replace(c, F.lit(PAGE_MARK), F.lit("⟨PAGE⟩"))


def strip_think(c: Column) -> Column:
    """Without leading <think> blocks, and without a fence around the whole answer."""
    bare = strip_ws(F.regexp_replace(c, r"^(?s:\s*<think>.*?</think>)+", ""))
    return F.when(bare.rlike(r"^```[^\n]*\n(?s:.*)\n```$"), F.regexp_extract(bare, r"^```[^\n]*\n(?s:(.*))\n```$", 1)).otherwise(bare)


def redact_query(c: Column) -> Column:
    """Query strings in a message become an ellipsis."""
    return F.regexp_replace(c, r"""\?[^\s'"()<>]*""", "?…")


def ratio_of(c: Column, pattern: str) -> Column:
    """Characters that match the class over all characters; null for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(pattern)) / F.length(c))
