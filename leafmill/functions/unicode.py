"""Unicode forms that Spark SQL lacks, by whole Arrow batches: NFKC and full case folding."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of tags that are markup, of commands that stand for a letter, and of commands that only wrap text.
TAG_NAMES = (
    "table thead tbody tfoot tr td th caption colgroup col b i u em strong sup sub br hr p div span ul ol li dl dt dd code pre a img h1 h2 h3 h4 h5 h6 figure figcaption blockquote"
).split()
GREEK_SMALL = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
GREEK_CAPITAL = "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega".split()
VARIANTS = {"varepsilon": "epsilon", "vartheta": "theta", "varphi": "phi"}
WRAPPERS = "text mathrm operatorname".split()


def _letters() -> dict[str, str]:
    """Letter of each command, by the letters' Unicode names (which spell lambda lamda)."""
    named = lambda size, name: unicodedata.lookup(f"GREEK {size} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")
    small = {name: named("SMALL", name) for name in GREEK_SMALL}
    return small | {name: named("CAPITAL", name) for name in GREEK_CAPITAL} | {v: small[name] for v, name in VARIANTS.items()} | {"ell": "\u2113"}


LETTERS = _letters()
#: A tag: the name is followed by a blank, a slash or the end, so that `<a, b>` is none; it does not cross a line.
MARKUP = rf"(?i)</?(?:{'|'.join(TAG_NAMES)})(?:(?:[^\S\n]|/)[^>\n]*)?>"
_WRAPPED = re.compile(rf"\\(?:{'|'.join(WRAPPERS)})\s*\{{([^{{}}]*)\}}")


def _spelt(text: str) -> str:
    """Commands become their letter; others end the word that they stand in."""
    head, *rest = text.split("\\")
    out = [head]
    for piece in rest:
        name = re.match("[A-Za-z]*", piece)[0]
        out += [LETTERS.get(name, " "), piece[len(name) :]]
    return "".join(out)


def _alnum(text: str) -> str:
    return "".join(filter(str.isalnum, text))


def comparison_forms(texts: pa.Array) -> pa.Array:
    """The form in which pages are compared: markup goes, NFKC, commands as letters, letters and digits only, case folded."""
    bare = pc.replace_substring_regex(texts, MARKUP, " ").to_pylist()
    return pa.array([None if x is None else _alnum(_spelt(unicodedata.normalize("NFKC", x))).casefold() for x in bare], pa.string())


def truth_forms(texts: pa.Array) -> pa.Array:
    """The form of the evaluation: images and anything in angle brackets go, NFKC, entities, wrapped text, letters and digits in lower case."""
    bare = pc.replace_substring_regex(pc.replace_substring_regex(texts, r"!\[[^\]]*\]\([^)]*\)", ""), r"<[^>]*>", "")
    plain = [None if x is None else html.unescape(unicodedata.normalize("NFKC", x)) for x in bare.to_pylist()]
    return pa.array([None if x is None else "".join(c.lower() for c in _alnum(_WRAPPED.sub(r"\1", x))) for x in plain], pa.string())


def _column(forms: Callable[[pa.Array], pa.Array], c: Column) -> Column:
    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(forms, parts)

    return run(c)


def exact_norm(c: Column) -> Column:
    return _column(comparison_forms, c)


def truth_norm(c: Column) -> Column:
    return _column(truth_forms, c)
