"""What readers see: a reading view of grounded markup, mentions of pages in warnings, searches of the viewer, error lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a figure, and kinds of blocks that a reading view leaves out.
FIGURE = "> 🖼 그림 감지됨"
FURNITURE = ("page_number", "header", "footer", "footnote")
RULE = "---"
_MARK = re.compile(
    r"<\|det\|>\s*(?P<det>[A-Za-z_][\w-]*)\s*\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]\s*<\|/det\|>"
    r"|<\|ref\|>(?P<ref>[^<]{1,40})<\|/ref\|><\|det\|>\[\[?[\d,\s\[\]]*\]\]?<\|/det\|>|(?P<page><PAGE>)",
    re.A,
)


def kind_of(label: str) -> str:
    return re.sub(r"[\s-]+", "_", label.strip().lower())


def _block(kind: str, text: str) -> str:
    """What a block adds to the view; empty if nothing."""
    if kind in FURNITURE:
        return ""
    if kind == "image":
        return FIGURE
    body = re.sub(r"<\|[^|>]{0,64}\|>", "", text).strip()
    return "## " + re.sub(r"\s*\n+\s*", " ", body) if body and kind == "title" else body


def reading_view(raw: str) -> str:
    """Markdown of a whole raw text: a block to a paragraph, titles as headings, figures by a line, furniture left out,
    a rule between pages. A reference that is no figure owns no text; what follows a mark belongs to it."""
    marks = [*_MARK.finditer(raw)]
    ends = [m.start() for m in marks] + [len(raw)]
    parts = [_block("", raw[: ends[0]])]
    for m, end in zip(marks, ends[1:], strict=True):
        kind = "page" if m["page"] else kind_of(m["det"] or m["ref"])
        text = raw[m.end() : end]
        if m["page"]:
            shown = [p for p in parts if p]
            parts.append(RULE if shown and shown[-1] != RULE else "")
        if kind == "image":
            parts.append(FIGURE)
        parts.append(_block("" if kind in ("page", "image") or m["ref"] else kind, text))
    shown = [p for p in parts if p]
    return "\n\n".join(shown[:-1] if shown and shown[-1] == RULE else shown)


_ONE = re.compile(r"(?<![\d/.])(\d{1,5})(?:\s*[–—-]\s*\d{1,5})?페이지", re.A)
_LIST = re.compile(r"페이지:\s*((?:\d{1,5}\s*,\s*)*\d{1,5})(?![\d/])", re.A)


def page_mentions(text: str) -> list[dict]:
    """(page, value) of the pages that a warning names, in order: `3페이지`, `3-5페이지` by its first, and lists after `페이지:`.

    A number that goes on another one, as the lower part of a fraction does, is none; page 0 is none."""
    found = [(m.start(), m.end(), int(m[1])) for m in _ONE.finditer(text)]
    for m in _LIST.finditer(text):
        found += [(m.start(1) + n.start(), m.start(1) + n.end(), int(n[0])) for n in re.finditer(r"\d+", m[1])]
    out, at = [], 0
    for start, end, page in sorted(found):
        if start >= at and page >= 1:
            out.append({"page": page, "value": text[start:end]})
            at = end
    return out


def _parameter(search: Column, name: str) -> Column:
    return F.regexp_extract(F.regexp_replace(search, r"^\?", ""), rf"(?:^|&){name}=([^&]*)", 1)


def viewer_state(search: Column) -> Column:
    """(open, page, lang) of a search string; a page that is no number from one on is the first."""
    page = F.floor(F.regexp_extract(_parameter(search, "page"), r"^\s*\+?(\d{1,15}(?:\.\d*)?)\s*$", 1).try_cast("double")).cast("long")
    return F.struct(
        (_parameter(search, "viewer") == "1").alias("open"), F.when(page >= 1, page).otherwise(F.lit(1).cast("long")).alias("page"),
        F.when(_parameter(search, "lang") == "ko", "ko").otherwise("orig").alias("lang"),
    )


def viewer_search(search: Column, state: Column) -> Column:
    """The search string with the viewer's state in place of any that it holds; other parameters stay as they are."""
    pairs = F.filter(F.split(F.regexp_replace(search, r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike(r"^(?:viewer|page|lang)(?:=|$)"))
    own = F.array(F.lit("viewer=1"), F.concat(F.lit("page="), state["page"].cast("string")), F.concat(F.lit("lang="), state["lang"]))
    text = F.array_join(F.when(state["open"], F.concat(pairs, own)).otherwise(pairs), "&")
    return F.when(text == "", "").otherwise(F.concat(F.lit("?"), text))


def error_line(kind: Column, message: Column) -> Column:
    """Class and the first 200 characters of the message."""
    return F.concat(kind, F.lit(": "), F.substring(message, 1, 200))
