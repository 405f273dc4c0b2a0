"""Placeholder masking with loss-free restore. One scan with priorities, so it is an Arrow-batched Python function."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The kinds of masked text in order of priority.
KINDS = (
    ("code", r"```.*?```|~~~.*?~~~|`[^`\n]+`"),
    ("math", r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<![\w$])\$(?![\d\s])[^$\n]{1,200}?(?<!\s)\$(?![\w$])"),
    ("image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("tag", r"</?[A-Za-z][^<>\n]*>"),
    ("url", r"https?://[^\s<>\"')\]]+|\bdoi:\s?\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("cite", r"\[\d+(?:\s*[,-]\s*\d+)*\]"),
    ("ref", r"\b(?:Fig(?:ure)?|Table|Eq|Sec(?:tion)?)\.?\s?\d+(?:\.\d+)*[a-z]?\b"),
)
SCAN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in KINDS), re.S)
MARK = re.compile(r"⟦\s*([a-z])(\d+)\s*⟧")


def mask(text: str | None) -> tuple[str, list[tuple[str, str, str]]]:
    """(masked text, [(id, kind, original)]): ids are numbered in text order over all kinds.

    Placeholder-like text in the source is masked itself, so the restore stays exact."""
    kept: list[tuple[str, str, str]] = []
    if not text:
        return "", kept

    def swap(kind: str, original: str) -> str:
        name = f"{kind[0]}{len(kept) + 1}"
        kept.append((name, kind, original))
        return f"⟦{name}⟧"

    out, at = [], 0
    both = re.compile(f"{SCAN.pattern}|(?P<own>{MARK.pattern})", re.S)
    for m in both.finditer(text):
        out.append(text[at : m.start()])
        out.append(swap("own" if m.lastgroup is None or m["own"] else next(k for k, _ in KINDS if m[k] is not None), m[0]))
        at = m.end()
    return "".join(out) + text[at:], kept


def unmask(text: str, kept: list[tuple[str, str, str]]) -> tuple[str, list[str], list[str]]:
    """(restored text, missing ids, ids that occur more than once or are unknown). Marks are read leniently."""
    table = {name: original for name, _, original in kept}
    seen: Counter[str] = Counter()

    def back(m: re.Match) -> str:
        name = m[1] + m[2]
        seen[name] += 1
        return table.get(name, "") if seen[name] == 1 else ""

    out = MARK.sub(back, text)
    return out, sorted(n for n in table if not seen[n]), sorted(n for n, c in seen.items() if c > 1 or n not in table)


def sanitize(out: str, masked: str) -> tuple[str, int]:
    """Marks that a model invents go where the source lacks them: heading marks, list bullets, dollar signs, tag tails."""
    changes = 0
    for pattern, repl in ((r"(?m)^#{1,6}\s+", ""), (r"(?m)^[*+-]\s+", ""), (r"(?<!\\)\$", ""), (r"</[A-Za-z]+>\s*$", "")):
        if not re.search(pattern, masked):
            out, n = re.subn(pattern, repl, out)
            changes += n
    return out, changes


def mask_rows(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, masked, tokens array<struct<id, kind, orig>>) of every row; a null text is an empty one."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            found = [mask(x) for x in part[text_col]]
            yield pd.DataFrame({key: part[key], "masked": [m for m, _ in found], "tokens": [[dict(zip(("id", "kind", "orig"), t, strict=True)) for t in ts] for _, ts in found]})

    return df.select(key, text_col).mapInPandas(run, f"{key} {kind}, masked string, tokens array<struct<id: string, kind: string, orig: string>>")


def unmask_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, text, missing, extra) from rows with masked and tokens."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            found = [unmask(m, [(t["id"], t["kind"], t["orig"]) for t in ts]) for m, ts in zip(part["masked"], part["tokens"], strict=True)]
            yield pd.DataFrame({key: part[key], "text": [f[0] for f in found], "missing": [f[1] for f in found], "extra": [f[2] for f in found]})

    return df.select(key, "masked", "tokens").mapInPandas(run, f"{key} {kind}, text string, missing array<string>, extra array<string>")
