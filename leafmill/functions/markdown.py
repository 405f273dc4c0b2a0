"""Markdown blocks and safe HTML: plain Python over one page, run in Arrow batches."""

from __future__ import annotations

import html
import re

from leafmill.functions.markup import balance_table_tags, restore_table_tags

BLOCKS = "array<struct<i: int, kind: string, start: int, stop: int, level: int, text: string>>"
_HEAD = re.compile(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r" {0,3}(?:[*+-]|\d{1,9}[.)])\s+")
_HTML = re.compile(r" {0,3}</?[A-Za-z][^>\n]*>")
_TABLE = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")


def page_blocks(text: str) -> list[dict]:
    """Top-level blocks of a page with their half-open line ranges: heading, fence, quote, list, table, html, rule, paragraph.

    Every line that is not blank belongs to exactly one block, so a page can be put together again."""
    lines, out, k = text.split("\n"), [], 0

    def put(kind: str, stop: int, level: int = 0) -> int:
        while stop > k + 1 and not lines[stop - 1].strip():
            stop -= 1
        out.append({"i": len(out), "kind": kind, "start": k, "stop": stop, "level": level, "text": "\n".join(lines[k:stop])})
        return stop

    def until(test) -> int:
        j = k + 1
        while j < len(lines) and not test(lines[j]):
            j += 1
        return j

    starts = lambda x: bool(_HEAD.match(x) or _FENCE.match(x) or x.lstrip().startswith(">") or _ITEM.match(x))
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := _FENCE.match(line):
            j = until(lambda x, m=m: x.strip().startswith(m[1][0] * len(m[1])) and not x.strip().strip(m[1][0]))
            k = put("fence", min(j + 1, len(lines)))
        elif m := _HEAD.match(line):
            k = put("heading", k + 1, len(m[1]))
        elif re.match(r" {0,3}([-*_])(?:\s*\1){2,}\s*$", line):
            k = put("rule", k + 1)
        elif line.lstrip().startswith(">"):
            k = put("quote", until(lambda x: not x.strip()))
        elif _ITEM.match(line):
            k = put("list", until(lambda x: not x.strip() or bool(_HEAD.match(x) or _FENCE.match(x))))
        elif "|" in line and k + 1 < len(lines) and _TABLE.match(lines[k + 1]):
            k = put("table", until(lambda x: "|" not in x))
        elif _HTML.match(line):
            k = put("html", until(lambda x: not x.strip()))
        else:
            k = put("paragraph", until(lambda x: not x.strip() or starts(x)))
    return out


def _inline(text: str) -> str:
    text = html.escape(text, quote=False)
    kept: list[str] = []
    text = re.sub(r"`([^`\n]+)`", lambda m: (kept.append(f"<code>{m[1]}</code>"), f"\0{len(kept) - 1}\0")[1], text)
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<!\*)\*([^*\n]+)\*(?!\*)", r"<em>\1</em>", text)
    text = re.sub(r"!\[([^\]\n]*)\]\(([\w./-]+)\)", r'<img alt="\1" src="\2">', text)
    return re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], text)


def to_html(text: str) -> str:
    """Safe HTML of a page: raw HTML is escaped, but for table tags, which are balanced."""
    out = []
    for b in page_blocks(text):
        body = b["text"]
        if b["kind"] == "heading":
            out.append(f"<h{b['level']}>{_inline(_HEAD.match(body)[2])}</h{b['level']}>")
        elif b["kind"] == "fence":
            inner = body.split("\n")[1:]
            closed = len(inner) > 0 and bool(_FENCE.match(inner[-1]))
            out.append(f"<pre><code>{html.escape(chr(10).join(inner[:-1] if closed else inner), quote=False)}</code></pre>")
        elif b["kind"] == "quote":
            out.append(f"<blockquote>{_inline(re.sub(r'(?m)^ {0,3}> ?', '', body))}</blockquote>")
        elif b["kind"] == "list":
            items = re.split(r"(?m)^ {0,3}(?:[*+-]|\d{1,9}[.)])\s+", body)[1:]
            out.append("<ul>" + "".join(f"<li>{_inline(x.strip())}</li>" for x in items) + "</ul>")
        elif b["kind"] == "rule":
            out.append("<hr>")
        elif b["kind"] == "table":
            rows = [[c.strip() for c in r.strip().strip("|").split("|")] for r in body.split("\n")]
            head = "".join(f"<th>{_inline(c)}</th>" for c in rows[0])
            cells = "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in r) + "</tr>" for r in rows[2:])
            out.append(f"<table><tr>{head}</tr>{cells}</table>")
        elif b["kind"] == "html":
            out.append(balance_table_tags(restore_table_tags(html.escape(body))))
        else:
            out.append(f"<p>{_inline(body)}</p>")
    return "\n".join(out)
