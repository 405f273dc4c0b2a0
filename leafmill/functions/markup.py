"""Markup parsers that need a stack or a recogniser: plain Python, run in Arrow batches by as_udf."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F


def as_udf(fn: Callable, kind: str):
    """A scalar function as an Arrow-batched column function; null stays null."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in texts], dtype=object)

    return run


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            given = dict(attrs)
            span = [int(v) if (v := given.get(k) or "1").isdigit() and 0 < int(v) < 1000 else 1 for k in ("rowspan", "colspan")]
            self.cell = []
            self.rows[-1].append((span[0], span[1], self.cell))
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_cells(html: str) -> list[dict] | None:
    """Cells (row, col, rowspan, colspan, text) of the first table; None if spans overlap or leave holes.

    Of each column only the row is held up to which cells reach, so a table may have any number of cells."""
    parser = _Cells()
    parser.feed(html)
    reach: list[int] = []
    filled: list[int] = []
    cells, height = [], len(parser.rows)
    for r, row in enumerate(parser.rows):
        c = 0
        for rowspan, colspan, text in row:
            while c < len(reach) and reach[c] > r:
                c += 1
            if any(below > r for below in reach[c : c + colspan]):
                return None
            rowspan = min(rowspan, height - r)
            reach += [r] * (c + colspan - len(reach))
            reach[c : c + colspan] = [r + rowspan] * colspan
            cells.append({"row": r, "col": c, "rowspan": rowspan, "colspan": colspan, "text": " ".join("".join(text).split())})
            c += colspan
        filled.append(sum(below > r for below in reach))
    return cells if cells and all(n == len(reach) for n in filled) else None


def table_matrix(html: str) -> list[list[str]] | None:
    """Rows of texts, spanned values repeated."""
    cells = table_cells(html)
    if cells is None:
        return None
    rows = max(c["row"] + c["rowspan"] for c in cells)
    cols = max(c["col"] + c["colspan"] for c in cells)
    out = [[""] * cols for _ in range(rows)]
    for c in cells:
        for i in range(c["rowspan"]):
            for j in range(c["colspan"]):
                out[c["row"] + i][c["col"] + j] = c["text"]
    return out


_TABLE_TAG = re.compile(r"&lt;(/?(?:table|thead|tbody|tr|td|th))((?:\s+(?:row|col)span=(?:&quot;|\")?\d{1,3}(?:&quot;|\")?)*)\s*&gt;", re.I)


def restore_table_tags(html: str) -> str:
    """Escaped table tags become tags again, numeric spans kept; the rest stays escaped."""
    return _TABLE_TAG.sub(lambda m: f"<{m[1].lower()}{m[2].replace('&quot;', chr(34))}>", html)


def balance_table_tags(html: str) -> str:
    """Unmatched closers go, open tags are closed at the end, in order."""
    out, stack, at = [], [], 0
    for m in re.finditer(r"<(/?)(table|thead|tbody|tr|td|th)\b[^>]*>", html, re.I):
        out.append(html[at : m.start()])
        at, tag = m.end(), m[2].lower()
        if not m[1]:
            stack.append(tag)
            out.append(m[0])
        elif tag in stack:
            while True:
                top = stack.pop()
                out.append(f"</{top}>")
                if top == tag:
                    break
    out.append(html[at:])
    return "".join(out) + "".join(f"</{t}>" for t in reversed(stack))


_ATOM = r"(?:\d+(?:\.\d+)?[A-Za-zα-ωΑ-Ω]?|[A-Za-zα-ωΑ-Ω])(?:[_^](?:\d+|\{[^{}\n]{1,20}\}))*"
_SIDE = rf"{_ATOM}(?:\s?[+\-*/·×]\s?{_ATOM}){{0,12}}"
_ALGEBRA = re.compile(rf"(?<![\w\\$]){_SIDE}(?:\s(?:=|<|>|≤|≥|≈|≠)\s{_SIDE}){{1,4}}(?![\w\\$])")
_GUARD = re.compile(r"`[^`\n]*`|\$[^$\n]*\$|\\\(.*?\\\)|\\\[.*?\\\]|https?://\S+|<[^<>\n]*>")


def recover_math_line(line: str) -> str:
    """Bare algebra with a spaced relation and a numeric script gets delimiters; code, links, tags and maths stay."""
    def wrap(text: str) -> str:
        return _ALGEBRA.sub(lambda m: f"\\({m[0]}\\)" if len(m[0]) <= 256 and re.search(r"[_^](?:\d|\{)", m[0]) else m[0], text)

    out, at = [], 0
    for m in _GUARD.finditer(line):
        out += [wrap(line[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + wrap(line[at:])


def recover_math(text: str) -> str:
    """recover_math_line outside fences; a page mark ends a fence."""
    out, fence = [], ""
    for line in text.split("\n"):
        mark = re.match(r"\s*(```|~~~)", line)
        if "<PAGE>" in line:
            fence = ""
        elif mark and (not fence or fence == mark[1]):
            fence = "" if fence else mark[1]
            out.append(line)
            continue
        out.append(line if fence else recover_math_line(line))
    return "\n".join(out)


def is_dollar_math(tex: str) -> bool:
    """Whether what stands between two dollar signs is maths and no price."""
    return bool(re.search(r"[\\^_{}]", tex)) or (bool(tex) and not tex[0].isdigit() and len(tex) <= 40)


_PARAGRAPH = r"\n[^\S\n]*\n"
_DELIMITED = re.compile(
    rf"(?P<code>^(?P<fence>```|~~~)[^\n]*\n(?:.*?\n)??(?P=fence)[^\n]*$|`[^`\n]+`)|\$\$(?P<block>(?:(?!{_PARAGRAPH}).)+?)\$\$|\$(?P<dollar>[^$\n]+?)\$"
    rf"|(?<!\\)\\\[(?P<display>(?:(?!(?<!\\)\\\[|{_PARAGRAPH}).)+?)\\\]|(?<!\\)\\\((?P<inline>(?:(?!(?<!\\)\\\(|{_PARAGRAPH}).)+?)\\\)|(?P<sign>\$)",
    re.S | re.M,
)


def dollar_delimiters(text: str) -> str:
    """All maths between dollar signs: one for maths in a line, two on lines of their own for displayed maths. Code stays,
    dollar signs that are prices are escaped, empty maths goes."""

    def put(m: re.Match) -> str:
        if m["code"]:
            return m[0]
        if m["sign"]:
            return "\\$"
        if m["dollar"] is not None and not is_dollar_math(m["dollar"].strip()):
            return m[0].replace("$", "\\$")
        tex = next(g for g in (m["block"], m["display"], m["dollar"], m["inline"]) if g is not None).strip()
        if not tex:
            return ""
        return f"${tex}$" if m["block"] is None and m["display"] is None else f"\n\n$$\n{tex}\n$$\n\n"

    return _DELIMITED.sub(put, text.replace("\0", "\ufffd"))


_RUN = re.compile(r"\\\[(?P<display>.+?)\\\]|\\\((?P<inline>.+?)\\\)", re.S)


def split_inline_math(text: str) -> list[dict]:
    """Runs (kind, text, display) of text and of marked maths, blanks around maths left out; an empty text is one empty run."""
    out, at = [], 0
    for m in _RUN.finditer(text):
        if m.start() > at:
            out.append({"kind": "text", "text": text[at : m.start()], "display": False})
        if tex := (m["display"] or m["inline"]).strip():
            out.append({"kind": "math", "text": tex, "display": m["display"] is not None})
        at = m.end()
    if at < len(text) or not out:
        out.append({"kind": "text", "text": text[at:], "display": False})
    return out


# The character that stands for a command, commands that stand for nothing, letters with a doubled stroke,
# accents, raised characters, fractions, binomials, and commands that only wrap what follows.
SIGNS = """
alpha α beta β gamma γ delta δ epsilon ε zeta ζ eta η theta θ iota ι kappa κ lambda λ mu μ nu ν xi ξ pi π rho ρ sigma σ tau τ upsilon υ phi φ chi χ psi ψ omega ω
Gamma Γ Delta Δ Theta Θ Lambda Λ Xi Ξ Pi Π Sigma Σ Upsilon Υ Phi Φ Psi Ψ Omega Ω varepsilon ε vartheta θ varphi φ varrho ρ varsigma σ varpi π ell ℓ
oplus ⊕ otimes ⊗ times × pm ± mp ∓ cdot · ast * in ∈ notin ∉ ni ∋ le ≤ leq ≤ ge ≥ geq ≥ neq ≠ approx ≈ sim ∼ simeq ≃ cong ≅ equiv ≡ propto ∝ ll ≪ gg ≫
to → rightarrow → leftarrow ← leftrightarrow ↔ uparrow ↑ downarrow ↓ Rightarrow ⇒ Leftarrow ⇐ Leftrightarrow ⇔ implies ⇒ iff ⇔
ldots … cdots … dots … infty ∞ partial ∂ nabla ∇ forall ∀ exists ∃ cup ∪ cap ∩ subset ⊂ supset ⊃ subseteq ⊆ supseteq ⊇ wedge ∧ land ∧ vee ∨ lor ∨ neg ¬ lnot ¬
mid | vert | lvert | rvert | Vert ‖ lVert ‖ rVert ‖ langle ⟨ rangle ⟩ sum ∑ prod ∏ int ∫ prime ′ dagger † angle ∠ perp ⊥ bot ⊥ therefore ∴ because ∵ triangle △ colon : top T intercal T
""".split()
COMMANDS = dict(zip(SIGNS[::2], SIGNS[1::2], strict=True)) | {"quad": " ", "qquad": "  "}
SILENT = frozenset("left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr displaystyle textstyle scriptstyle limits nolimits".split())
DOUBLED = str.maketrans("CHNPQRZ", "ℂℍℕℙℚℝℤ")
ACCENTS = {"hat": "\u0302", "widehat": "\u0302", "tilde": "\u0303", "widetilde": "\u0303", "bar": "\u0304", "overline": "\u0304", "dot": "\u0307", "ddot": "\u0308", "vec": "\u20d7"}
SUPERS = str.maketrans("0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾")
FRACTIONS, BINOMIALS = ("frac", "dfrac", "tfrac", "cfrac"), ("binom", "dbinom", "tbinom")
WRAPS = ("text", "mathrm", "mathbf", "mathit", "mathsf", "mathtt", "mathcal", "mathfrak", "boldsymbol", "operatorname", "textbf", "textit", "emph", "underline")
_ATOM_TEXT = re.compile(r"√?(?:[^\W_]|[.′'\u0300-\u036f\u20d0-\u20ff⁺⁻⁼⁽⁾])+(?:\^?\([^()]*\))*")


def _group(s: str, at: int) -> tuple[str, int]:
    """The braced group or single character at a position, and where it ends."""
    if at >= len(s) or s[at] != "{":
        return s[at : at + 1], at + 1
    depth = 0
    for k in range(at, len(s)):
        depth += (s[k] == "{") - (s[k] == "}")
        if not depth:
            return s[at + 1 : k], k + 1
    return s[at + 1 :], len(s)


def _argument(s: str, at: int) -> tuple[str, int] | None:
    """What a command takes from a position on: a group, a command or one character; None if there is nothing to take."""
    while at < len(s) and s[at] in " \t":
        at += 1
    if m := re.compile(r"\\(?:[A-Za-z]+|.)").match(s, at):
        return m[0], m.end()
    if at >= len(s) or s[at] in "}^_\\":
        return None
    inner, end = _group(s, at)
    return None if s[at] == "{" and s[end - 1 : end] != "}" else (inner, end)


def _bracketed(text: str) -> str:
    """A part of a fraction or root: in brackets unless it is one number, name or root."""
    text = text.strip()
    return text if _ATOM_TEXT.fullmatch(text) else f"({text})"


def _script(mark: str, text: str) -> str:
    text = text.strip()
    if mark == "^" and text and not any(map(str.isalpha, text)) and all(ord(c) in SUPERS for c in text):
        return text.translate(SUPERS)
    return f"({text})" if mark == "_" else f"^({text})"


def _command(name: str, s: str, at: int, depth: int) -> tuple[str, int]:
    """The text of a command with its arguments, and where it ends; a command that is not known keeps its name."""
    first = _argument(s, at) if name in (*FRACTIONS, *BINOMIALS, *WRAPS, *ACCENTS, "mathbb", "sqrt") else None
    if name == "sqrt" and (m := re.compile(r"\s*\[([^\]]*)\]").match(s, at)):
        order, first = m[1].strip(), _argument(s, m.end())
        if first:
            return f"{order.translate(SUPERS) if order.isdigit() else order}√{_bracketed(_read(first[0], depth + 1))}", first[1]
    if first is None:
        return "" if name in SILENT else COMMANDS.get(name, name), at
    inner = _read(first[0], depth + 1)
    if name in (*FRACTIONS, *BINOMIALS):
        second = _argument(s, first[1])
        if second is None:
            return name, at
        below = _read(second[0], depth + 1)
        return (f"{_bracketed(inner)}/{_bracketed(below)}" if name in FRACTIONS else f"C({inner.strip()}, {below.strip()})"), second[1]
    if name == "sqrt":
        return f"√{_bracketed(inner)}", first[1]
    if name == "mathbb":
        return inner.translate(DOUBLED), first[1]
    if name in ACCENTS:
        return inner.strip() + ACCENTS[name] * (len(inner.strip()) == 1), first[1]
    return inner, first[1]


_ESCAPED = {",": " ", ";": " ", ":": " ", " ": " ", ">": " ", "!": "", "|": "‖", "(": "", ")": "", "[": "", "]": "", "\\": " "}


def _read(s: str, depth: int) -> str:
    if depth > 8:
        return s
    out, k = [], 0
    while k < len(s):
        m = re.compile(r"\\(?:([A-Za-z]+)\*?|(.))", re.S).match(s, k)
        if m and m[1]:
            text, k = _command(m[1], s, m.end(), depth)
            out.append(text)
        elif m:
            out.append(_ESCAPED.get(m[2], m[2]))
            k = m.end()
        elif s[k] in "^_" and (found := _argument(s, k + 1)):
            out.append(_script(s[k], _read(found[0], depth + 1)))
            k = found[1]
        elif s.startswith("$$", k):
            k += 2
        else:
            out.append("" if s[k] in "{}" else s[k])
            k += 1
    return "".join(out)


def plain_math(s: str) -> str:
    """Readable text of LaTeX in a text: fractions, roots, accents, scripts (of HTML too) and known commands; an unknown
    command keeps its name. Tags become blanks, runs of blanks one, and blank lines go."""
    s = re.sub(r"<(sup|sub)>([^<]*)</\1>", lambda m: ("^{" if m[1].lower() == "sup" else "_{") + m[2] + "}", s, flags=re.I)
    text = _read(re.sub(r"</?[A-Za-z][^>\n]*>", " ", s), 0)
    return "\n".join(x for x in (" ".join(line.split()) for line in text.splitlines()) if x)


def strip_markdown(content: str, source: str) -> str:
    """Marks of headings, quotes, bullets and emphasis go unless the source has them; code spans stay."""
    spans: list[str] = []
    text = re.sub(r"`[^`\n]+`", lambda m: (spans.append(m[0]), f"\0{len(spans) - 1}\0")[1], content)
    for pattern, repl in ((r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^[*+-]\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", r"\1")):
        if not re.search(pattern, source):
            text = re.sub(pattern, repl, text)
    return re.sub(r"\0(\d+)\0", lambda m: spans[int(m[1])], text)


# Signs of an equation, what may not stand next to a bare one, and what may not follow it after a blank.
EQUATION_SIGNS = frozenset(".+*/=^_(),<>≤≥≈-")
BEFORE, BEFORE_BLANK = frozenset("_\\/@.:?#%&=^+-*"), frozenset("=+-*/^_")
AFTER, AFTER_BLANK = frozenset("_\\/@?#%&=^+*({<>"), frozenset("=+-*/^_%&|!<>≤≥≈\\")
_PIECE = re.compile(r"\\(?P<name>[A-Za-z]+)|(?P<script>[_^])\s*\{\s*(?P<index>[+-]?\s*\d+|[A-Za-z])\s*\}|(?P<other>.)", re.S)
_SPAN = re.compile(r"\$\$(.*?)\$\$|\\\[(.*?)\\\]|\\\((.*?)\\\)|(?<!\$)\$(?!\$)(.*?)(?<!\$)\$(?!\$)", re.S)


def _presented(tex: str, depth: int = 0) -> str:
    """One spelling for what is only written differently: signs of products and minus, wrapped names, scripts, roots; the rest stays."""
    if depth > 16:
        return tex
    out, at = [], 0
    while m := _PIECE.match(tex, at):
        at = m.end()
        if m["script"]:
            out.append(m["script"] + m["index"])
        elif m["name"] in ("times", "cdot"):
            out.append("*")
        elif m["name"] in ("text", "mathrm", "operatorname", "sqrt"):
            opens = at + len(tex[at:]) - len(tex[at:].lstrip())
            inner, end = _group(tex, opens) if tex[opens : opens + 1] == "{" else ("", 0)
            if m["name"] == "sqrt" and end and tex[end - 1 : end] == "}" and inner.count("{") == inner.count("}"):
                out.append(f"sqrt({_presented(inner, depth + 1)})")
                at = end
            elif m["name"] != "sqrt" and end and not set("{}") & set(_presented(inner, depth + 1)):
                out.append("".join(_presented(inner, depth + 1).split()))
                at = end
            else:
                out.append(m[0])
        elif m["name"] not in ("left", "right"):
            out.append({"−": "-", "×": "*"}.get(m[0], m[0]))
    return "".join(out)


def math_text(tex: str) -> str | None:
    """An equation as it is compared: one spelling, no blanks; None if it has other signs or unbalanced brackets."""
    text = "".join(_presented(unescape(tex)).split())
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0 or not (c in EQUATION_SIGNS or c.isascii() and c.isalnum()):
            return None
    return text if text and not depth else None


def _apart(before: str, after: str) -> bool:
    """Whether what stands around a bare equation does not go on with it."""
    if before and (before[-1].isalnum() or before[-1] in BEFORE) or before.rstrip(" \t")[-1:] in BEFORE_BLANK and before.rstrip(" \t"):
        return False
    if after and (after[0].isalnum() or after[0] in AFTER) or re.match(r"\.\d", after):
        return False
    tail = after.split("\n", 1)[0].lstrip(" \t")
    return not (tail and tail[0] in AFTER_BLANK or re.match(r"[A-Za-z]{1,2}\b|\d", tail))


def equation_found(page: str, expected: str) -> bool:
    """Whether the equation stands on the page as a whole marked span, or bare between neighbours that do not go on with it.

    What is expected must be an equation in the sense of math_text."""
    want = math_text(expected)
    if want is None:
        raise ValueError(f"no equation that can be compared: {expected!r}")
    if any(math_text(next(g for g in m.groups() if g is not None)) == want for m in _SPAN.finditer(page)):
        return True
    bare = _presented(unescape(re.sub(r"<[^>]*>", " ", _SPAN.sub(" ", page))))
    where = [k for k, c in enumerate(bare) if not c.isspace()]
    dense = "".join(bare[k] for k in where)
    at = dense.find(want)
    while at >= 0:
        if _apart(bare[max(0, where[at] - 200) : where[at]], bare[where[at + len(want) - 1] + 1 :][:2000]):
            return True
        at = dense.find(want, at + len(want))
    return False


def tandem(text: str, most: int = 64, least: int = 24, chars: int = 3072) -> int:
    """Length of the repetition that ends a text: a unit of at most `most` words, `least` times or more; 0 if it is too short."""
    words = re.findall(r"\S+\s*", text)
    for unit in range(1, min(most, len(words) // least) + 1):
        tail, n = words[-unit:], 1
        if not any(c.isalnum() for w in tail for c in w):
            continue
        flat = [w.rstrip() for w in tail]
        while (n + 1) * unit <= len(words) and [w.rstrip() for w in words[-(n + 1) * unit : -n * unit]] == flat:
            n += 1
        size = sum(map(len, words[-n * unit :]))
        if n >= least and size >= chars:
            return size
    return 0
