"""Incremental processors of text streams. Each is a plain object with feed() and finish(); its state is a dict
that JSON can hold, so the same object serves a Structured Streaming state, a batch fold and a test."""

from __future__ import annotations

import re
from collections.abc import Callable

from leafmill.functions.markup import recover_math_line

Event = tuple[str, str]
PAGE = "<PAGE>"


def held_back(text: str, mark: str) -> int:
    """Length of the longest end of text that may be the beginning of mark."""
    at = text.find(mark[0], max(0, len(text) - len(mark) + 1))
    while at >= 0:
        if mark.startswith(text[at:]):
            return len(text) - at
        at = text.find(mark[0], at + 1)
    return 0


class Machine:
    """State in self.s; subclasses set its first value in START."""

    START: dict = {}

    def __init__(self, state: dict | None = None):
        self.s = dict(self.START) if state is None else dict(state)

    def feed(self, text: str) -> list[Event]:
        raise NotImplementedError

    def finish(self) -> list[Event]:
        return []


class PageFramer(Machine):
    """Segment k of the output is page k: one mark before each page, marks beyond the expected number go,
    missing ones are padded at the end. A mark that is split over inputs is seen once."""

    START = {"tail": "", "seen": 0, "expected": 0, "lead": True}

    def __init__(self, state: dict | None = None, expected: int | None = None):
        super().__init__(state)
        if expected is not None:
            self.s["expected"] = expected

    def _mark(self, out: list[Event]) -> None:
        if not self.s["expected"] or self.s["seen"] < self.s["expected"]:
            self.s["seen"] += 1
            out.append(("page", str(self.s["seen"])))

    def _text(self, out: list[Event], text: str) -> None:
        if text and self.s["lead"]:
            if not text.strip():
                return  # blank text before the first page
            self.s["lead"] = False
            if not self.s["seen"]:
                self._mark(out)
        if text:
            out.append(("text", text))

    def feed(self, text: str) -> list[Event]:
        out: list[Event] = []
        parts = (self.s["tail"] + text).split(PAGE)
        for k, part in enumerate(parts):
            if k:
                self.s["lead"] = False
                self._mark(out)
            last = k == len(parts) - 1
            keep = held_back(part, PAGE) if last else 0
            if last and self.s["lead"] and not part.strip():
                keep = len(part)
            self._text(out, part[: len(part) - keep])
            if last:
                self.s["tail"] = part[len(part) - keep :]
        return out

    def finish(self) -> list[Event]:
        out: list[Event] = []
        self._text(out, self.s["tail"])
        self.s["tail"] = ""
        while self.s["seen"] < self.s["expected"]:
            self._mark(out)
        return out


class BlockHeaders(Machine):
    """<BLOCK>label[box]<FORK> headers become the older grammar; an incomplete header is held back, up to a cap."""

    START = {"pending": ""}
    CAP = 1024
    HEAD = re.compile(r"<BLOCK>([a-z_]+)\[([0-9, ]*)\]<FORK>")

    @staticmethod
    def _render(m: re.Match) -> str:
        label = "image" if m[1] in ("figure", "image", "chart") else m[1]
        return f"<|ref|>{label}<|/ref|><|det|>[[{m[2]}]]<|/det|>"

    def feed(self, text: str) -> list[Event]:
        data = self.HEAD.sub(self._render, self.s["pending"] + text)
        at = data.rfind("<BLOCK>")
        if at < 0:
            at = len(data) - held_back(data, "<BLOCK>")
        self.s["pending"] = data[at:]
        if len(self.s["pending"]) > self.CAP:
            raise ValueError("a block header does not end")
        return [("text", data[:at])] if at else []

    def finish(self) -> list[Event]:
        rest, self.s["pending"] = self.s["pending"], ""
        return [("text", rest)] if rest else []


class Lines(Machine):
    """Whole lines from pieces; both kinds of line end count, also when split over inputs."""

    START = {"rest": ""}

    def feed(self, text: str) -> list[Event]:
        data = self.s["rest"] + text
        keep = data.endswith("\r")
        parts = data[: len(data) - keep].replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.s["rest"] = parts.pop() + "\r" * keep
        return [("line", p) for p in parts]

    def finish(self) -> list[Event]:
        rest = self.s["rest"].replace("\r", "")
        self.s["rest"] = ""
        return [("line", rest)] if rest else []


class RepetitionGuard(Machine):
    """Stops a stream that repeats itself: a run of lines of one template, a run of counters, or a page over its budget."""

    START = {"rest": "", "template": "", "run": 0, "counter": -1, "counts": 0, "chars": 0, "stop": ""}
    RUN, COUNTERS, CHARS = 64, 20, 16_384

    def _line(self, line: str) -> None:
        if not line.strip():
            return
        numbers = re.findall(r"\d+", line)
        shape = re.sub(r"\d+", "<n>", line) if 1 <= len(numbers) <= 2 and len(line) >= 24 and sum(c.isalpha() for c in line) >= 8 else ""
        self.s["run"] = self.s["run"] + 1 if shape and shape == self.s["template"] else int(bool(shape))
        self.s["template"] = shape
        if self.s["run"] >= self.RUN:
            self.s["stop"] = "repeated-lines"
        for x in re.findall(r"#\s*(\d{1,9})\.", line):
            self.s["counts"] = self.s["counts"] + 1 if int(x) == self.s["counter"] + 1 else 1
            self.s["counter"] = int(x)
            if self.s["counts"] >= self.COUNTERS:
                self.s["stop"] = "counter-loop"

    def feed(self, text: str) -> list[Event]:
        if self.s["stop"]:
            return []
        parts = (self.s["rest"] + text).split("\n")
        self.s["rest"] = parts.pop()
        for part in parts:
            if PAGE in part:
                self.s |= {"chars": 0, "template": "", "run": 0, "counter": -1, "counts": 0}
            self.s["chars"] += len(re.sub(r"<\|[^|]*\|>", "", part))
            self._line(part)
            if not self.s["stop"] and self.s["chars"] > self.CHARS:
                self.s["stop"] = "page-budget"
            if self.s["stop"]:
                return [("stop", self.s["stop"])]
        return []

    def finish(self) -> list[Event]:
        return self.feed("\n") if self.s["rest"] else []


class RunawayGuard(Machine):
    """Stops an answer of over four times its prompt, looked at every thousand characters from twice the prompt on."""

    START = {"prompt": 0, "chars": 0, "looked": 0, "stop": ""}

    def feed(self, text: str) -> list[Event]:
        s = self.s
        s["chars"] += len(text)
        if s["stop"] or s["chars"] < 2 * s["prompt"] or s["chars"] - s["looked"] < 1000:
            return []
        s["looked"] = s["chars"]
        if s["chars"] > 4 * s["prompt"]:
            s["stop"] = "runaway"
            return [("stop", "runaway")]
        return []


class RateLimiter(Machine):
    """Trailing window by key: an event over the limit is refused, is not counted, and is told when to come again."""

    START = {"kept": []}

    def __init__(self, state: dict | None = None, span: int = 60_000, limit: int = 10):
        super().__init__(state)
        self.span, self.limit = span, limit

    def hit(self, at: int, cost: int = 1) -> int | None:
        """None if admitted, else the wait until enough of the window has passed."""
        kept = [x for x in self.s["kept"] if x[0] > at - self.span]
        used = sum(c for _, c in kept)
        if used + cost <= self.limit:
            self.s["kept"] = [*kept, [at, cost]]
            return None
        self.s["kept"], over = kept, used + cost - self.limit
        for t, c in kept:
            over -= c
            if over <= 0:
                return self.span - (at - t)
        return self.span

    def feed(self, text: str) -> list[Event]:
        wait = self.hit(int(text))
        return [("admit", text) if wait is None else ("refuse", str(wait))]


class Grounding(Machine):
    """Page and box events of grounded markup in their order; an incomplete end is held back, up to a cap."""

    START = {"rest": "", "page": 0}
    CAP = 2048
    TOKEN = re.compile(r"<PAGE>|<\|det\|>([a-z_]+) \[(\d{1,6}), (\d{1,6}), (\d{1,6}), (\d{1,6})\]<\|/det\|>")

    def feed(self, text: str) -> list[Event]:
        rest = self.s["rest"]
        if "<" not in text and ">" not in text and (not rest or rest.startswith("<|det|>")):  # no token begins or ends here
            self.s["rest"] = rest + text if rest and len(rest) + len(text) <= self.CAP else ""
            return []
        data, out, at = rest + text, [], 0
        for m in self.TOKEN.finditer(data):
            at = m.end()
            if m[0] == PAGE:
                self.s["page"] += 1
                out.append(("page", str(self.s["page"])))
            else:
                out.append(("box", f"{self.s['page']}:{m[1]}:{m[2]},{m[3]},{m[4]},{m[5]}"))
        tail = data[at:]
        cut = tail.rfind("<|det|>")
        if cut < 0:
            cut = len(tail) - max(held_back(tail, PAGE), held_back(tail, "<|det|>"))
        self.s["rest"] = tail[cut:] if len(tail) - cut <= self.CAP else ""
        return out


class MathLines(Machine):
    """Line-buffered recovery of maths delimiters; fences are left alone, a page mark ends them."""

    START = {"rest": "", "fence": ""}

    def _line(self, line: str) -> str:
        mark = re.match(r"\s*(```|~~~)", line)
        if PAGE in line:
            self.s["fence"] = ""
        elif mark and (not self.s["fence"] or self.s["fence"] == mark[1]):
            self.s["fence"] = "" if self.s["fence"] else mark[1]
            return line
        return line if self.s["fence"] else recover_math_line(line)

    def feed(self, text: str) -> list[Event]:
        parts = (self.s["rest"] + text).split("\n")
        self.s["rest"] = parts.pop()
        return [("text", self._line(p) + "\n") for p in parts]

    def finish(self) -> list[Event]:
        rest, self.s["rest"] = self.s["rest"], ""
        return [("text", self._line(rest))] if rest else []


class Coalescer(Machine):
    """Small pieces joined to at least `least` characters."""

    START = {"rest": ""}
    LEAST = 256

    def feed(self, text: str) -> list[Event]:
        self.s["rest"] += text
        if len(self.s["rest"]) < self.LEAST:
            return []
        out, self.s["rest"] = self.s["rest"], ""
        return [("text", out)]

    def finish(self) -> list[Event]:
        out, self.s["rest"] = self.s["rest"], ""
        return [("text", out)] if out else []


class PreviewPlan(Machine):
    """What a preview renders again after each input: pages that have become complete, each once, and the tail if it has changed."""

    START = {"tail": "", "done": 0}

    def feed(self, text: str) -> list[Event]:
        *whole, tail = (self.s["tail"] + text).split(PAGE)
        out = []
        for page in whole:
            out.append(("page", page))
            self.s["done"] += 1
        held = held_back(tail, PAGE)
        if whole or text:
            out.append(("tail", tail[: len(tail) - held]))
        self.s["tail"] = tail
        return out

    def finish(self) -> list[Event]:
        return [("page", self.s["tail"])] if self.s["tail"] else []


def joined(events: list[Event]) -> str:
    """Text of events, page marks included: what must be equal however the input was cut."""
    return "".join(PAGE if kind == "page" else data for kind, data in events if kind in ("text", "page"))


Factory = Callable[[dict | None], Machine]
