"""Rectangle algebra on integer or double columns; a box is a struct x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 999


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0)) * F.greatest(height(b), F.lit(0))


def overlap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))


def overlap_y(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def center_inside(a: Column, b: Column, slack: int = 0) -> Column:
    """Whether the centre of a lies in b; doubled, so integers stay exact."""
    cx, cy = a["x0"] + a["x1"], a["y0"] + a["y1"]
    return cx.between(2 * (b["x0"] - slack), 2 * (b["x1"] + slack)) & cy.between(2 * (b["y0"] - slack), 2 * (b["y1"] + slack))


def clamped(b: Column, limit: int = SPACE) -> Column:
    """Within 0..limit with ordered corners; null if it has no area."""
    at = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(limit))
    out = box(*(at(f(b[p], b[q])) for f, p, q in ((F.least, "x0", "x1"), (F.least, "y0", "y1"), (F.greatest, "x0", "x1"), (F.greatest, "y0", "y1"))))
    return F.when((out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)


def to_pixels(v: Column, size: Column) -> Column:
    return F.floor(v * size / SPACE)


def to_page(v: Column, crop: Column, pad: int, origin: Column, page: Column) -> Column:
    """A coordinate of a padded crop in the page's space, rounded and clamped."""
    return F.least(F.greatest(F.round((v / SPACE * crop - pad + origin) / page * SPACE), F.lit(0)), F.lit(SPACE)).cast("long")


def minus(a: Column, hole: Column) -> Column:
    """The parts of a outside hole: at most four strips, above, below, left and right."""
    top, bottom = F.greatest(a["y0"], hole["y0"]), F.least(a["y1"], hole["y1"])
    strips = F.array(
        box(a["x0"], a["y0"], a["x1"], top), box(a["x0"], bottom, a["x1"], a["y1"]),
        box(a["x0"], top, F.greatest(a["x0"], hole["x0"]), bottom), box(F.least(a["x1"], hole["x1"]), top, a["x1"], bottom),
    )
    return F.when(overlap(a, hole) > 0, F.filter(strips, lambda s: (s["x1"] > s["x0"]) & (s["y1"] > s["y0"]))).otherwise(F.array(a))


def font_size(b: Column, content: Column, aspect: float) -> Column:
    """Font size in hundredths of the page's width, from the area that a block gives to its characters.

    ASCII counts half, East Asian wide characters one, others 0.65; null under a weight of one."""
    text = F.trim(F.regexp_replace(F.regexp_replace(content, "<[^>]*>", " "), r"\s+", " "))
    n = F.length(text)
    ascii_ = F.regexp_count(text, F.lit(r"[\x00-\x7F]"))
    wide = F.regexp_count(text, F.lit(r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]"))
    weight = ascii_ * 0.5 + wide * 1.0 + (n - ascii_ - wide) * 0.65
    w, h = width(b) / SPACE * 100, height(b) / SPACE * 100 * aspect
    size = F.least(F.sqrt(w * h / (1.2 * weight)), h / 1.25)
    return F.when((weight >= 1) & (w > 0) & (h > 0), F.least(F.greatest(size, F.lit(0.8)), F.lit(3.6)))
