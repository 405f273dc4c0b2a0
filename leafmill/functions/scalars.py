"""Small scalar rules: retries, fonts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOLD_BIT = 16


def backoff(attempt: Column, base: int = 3, most: int = 30) -> Column:
    """Seconds before the next attempt."""
    return F.least(F.lit(most), F.pow(F.lit(base), attempt)).cast("long")


def is_bold(flags: Column, name: Column) -> Column:
    return (F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(BOLD_BIT)) != 0) | F.lower(F.coalesce(name, F.lit(""))).rlike("bold|black|heavy")


def font_style(name: Column) -> Column:
    """sans before serif by parts of the name; null for neither."""
    n = F.lower(name)
    return F.when(n.rlike("sans|gothic|arial|helvet|dotum"), "sans").when(n.rlike("serif|times|roman|batang|myeongjo|mincho"), "serif")


def size_label(n: Column, units: tuple[str, ...] = ("B", "KB", "MB")) -> Column:
    """Bytes in the unit that fits, the last one for all that is larger."""
    out = F.when(n < 1024, F.concat(n, F.lit(f" {units[0]}")))
    for k, unit in enumerate(units[1:], 1):
        label = F.concat(F.format_string("%.1f", n / 1024**k), F.lit(f" {unit}"))
        out = out.otherwise(label) if k == len(units) - 1 else out.when(n < 1024 ** (k + 1), label)
    return out
