"""Seasonal terms of the calendar month."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HARMONICS = 6


def harmonic_names(harmonics: int) -> list[str]:
    """Names of the seasonal columns for ``harmonics`` harmonics.

    ``sin6`` is left out: the sine of a whole multiple of pi is zero in every month, and
    what floating point leaves of it is noise that scaling would blow up.
    """
    return [
        f"{wave}{h}_month"
        for h in range(1, harmonics + 1)
        for wave in ("sin", "cos")
        if (wave, h) != ("sin", 6)
    ]


def harmonic(name: str, date: str) -> Column:
    """The seasonal column called ``name`` at the calendar month of ``date``."""
    wave, h = name[:3], int(name[3 : name.index("_")])
    return F.expr(f"{wave}(month({date}) * {h * 2 * math.pi / 12!r}D)")


def with_harmonics(df: DataFrame, harmonics: int, *, date: str = "month_end") -> DataFrame:
    """Add ``sin{h}_month`` and ``cos{h}_month`` for h = 1..``harmonics``."""
    return df.withColumns({name: harmonic(name, date) for name in harmonic_names(harmonics)})
