"""Thresholds by preset."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import PADDING_US, PRESETS


@dataclass(frozen=True)
class Settings:
    """Gap and total thresholds of each category, in microseconds, and the padding around frames."""

    gaps: dict[str, int]
    totals: dict[str, int]
    padding_us: int = PADDING_US

    @property
    def longest(self) -> int:
        return max(self.totals.values())

    def gap(self, category: Column) -> Column:
        """The gap of a row's category."""
        out = F.lit(None).cast("bigint")
        for c, us in self.gaps.items():
            out = F.when(category == c, F.lit(us).cast("bigint")).otherwise(out)
        return out


def preset(name: str | None = None) -> Settings:
    """A preset by name; by default the one that CAPTURE_PRECISION names, else ``accurate``. An unknown name is an error."""
    name = name or os.environ.get("CAPTURE_PRECISION", "accurate")
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}")
    return Settings({c: g for c, (g, _) in PRESETS[name].items()}, {c: t for c, (_, t) in PRESETS[name].items()})
