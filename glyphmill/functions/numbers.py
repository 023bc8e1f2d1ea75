"""Ratios, bands and rounding of the score rules. Null means "could not be looked at" and is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
LEVELS = [(0.0, "Opaco"), (25.0, "Legible"), (50.0, "Interpretable"), (75.0, "Operable")]
PROPS_BANDS = [(0.0, 0.0), (0.3, 10.0), (0.5, 14.0), (0.7, 17.0), (0.9, 20.0)]
COMPONENT_BANDS = [(0.0, 0.0), (0.3, 10.0), (0.5, 20.0), (0.7, 25.0), (0.9, 30.0)]
CODE_BANDS = [(0.0, 0.0), (0.3, 7.0), (0.5, 12.0), (0.7, 16.0), (0.9, 20.0)]
LIVE_BANDS = [(0.0, 0.0), (1e-07, 5.0), (0.3, 10.0), (0.7, 15.0)]
ACCESS_POINTS = {
    "documentation_recoverability": (15.0, {"NOT_RECOVERABLE": 0.0, "PARTIAL": 7.5, "MOSTLY_RECOVERABLE": 12.0, "FULLY_RECOVERABLE": 15.0}),
    "component_index": (20.0, {"NONE": 0.0, "PARTIAL": 10.0, "MOSTLY": 15.0, "COMPLETE": 20.0}),
    "props_types_accessibility": (20.0, {"NAMES_ONLY": 0.0, "PARTIAL": 10.0, "PROPS_AND_TYPES": 15.0, "PROPS_TYPES_AND_VALUES": 20.0}),
    "structured_tokens": (15.0, {"NOT_RECOVERABLE": 0.0, "PARTIAL": 8.0, "COMPLETE": 15.0}),
    "types_or_schema": (10.0, {"NONE": 0.0, "PARTIAL": 5.0, "COMPLETE": 10.0}),
    "agent_manifest": (10.0, {"NONE": 0.0, "PARTIAL": 5.0, "COMPLETE": 10.0}),
    "agent_interface": (10.0, {"NONE": 0.0, "PRESENT": 10.0}),
}
WEIGHTS = {"D1": 0.20, "D2": 0.15, "D3": 0.20, "D4": 0.25, "D5": 0.10, "D6": 0.10}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def as_of_band(x: Column, bands: list[tuple[float, object]]) -> Column:
    """The value of the last band whose start is at most x; below all of them the first; null for null or NaN."""
    out = F.lit(bands[0][1])
    for start, value in bands:
        out = F.when(x >= start, value).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), out)


def band_points(key: Column, points: dict[str, float]) -> Column:
    """Points of an enumerated value; null for an unknown one."""
    out = F.lit(None).cast("double")
    for name, value in points.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round5(x: Column) -> Column:
    """To the nearest multiple of 5, halves up."""
    return F.floor(x / 5 + 0.5) * 5.0


def readiness(x: Column) -> Column:
    return as_of_band(x, LEVELS)


def recoverability(share: Column) -> Column:
    return F.when(share >= 0.9, "FULLY_RECOVERABLE").when(share >= 0.5, "MOSTLY_RECOVERABLE").when(share > 0, "PARTIAL").when(share.isNotNull(), "NOT_RECOVERABLE")
