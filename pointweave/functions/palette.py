"""Colours for numbers: ramps through a few stops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Stops = list[tuple[float, tuple[int, int, int]]]
#: Stops of the two ramps: one whose neighbours are easy to tell apart, and one from dark to light.
SEGMENTS: Stops = [(0.0, (20, 30, 120)), (0.2, (0, 170, 230)), (0.4, (20, 170, 60)), (0.6, (240, 220, 40)), (0.8, (230, 90, 20)), (1.0, (150, 20, 110))]
HEAT: Stops = [(0.0, (0, 0, 10)), (0.35, (100, 20, 110)), (0.7, (230, 90, 40)), (1.0, (250, 250, 170))]


def ramp(value: Column, stops: Stops) -> list[Column]:
    """Red, green and blue (whole numbers) of a value of [0, 1], linear between stops; others have those of the ends, null
    has null."""
    out = []
    for c in range(3):
        # from the last piece to the first
        at = F.lit(float(stops[-1][1][c]))
        for (low, a), (high, b) in reversed(list(zip(stops, stops[1:]))):
            at = F.when(value < high, a[c] + (F.greatest(value, F.lit(low)) - low) / (high - low) * (b[c] - a[c])).otherwise(at)
        out.append(F.when(value.isNotNull(), F.rint(at)).cast("int"))
    return out


def labels(label: Column, count: Column | int, stops: Stops = SEGMENTS) -> list[Column]:
    """The colour of a label from 0 to count - 1, evenly along the ramp."""
    return ramp(label / F.greatest(F.lit(count) - 1 if isinstance(count, int) else count - 1, F.lit(1)), stops)
