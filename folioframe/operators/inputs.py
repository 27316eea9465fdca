"""Sizes that pages and images get before a model sees them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 32  # the text detector's sides are multiples of it
LIMIT = 960  # its longest side


def _near(x: Column) -> Column:
    """Rounded half away from zero; sizes are not negative."""
    return F.floor(x + 0.5).cast("int")


def render_size(width: Column, height: Column, dpi: int) -> tuple[Column, Column]:
    """Pixels of a page whose sides are given in points."""
    return _near(width * dpi / 72), _near(height * dpi / 72)


def detection_size(width: Column, height: Column, limit: int = LIMIT) -> tuple[Column, Column]:
    """An image for text detection: shrunk to the limit, each side then to the nearest multiple of STEP, at least one."""
    longest = F.greatest(width, height)
    ratio = F.when(longest > limit, F.lit(float(limit)) / longest).otherwise(1.0)
    snap = lambda side: F.greatest(F.lit(STEP), _near(_near(side * ratio) / STEP) * STEP)
    return snap(width), snap(height)


def table_size(width: Column, height: Column, shortest: int = 800, longest: int = 1000) -> tuple[Column, Column]:
    """An image for table models: as large as the shorter and the longer side's bounds allow (detection: 800 and 800)."""
    scale = F.least(F.lit(float(shortest)) / F.least(width, height), F.lit(float(longest)) / F.greatest(width, height))
    return F.greatest(F.lit(1), _near(width * scale)), F.greatest(F.lit(1), _near(height * scale))
