"""Blocks of lines for joins of places with the spans that hold them.

A span is listed at the level whose blocks are as long as it is, in the two at most that it reaches into; a place looks in
its block once a level. The levels go up to spans of 67 million lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES, LEVELS = 16, 12


def span_level(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.ceil(F.log(4.0, F.greatest(F.lit(1), end - start) / LINES)))).cast("int")


def span_blocks(start: Column, end: Column, level: Column) -> Column:
    """The blocks of its level that a span reaches into."""
    size = F.pow(F.lit(4.0), level) * LINES
    return F.sequence(F.floor(start / size), F.floor(end / size))


def every_level() -> Column:
    return F.explode(F.lit(list(range(LEVELS))))


def block_of(line: Column, level: Column) -> Column:
    return F.floor(line / (F.pow(F.lit(4.0), level) * LINES))
