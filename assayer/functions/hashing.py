"""Seeded, order-free randomness: the same row gets the same draw on any cluster layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DRAW_RANGE = float(2**52)


def draw(*parts: Column | str | int) -> Column:
    """A 52-bit integer from the md5 of the parts; exact in a double."""
    return F.conv(F.substring(_digest(*parts), 1, 13), 16, 10).cast("bigint")


def _digest(*parts: Column | str | int) -> Column:
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *columns))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1)."""
    return draw(*parts) / F.lit(DRAW_RANGE)


def drawn_below(share: float, *parts: Column | str | int) -> Column:
    """``uniform(*parts) < share`` without turning digits into a number: hex digits of one length sort like what they stand for."""
    limit = min(max(0, math.ceil(share * DRAW_RANGE)), int(DRAW_RANGE))
    return _digest(*parts) < F.lit("g" if limit == DRAW_RANGE else f"{limit:013x}")
