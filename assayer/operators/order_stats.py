"""Exact quantiles and ranks without sorting the table.

A sketch brackets each wanted rank, a second aggregate counts what lies below and
inside the bracket, and the next round looks only inside. Each round keeps well
under a thousandth of the values, whatever the skew: a value repeated a billion
times is one bracket end and is answered by its count. Bands that are small by
count are read together in one job, without a shuffle. A small table begins with such
bands, so it takes one job; answers and interpolation are the same at every size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Values that one job may bring to the driver.
DRIVER_VALUES = 1_000_000
_SKETCH = 10_000
_MARGIN = 3.0 / _SKETCH


@dataclass
class _Search:
    """One wanted rank (0-based, ascending) of one column."""

    source: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    margin: float = _MARGIN
    answer: float | None = None
    bracket: tuple[float, float] | None = field(default=None)

    @property
    def limits(self) -> tuple:
        return self.source, self.low, self.high

    def band(self) -> Column:
        """The column's value where it lies strictly inside the current limits."""
        value = F.col(self.source)
        keep = value.isNotNull()
        if self.low is not None:
            keep = keep & (value > self.low)
        if self.high is not None:
            keep = keep & (value < self.high)
        return F.when(keep, value)


def _by_band(searches: list[_Search]) -> list[list[_Search]]:
    """Searches that look at the same values of the same column."""
    bands: dict[tuple, list[_Search]] = {}
    for s in searches:
        bands.setdefault(s.limits, []).append(s)
    return list(bands.values())


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """One round for all open searches: two shared scans, one sketch per band."""
    bands = _by_band(searches)
    sketches = []
    for i, band in enumerate(bands):
        middles = [((s.rank - s.below + 0.5) / s.inside, s.margin) for s in band]
        at = [x for m, margin in middles for x in (max(0.0, m - margin), min(1.0, m + margin))]
        sketches.append(F.percentile_approx(band[0].band(), at, _SKETCH).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    for i, band in enumerate(bands):
        for j, s in enumerate(band):
            s.bracket = (row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1])
    counts = []
    for i, s in enumerate(searches):
        low, high = s.bracket
        band = s.band()
        for name, hit in (("a", band < low), ("b", band == low), ("c", (band > low) & (band < high)),
                          ("d", (band == high) & F.lit(high > low))):
            counts.append(F.count_if(hit).alias(f"{name}{i}"))
    row = df.agg(*counts).first()
    for i, s in enumerate(searches):
        low, high = s.bracket
        under, at_low, between, at_high = (row[f"{n}{i}"] for n in "abcd")
        offset = s.rank - s.below
        if offset < under:
            s.high, s.inside, s.margin = low, under, s.margin * 4
        elif offset < under + at_low:
            s.answer = low
        elif offset < under + at_low + between:
            s.below, s.inside = s.below + under + at_low, between
            s.low, s.high = low, high
        elif offset < under + at_low + between + at_high:
            s.answer = high
        else:
            passed = under + at_low + between + at_high
            s.below, s.inside, s.low, s.margin = s.below + passed, s.inside - passed, high, s.margin * 4


def _readable(searches: list[_Search], driver_values: int) -> list[_Search]:
    """The searches whose bands together are small enough to be read."""
    chosen, room = [], driver_values
    for band in sorted(_by_band(searches), key=lambda b: b[0].inside):
        room -= band[0].inside
        if room < 0:
            break
        chosen += band
    return chosen


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Read the values of small bands, in one job for all columns of a type, as Arrow batches."""
    kinds: dict[str, list[list[_Search]]] = {}
    for band in _by_band(searches):
        kinds.setdefault(df.schema[band[0].source].dataType.simpleString(), []).append(band)
    for bands in kinds.values():
        cells = F.array(*[F.struct(F.lit(i).alias("band"), b[0].band().alias("v")) for i, b in enumerate(bands)])
        read = df.select(F.explode(cells).alias("c")).select("c.*").filter("v IS NOT NULL").toArrow()
        for i, band in enumerate(bands):
            values = read.filter(pc.equal(read["band"], i))["v"]
            if len(values) != band[0].inside:
                raise RuntimeError("the table changed while its ranks were being read")
            order = pc.sort_indices(values)  # NaN comes last, as in Spark
            for s in band:
                s.answer = _as_collected(values[order[s.rank - s.below].as_py()].as_py())


def _as_collected(value):
    """Times as ``collect`` gives them: local and without a zone."""
    zoned = isinstance(value, datetime) and value.tzinfo is not None
    return value.astimezone().replace(tzinfo=None) if zoned else value


def ranked_values(
    df: DataFrame, wanted: list[tuple[str, int, int]], driver_values: int = DRIVER_VALUES
) -> list[float | int | None]:
    """Values at 0-based ascending ranks; ``wanted`` holds (column, rank, non-null count)."""
    searches = [_Search(name, rank, 0, count) for name, rank, count in wanted]
    todo = [s for s in searches if 0 <= s.rank < s.inside]
    while todo:
        small = _readable(todo, driver_values)
        if small:
            _finish(df, small)
            todo = [s for s in todo if s.answer is None]
        if todo:
            _narrow(df, todo)
            todo = [s for s in todo if s.answer is None]
    return [s.answer for s in searches]


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    counts: dict[str, int] | None = None,
    driver_values: int = DRIVER_VALUES,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, for several columns at once."""
    names = list(wanted)
    if not names:
        return {}
    if counts is None:
        row = df.agg(*[F.count(F.col(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
        counts = {n: row[i] for i, n in enumerate(names)}
    requests, shape = [], []
    for n in names:
        for p in wanted[n]:
            at = p * (counts[n] - 1)
            shape.append((n, at - math.floor(at)))
            requests += [(n, math.floor(at), counts[n]), (n, math.ceil(at), counts[n])]
    values = ranked_values(df, requests, driver_values)
    result: dict[str, list[float | None]] = {n: [] for n in names}
    for (n, part), low, high in zip(shape, values[::2], values[1::2]):
        if low is None or low == high:
            result[n].append(None if low is None else float(low))
        else:
            result[n].append(float(low) + (float(high) - float(low)) * part)
    return result
