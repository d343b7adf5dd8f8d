"""Model features: A-FEAT, A-SCALE, A-SPLIT, A-NORMALS, A-RANDOM."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.coerce import as_number, column
from assayer.functions.hashing import uniform
from assayer.operators.identity import POSITION, ROW_KEY
from assayer.operators.order_stats import ranked_values

FEATURES = "features"
# The anonymous components of the card schema, in model order.
COMPONENTS = tuple(f"V{i}" for i in range(1, 29))
CARD_COLUMNS = ("Time", "Amount", *COMPONENTS)


def card_features() -> dict[str, Column]:
    """31 features: the components, log amount, and the hour of day on a circle."""
    hour = F.pmod(column("Time").cast("double") / 3600.0, F.lit(24.0))
    angle = hour * (2 * math.pi / 24.0)
    return {
        **{c: column(c).cast("double") for c in COMPONENTS},
        "log_amount": F.log1p(F.greatest(column("Amount").cast("double"), F.lit(0.0))),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def plain_features(df: DataFrame, names: list[str]) -> dict[str, Column]:
    return {n: as_number(column(n), df.schema[n].dataType) for n in names}


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of each feature, fitted on the training rows only."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, features: dict[str, Column]) -> "Scaler":
        row = df.agg(*[
            agg.alias(f"{label}{i}") for i, c in enumerate(features.values())
            for label, agg in (("m", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
        deviations = [row[f"s{i}"] for i in range(len(features))]
        return Scaler(tuple(features), tuple(row[f"m{i}"] or 0.0 for i in range(len(features))),
                      tuple(s if s else 1.0 for s in deviations))

    def transform(self, df: DataFrame, features: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
        """Add the standardised feature array; keeps identity columns and those asked for."""
        if set(features) != set(self.names):
            raise ValueError("the scaler was fitted on other features")
        values = F.array(*[((features[n] - m) / s).cast("float")
                           for n, m, s in zip(self.names, self.means, self.deviations)])
        carried = [c for c in (POSITION, ROW_KEY) if c in df.columns] + (keep or [])
        return df.select(*[column(c) for c in carried], values.alias(FEATURES))


def temporal_split(
    df: DataFrame, time: str, tie: str, shares: tuple[float, float] = (0.6, 0.2),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, calibration and test windows in time order, cut at exact row counts.

    The two cuts are found as ranks of ``time`` and, within an equal time, of the
    unique number ``tie``; the windows are then plain filters, so nothing is sorted
    or moved.
    """
    rows = df.count()
    first, second = int(rows * shares[0]), int(rows * (shares[0] + shares[1]))
    before_first, before_second = _before(df, time, tie, [first, second], rows)
    return (df.filter(before_first), df.filter(~before_first & before_second), df.filter(~before_second))


def _before(df: DataFrame, time: str, tie: str, ranks: list[int], rows: int) -> list[Column]:
    """For each rank a condition that holds for exactly the rows ordered before it."""
    kind = df.schema[time].dataType.typeName()
    dated = kind in ("timestamp", "timestamp_ntz", "date")
    moment = F.unix_micros(column(time).cast("timestamp")) if dated else column(time)
    inner = [r for r in ranks if 0 < r < rows]
    timed = df.select(moment.alias("t"), column(tie).alias("k"))
    cuts = dict(zip(inner, ranked_values(timed, [("t", r, rows) for r in inner])))
    counted = timed.agg(*[
        F.count_if(test).alias(f"{label}{r}") for r, cut in cuts.items()
        for label, test in (("b", F.col("t") < cut), ("e", F.col("t") == cut))]).first() if cuts else None
    tied = timed.select(*[F.when(F.col("t") == cut, F.col("k")).alias(f"k{r}") for r, cut in cuts.items()])
    inside = [r for r in cuts if r - counted[f"b{r}"] > 0]
    ties = dict(zip(inside, ranked_values(
        tied, [(f"k{r}", r - counted[f"b{r}"], counted[f"e{r}"]) for r in inside])))
    conditions = []
    for r in ranks:
        if r not in cuts:
            conditions.append(F.lit(r >= rows and r > 0))
            continue
        test = moment < F.lit(cuts[r])
        if r in ties:
            test = test | ((moment == F.lit(cuts[r])) & (column(tie) < F.lit(ties[r])))
        conditions.append(test)
    return conditions


def normals(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(column(label) == 0)


def random_scores(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """A floor for comparisons: scores drawn from the key."""
    return df.withColumn("score", uniform(key, "random", seed))
