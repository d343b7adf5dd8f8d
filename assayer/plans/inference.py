"""P-INFER and P-RESOLVE: a profile from the batch itself, and which profile to use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayer.functions.coerce import as_number, column, missing
from assayer.operators.identity import data_columns
from assayer.operators.order_stats import quantiles
from assayer.plans.bundled import bundled_profiles
from assayer.plans.profile import ColumnSpec, Profile, detect_profile
from assayer.session import settled, small_table

# Fixed values of the inference.
NULL_SLACK = 0.02
TAIL = (0.001, 0.999)
TAIL_MARGIN = 0.2
MIN_NUMBERS = 20
MAX_VOCABULARY = 20

PROFILE_SCHEMA = (
    "position int, name string, dtype string, required boolean, max_null_rate double, min double, max double, "
    "allowed_values string, outlier boolean, primary_key boolean"
)


def inferred_dtype(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.NumericType):
        return "float"
    return "string"


def _countable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def infer_profile(df: DataFrame, name: str = "uploaded_batch") -> Profile:
    """Bounds, vocabularies and a key as the batch shows them.

    A look at a few rows rules out most keys and vocabularies for certain: a value
    seen twice is never a key, a twenty-first text never a vocabulary. Exact work on
    all rows is left for the columns that pass.
    """
    names = data_columns(df)
    kinds = {c: df.schema[c].dataType for c in names}
    present = [F.count_if(~missing(column(c), kinds[c])).alias(f"n{i}") for i, c in enumerate(names)]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *present).first()
    rows = seen["rows"]
    looked = _look(df, [c for c in names if _countable(kinds[c])])

    numeric = [i for i, c in enumerate(names)
               if inferred_dtype(kinds[c]) in ("int", "float") and seen[f"n{i}"] > MIN_NUMBERS]
    numbers = df.select(*[as_number(column(names[i]), kinds[names[i]]).alias(f"v{i}") for i in numeric])
    tails = quantiles(numbers, {f"v{i}": list(TAIL) for i in numeric}, {f"v{i}": seen[f"n{i}"] for i in numeric}) if numeric else {}
    words = _vocabularies(df, [c for i, c in enumerate(names)
                               if isinstance(kinds[c], T.StringType) and seen[f"n{i}"] and looked[c][1] <= MAX_VOCABULARY])
    specs = []
    for i, c in enumerate(names):
        null_rate = 1 - seen[f"n{i}"] / rows if rows else 0.0
        low = high = None
        if i in numeric:
            low, high = tails[f"v{i}"]
            margin = TAIL_MARGIN * max(abs(high - low), 1e-9)
            low, high = low - margin, high + margin
        specs.append(ColumnSpec(
            c, inferred_dtype(kinds[c]), null_rate < 0.5, min(1.0, round(null_rate + NULL_SLACK, 4)),
            min=low, max=high, allowed_values=words.get(c), description="Inferred from the uploaded batch"))
    whole = [c for i, c in enumerate(names) if c in looked and seen[f"n{i}"] == rows and looked[c][0] == looked[c][1]]
    return Profile(
        name=name, primary_key=_first_key(df, whole), columns=tuple(specs),
        outlier_columns=tuple(names[i] for i in numeric), description="Profile inferred from the uploaded batch",
        inferred=True)


#: Rows looked at before the exact work; they only rule columns out.
LOOK_ROWS = 10_000


def _look(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """Present and distinct values per column among some rows."""
    if not names:
        return {}
    row = df.limit(LOOK_ROWS).agg(*[m.alias(f"{label}{i}") for i, c in enumerate(names) for label, m in (
        ("n", F.count(column(c))), ("d", F.size(F.collect_set(column(c)))))]).first()
    return {c: (row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(names)}


def _vocabularies(df: DataFrame, names: list[str]) -> dict[str, tuple[str, ...]]:
    """Sorted distinct texts of the columns that hold few.

    The texts of all columns become distinct in one grouping, are counted per
    column, and only those of small vocabularies are read.
    """
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("at"), column(c).cast("string").alias("word")) for i, c in enumerate(names)])
    distinct = settled(df.select(F.explode(cells).alias("c")).select("c.*").filter("word IS NOT NULL").distinct())
    small = [r["at"] for r in distinct.groupBy("at").count().filter(F.col("count") <= MAX_VOCABULARY).collect()]
    found: dict[str, list[str]] = {}
    for at, word in distinct.filter(F.col("at").isin(*small)).collect() if small else ():
        found.setdefault(names[at], []).append(word)
    return {c: tuple(sorted(words)) for c, words in found.items()}


def _first_key(df: DataFrame, candidates: list[str]) -> tuple[str, ...]:
    """The first column without repeats among those without gaps."""
    for c in candidates:
        if df.groupBy(column(c)).count().filter("count > 1").isEmpty():
            return (c,)
    return ()


def profile_table(spark: SparkSession, profile: Profile) -> DataFrame:
    """A profile as rows, one per column."""
    rows = [
        (i, c.name, c.dtype, c.required, float(c.max_null_rate), c.min, c.max,
         None if c.allowed_values is None else ",".join(c.allowed_values),
         c.name in profile.outlier_columns, c.name in profile.primary_key)
        for i, c in enumerate(profile.columns)
    ]
    return small_table(spark, rows, PROFILE_SCHEMA)


def resolve_profile(
    df: DataFrame, profile: Profile | None = None, name: str = "uploaded_batch",
    registered: list[Profile] | None = None,
) -> tuple[Profile, list[str]]:
    """The given profile, else a registered one that fits, else an inferred one; with notes."""
    if profile is not None:
        return profile, []
    notes = []
    try:
        found = detect_profile(df, bundled_profiles() if registered is None else registered)
    except Exception as error:  # a broken registered profile must not block an audit
        found = None
        notes.append(f"Registered profiles could not be used: {error}")
    if found is not None:
        return found, notes
    notes.append("No curated profile matched this batch, so expectations were inferred from the data itself. "
                 "That detects internal inconsistency, not incorrectness.")
    return infer_profile(df, name), notes
