"""Reading batches and reference tables, and writing tables: IO-READ, IO-REFDIR, IO-CONTRACT, IO-RECENT, IO-TABLES."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from assayer.functions.coerce import FALSE_TEXT, NUMBER_TEXT, TRUE_TEXT, as_flag, as_number, column
from assayer.operators.identity import FILE_ROWS, POSITION
from assayer.session import settled

# Texts that count as missing in a CSV file.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def kind_of(path: str) -> str:
    return "parquet" if PurePosixPath(path).suffix.lower() in (".parquet", ".pq") else "csv"


def read_table(
    spark: SparkSession, path: str, kind: str | None = None, position: bool = False, typed: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """A parquet or CSV batch; anything without a parquet suffix is read as CSV.

    ``position`` adds the row position that findings and sample keys are ordered
    by. ``typed`` turns CSV columns into numbers or booleans where all values fit.
    ``multi_line`` reads quoted line breaks, at the price of one task per CSV file.
    """
    if (kind or kind_of(path)) == "parquet":
        df = spark.read.parquet(path)
        if position:
            df = df.select("*", F.struct(F.col("_metadata.file_name").alias("file"),
                                         F.col("_metadata.row_index").alias("row"),
                                         # names repeat across partition folders
                                         F.col("_metadata.file_path").alias("path")).alias(POSITION))
        return df
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    named = [F.when(~column(c).isin(*MISSING_TEXTS), column(c)).alias(c) for c in raw.columns]
    df = _lines_numbered(raw, named) if position else raw.select(*named)
    return _typed(df) if typed else df


def _lines_numbered(raw: DataFrame, named: list[Column]) -> DataFrame:
    """Rows of text files with their number: the file's place among the paths, then the row within the file.

    Text has no row index, only the offset of the block that a row was read from. Rows are written once
    with that offset and a number that rises within the block; a block's rows follow those of
    the blocks before it in its file. So the numbers do not depend on how the files were cut.
    """
    kept = settled(raw.select(*named, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                              F.monotonically_increasing_id().alias("__read")))
    blocks = kept.groupBy("__file", "__block").agg(F.min("__read").alias("__first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.select("__file").distinct().withColumn("__place", F.row_number().over(Window.orderBy("__file")) - 1)  # a row per file
    starts = settled(blocks.join(files, "__file").select(
        "__file", "__block", (F.col("__place") * FILE_ROWS + F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")))
    return kept.join(starts, ["__file", "__block"]).select(
        *[column(c) for c in raw.columns], (F.col("__read") + F.col("__shift")).cast("bigint").alias(POSITION))


def _typed(raw: DataFrame) -> DataFrame:
    """One scan decides the type of every text column."""
    whole = r"^\s*[+-]?\d{1,18}\s*$"
    tests = []
    names = [c for c in raw.columns if c != POSITION]
    for i, c in enumerate(names):
        value = column(c)
        tests += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(whole)).alias(f"i{i}"),
            F.count_if(value.rlike(NUMBER_TEXT)).alias(f"f{i}"),
            F.count_if(F.lower(value).isin(TRUE_TEXT[0], FALSE_TEXT[0])).alias(f"b{i}"),
        ]
    seen = raw.agg(*tests).first()
    text = T.StringType()
    out = []
    for i, c in enumerate(names):
        n, value = seen[f"n{i}"], column(c)
        if n and seen[f"i{i}"] == n:
            value = F.trim(value).cast("bigint")
        elif n and seen[f"f{i}"] == n:
            value = as_number(value, text)
        elif n and seen[f"b{i}"] == n:
            value = as_flag(value, text)
        out.append(value.alias(c))
    return raw.select(*out, *[c for c in raw.columns if c == POSITION])


def read_reference_dir(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV file of a folder as a reference table named by its stem."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().toString() for f in files if f.getPath().getName().endswith(".csv"))
    return {PurePosixPath(n).stem: read_table(spark, n, "csv", position=True) for n in names}


@dataclass(frozen=True)
class Contract:
    """What a labelled source must contain."""

    rows: int
    columns: int
    label: str
    positives: int


# The labelled card transactions.
CREDITCARD = Contract(rows=284_807, columns=31, label="Class", positives=492)


def read_contracted(spark: SparkSession, path: str, contract: Contract = CREDITCARD) -> DataFrame:
    """Read a labelled source and refuse it when its size or its positives are off."""
    df = read_table(spark, path, position=True)
    return checked_contract(df, contract)


def checked_contract(df: DataFrame, contract: Contract) -> DataFrame:
    df = df.withColumn(contract.label, F.regexp_replace(column(contract.label).cast("string"), "['\"]", "").cast("int"))
    width = len([c for c in df.columns if c != POSITION])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(column(contract.label)).alias("p")).first()
    found = (row["n"], width, row["p"])
    expected = (contract.rows, contract.columns, contract.positives)
    if found != expected:
        raise ValueError(f"expected (rows, columns, positives) {expected}, found {found}")
    return df


def most_recent(df: DataFrame, time: str, n: int = 20_000, tie: str = POSITION) -> DataFrame:
    """The n latest rows; of equal times the later rows."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def write_recent_sample(df: DataFrame, path: str, time: str, n: int = 20_000, tie: str = POSITION) -> None:
    sample = most_recent(df, time, n, tie)
    sample.drop(POSITION).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """One folder per table."""
    for name, df in tables.items():
        writer = df.drop(POSITION).write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(f"{folder}/{name}.csv")
        else:
            writer.parquet(f"{folder}/{name}.parquet")
