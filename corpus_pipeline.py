"""A corpus from raw documents: toxic ones, near copies and leaked benchmark text go, personal data is masked, sources are mixed.

A document is a row with an id, null or not, and a text. Stages read the columns of ``documents`` by name and return them alone, so others, whatever
their names, are not in the way. Null texts have no words: they are scored, kept apart, never contaminated, left as they are, and mixed with size 0.
Texts of any length are read whole. An empty table gives an empty one from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import decontaminate, mixture, near_duplicates, personal, toxicity
from assayer.session import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is toxic from this score on.
TOXIC = 0.5


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; a model is fitted on the labelled ones. Without a usable label nothing is known to be toxic, and all stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    places, _, bias = model
    if not len(places) and bias == 0.0:
        return docs.select(*COLUMNS)
    scored = toxicity.score(docs.withColumn("__doc_id", F.col("doc_id")), model, keep=["__doc_id", "text", "lang", "source", "n_chars"])
    return scored.where(F.col("score") < TOXIC).select(F.col("__doc_id").alias("doc_id"), *COLUMNS[1:])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word shingles of five, similarity of 0.8): the one with the smallest id, null ids last.

    Rows are told apart by id and text, so an id with several texts is several documents, and rows without an id are judged too. Of rows with the
    same id and text the least by the other columns stays. Documents without words are no copies of each other.
    """
    keyed = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = near_duplicates.near_duplicates(keyed.select("__key", "text"), key="__key")
    named = found.select(F.col("doc_id").alias("__key"), "component_id").distinct().join(keyed.select("__key", "doc_id").distinct(), "__key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")).alias("first"))
    stay = keyed.join(first.select("first.__key"), "__key", "left_semi")
    single = stay.groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return single.select("row.*").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs. Rows are told apart by id and text, so null ids are judged too."""
    keyed = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__key")
    leaked = found.where(F.size("hit_words") > 0).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(leaked, "__key", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars counted anew."""
    found = personal.masked(docs.select(*COLUMNS), personal.learn(docs))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per slot of a shard with the text of its block, the pieces of documents in it, and its source's size and target."""
    return mixture.packed(docs)


STAGES = [("toxicity", clean_of_toxicity), ("near_duplicates", one_of_each_group), ("decontamination", without_benchmark),
          ("personal_data", without_personal_data), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages train models and compare documents in ways that SQL can't express; tests hold run() against plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
