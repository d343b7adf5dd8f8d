"""The given tables seen as audit batches: views, profiles and defect families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.hashing import uniform
from assayer.operators.defects import DefectSpec
from assayer.plans.profile import ColumnSpec as C, CrossRule as R, Profile
from assayer.session import spread
from assayer.sources.tables import read_table

TODAY = "2003-01-01"
SEED = 1337
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FREE_SEGMENTS = ("auto", "Bldg.", "furnitures", "house hold", "machine")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
KEYS = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey"}


def table(spark: SparkSession, folder: str, name: str, position: bool = False) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", "parquet", position)


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a due date, a net price of half the total, and the customer's segment copied in."""
    orders, customer = spread(table(spark, folder, "orders")), table(spark, folder, "customer")
    wide = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
    return wide.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 30 + 1).cast("int"))).alias("o_duedate"),
        (F.col("o_totalprice") * 0.5).alias("o_netprice"),
        F.col("c_mktsegment").alias("o_segment"))


def dirty_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers with small shares of every kind of violation, drawn from the key."""
    df = order_headers(spark, folder)

    def hit(label: str, rate: float):
        return uniform(F.col("o_orderkey"), label) < rate

    price = F.col("o_totalprice")
    df = df.select(
        "o_orderkey",
        F.when(hit("fk", 0.004), F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(hit("cat", 0.02), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(hit("null", 0.012), F.lit(None).cast("string"))
        .when(hit("type", 0.005), F.translate(F.format_number(price, 2), ",.", ".,"))
        .when(hit("neg", 0.004), (-price).cast("string")).otherwise(price.cast("string")).alias("o_totalprice"),
        F.when(hit("future", 0.002), F.col("o_orderdate") + F.make_dt_interval(days=F.lit(4000)))
        .otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(hit("enc", 0.01), F.concat("o_orderpriority", F.lit("   "))).otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.when(hit("late", 0.007), F.col("o_orderdate") - F.make_dt_interval(days=F.lit(5)))
        .otherwise(F.col("o_duedate")).alias("o_duedate"),
        F.when(hit("net", 0.009), F.col("o_netprice") * 1.25).otherwise(F.col("o_netprice")).alias("o_netprice"),
        F.when(hit("seg", 0.008), F.lit("UNKNOWN")).otherwise(F.col("o_segment")).alias("o_segment"))
    # a few rows come twice; one pass over the join makes both
    copies = F.when(hit("dup", 0.005), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(copies).alias("__copy")).drop("__copy")


HEADERS = Profile(
    name="orders",
    primary_key=("o_orderkey",),
    outlier_columns=("o_totalprice", "o_netprice"),
    columns=(
        C("o_orderkey", "int", unique=True, weight=2.0),
        C("o_custkey", "int"),
        C("o_orderstatus", allowed_values=("F", "O", "P")),
        C("o_totalprice", "float", min=0.01, max_null_rate=0.01, weight=2.0),
        C("o_orderdate", "datetime", min_date="1990-01-01", max_date="today", weight=1.5),
        C("o_orderpriority", regex="[1-5]-[A-Z ]*[A-Z]"),
        C("o_duedate", "datetime", min_date="1990-01-01"),
        C("o_netprice", "float", min=0.0),
        C("o_segment", allowed_values=SEGMENTS),
        C("o_clerk", required=False, weight=0.5),
    ),
    rules=(
        R("due_after_order", "expression", "Due date must not precede the order date", 0.8,
          expression="o_duedate >= o_orderdate"),
        R("net_is_half_of_total", "expression", "Net price must be half of the total price", 0.85,
          expression="abs(o_netprice - o_totalprice * 0.5) <= 0.01"),
        R("customer_exists", "foreign_key", "Every order must reference an existing customer", 0.95,
          column="o_custkey", ref_table="customer", ref_column="c_custkey"),
        R("segment_matches_customer", "lookup_match", "Order segment must match the customer master", 0.7,
          column="o_segment", local_key="o_custkey", ref_table="customer", ref_key="c_custkey",
          ref_column="c_mktsegment"),
    ),
)
PARTS = Profile(
    name="part",
    primary_key=("p_partkey",),
    outlier_columns=("p_retailprice",),
    columns=(
        C("p_partkey", "int", unique=True, weight=2.0),
        C("p_name", regex="[a-z][a-z ]*[a-z]", weight=1.5),
        C("p_brand", regex="Brand#[0-9]+"),
        C("p_type", allowed_values=PART_TYPES),
        C("p_size", "int", min=1, max=50),
        C("p_retailprice", "float", min=0.01, weight=1.5),
    ),
)
CUSTOMERS = Profile(
    name="customer",
    primary_key=("c_custkey",),
    columns=(
        C("c_custkey", "int", unique=True, weight=2.0),
        C("c_name", regex="Customer#[0-9]{9}", weight=1.5),
        C("c_acctbal", "float"),
        C("c_mktsegment", allowed_values=SEGMENTS, weight=1.5),
    ),
)
PROFILES = {"orders": HEADERS, "part": PARTS, "customer": CUSTOMERS}
LINEITEM = Profile(
    name="lineitem",
    primary_key=("l_orderkey", "l_linenumber"),
    columns=(
        C("l_orderkey", "int", weight=2.0), C("l_partkey", "int", weight=1.5), C("l_suppkey", "int"),
        C("l_linenumber", "int", min=1, max=7), C("l_quantity", "float", min=1, max=50, weight=2.0),
        C("l_extendedprice", "float", min=0.01, weight=2.0), C("l_discount", "float", min=0, max=0.1),
        C("l_tax", "float", min=0, max=0.08), C("l_returnflag", allowed_values=("A", "N", "R")),
        C("l_linestatus", allowed_values=("F", "O")),
        C("l_shipdate", "datetime", min_date="1992-01-01", max_date="2001-06-30"),
    ),
    rules=(
        R("order_exists", "foreign_key", "Every line must belong to an order", 0.95,
          column="l_orderkey", ref_table="orders", ref_column="o_orderkey"),
        R("part_exists", "foreign_key", "Every line must reference a part", 0.95,
          column="l_partkey", ref_table="part", ref_column="p_partkey"),
    ),
)
SPECS = (
    DefectSpec("MISSING_CRITICAL", "orders", "o_totalprice", 0.012, "completeness"),
    DefectSpec("MISSING_OPTIONAL", "customer", "c_acctbal", 0.030, "completeness"),
    DefectSpec("TYPE_MISMATCH", "orders", "o_totalprice", 0.005, "validity"),
    DefectSpec("NEGATIVE_QUANTITY", "orders", "o_totalprice", 0.004, "validity"),
    DefectSpec("ZERO_PRICE", "orders", "o_totalprice", 0.006, "validity"),
    DefectSpec("OUT_OF_RANGE_PRICE", "part", "p_retailprice", 0.003, "plausibility"),
    DefectSpec("INVALID_CATEGORY", "customer", "c_mktsegment", 0.020, "validity", pool=FREE_SEGMENTS),
    DefectSpec("INVALID_UOM", "orders", "o_segment", 0.008, "consistency", pool=SEGMENTS),
    DefectSpec("DUPLICATE_ROW", "orders", None, 0.005, "uniqueness"),
    DefectSpec("BROKEN_FK", "orders", "o_custkey", 0.004, "consistency"),
    DefectSpec("ARITHMETIC_INCONSISTENCY", "orders", "o_netprice", 0.009, "consistency"),
    DefectSpec("DATE_ORDER_VIOLATION", "orders", "o_duedate", 0.007, "consistency", base="o_orderdate"),
    DefectSpec("FUTURE_DATE", "orders", "o_orderdate", 0.002, "validity"),
    DefectSpec("ENCODING_NOISE", "part", "p_name", 0.010, "validity"),
)


def clean_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"orders": order_headers(spark, folder), "part": table(spark, folder, "part"),
            "customer": table(spark, folder, "customer")}


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A ranking task: does a high price predict an urgent order?"""
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("score"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents scored by their length."""
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    return labels.join(documents, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


def card_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings in the shape of card transactions."""
    df = table(spark, folder, "embeddings", position=True)
    return df.select(
        "vec_id", (F.col("vec_id") * 61.0).alias("Time"),
        *[F.col("embedding")[i - 1].cast("double").alias(f"V{i}") for i in range(1, 29)],
        (F.abs(F.col("embedding")[28].cast("double")) * 100).alias("Amount"),
        (F.col("label") == 0).cast("int").alias("Class"), "__position")
