import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pyspark.sql import functions as F  # noqa: E402

from assayer.plans.profile import ColumnSpec as C, CrossRule as R, Profile  # noqa: E402
from assayer.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "assayer-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """40 clean rows: key, category, quantity, unit price, total."""
    return spark.range(40).select(
        F.format_string("R-%03d", F.col("id") + 1).alias("row_id"),
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("id") % 4 + 1).cast("int")).alias("category"),
        (F.col("id") + 1).cast("double").alias("quantity"),
        F.lit(2.0).alias("unit_price"),
        ((F.col("id") + 1) * 2).cast("double").alias("total"),
        F.col("id").alias("__position"))


@pytest.fixture(scope="session")
def tiny_profile():
    return Profile(
        "tiny", primary_key=("row_id",), outlier_columns=("quantity",),
        columns=(C("row_id", unique=True), C("category", allowed_values=("A", "B", "C", "D")),
                 C("quantity", "float", min=0.5), C("unit_price", "float", min=0.01), C("total", "float", min=0.0)),
        rules=(R("total_matches", "expression", "total is quantity times price",
                 expression="abs(total - quantity * unit_price) <= 0.01"),))


@pytest.fixture(scope="session")
def erp(spark):
    """A small, consistent purchasing extract."""
    units = F.array(*[F.lit(u) for u in ("EA", "KG", "L", "M", "BOX")])

    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))

    i = F.col("id")
    day = F.lit("2023-01-01").cast("timestamp")
    vendors = spark.range(60).select(
        F.format_string("VEN-%05d", i).alias("vendor_id"), F.concat(F.lit("Vendor "), i).alias("vendor_name"),
        pick(("DE", "ES", "MX"), i).alias("country_code"), F.concat(F.lit("T"), i).alias("tax_id"),
        pick(("NET30", "NET45", "NET60", "IMMEDIATE"), i).alias("payment_terms"),
        pick(("EUR", "USD", "GBP", "MXN"), i).alias("currency"), (i % 7 == 0).alias("is_blocked"),
        day.alias("created_at"))
    materials = spark.range(300).select(
        F.format_string("MAT-%06d", i).alias("material_id"), F.concat(F.lit("STEEL PIPE "), i).alias("description"),
        pick(("PIPES", "VALVES"), i).alias("material_group"), F.element_at(units, (i % 5 + 1).cast("int")).alias("base_uom"),
        (F.lit(5.0) + i % 50).alias("standard_price"), F.lit("EUR").alias("currency"),
        pick(("1000", "1100", "2000", "3000"), i).alias("plant"), (i % 90).alias("safety_stock"),
        F.lit(True).alias("is_active"), day.alias("created_at"))
    lines = spark.range(1500).select(
        F.format_string("POL-%07d", i).alias("po_line_id"), F.format_string("PO-%010d", F.floor(i / 5)).alias("po_id"),
        ((i % 5 + 1) * 10).alias("position"), F.format_string("MAT-%06d", i % 300).alias("material_id"),
        (i % 40 + 1).cast("double").alias("quantity"), F.element_at(units, (i % 300 % 5 + 1).cast("int")).alias("uom"),
        (F.lit(5.0) + i % 300 % 50).alias("unit_price"), F.lit("EUR").alias("currency"),
        (day + F.make_dt_interval(days=(i % 90 + 20).cast("int"))).alias("delivery_date"))
    lines = lines.withColumn("net_value", F.col("quantity") * F.col("unit_price")).withColumn(
        "goods_receipt_qty", F.col("quantity")).withColumn("invoice_qty", F.col("quantity"))
    totals = lines.groupBy("po_id").agg(F.round(F.sum("net_value"), 2).alias("total_net_value"))
    orders = spark.range(300).select(
        F.format_string("PO-%010d", i).alias("po_id"), F.format_string("VEN-%05d", i % 60).alias("vendor_id"),
        (day + F.make_dt_interval(days=(i % 90).cast("int"))).alias("order_date"),
        (day + F.make_dt_interval(days=(i % 90 + 12).cast("int"))).alias("delivery_date"),
        F.lit("EUR").alias("currency"), F.lit("1000").alias("plant"), F.lit("buyer").alias("created_by"),
        pick(("OPEN", "PARTIAL", "CLOSED", "CANCELLED"), i).alias("status")).join(totals, "po_id")
    return {"vendors": vendors, "materials": materials, "purchase_orders": orders, "po_lines": lines}
