"""Profiles that ship with the package. Fixed values throughout: names, bounds, patterns, weights."""

from __future__ import annotations

from assayer.plans.profile import ColumnSpec as C, CrossRule as R, Profile

CURRENCIES = ("EUR", "USD", "GBP", "MXN")
UNITS = ("EA", "KG", "L", "M", "BOX")
PLANTS = ("1000", "1100", "2000", "3000")


def creditcard() -> Profile:
    parts = [C(f"V{i}", "float", min=-100.0, max=100.0) for i in range(1, 29)]
    return Profile(
        name="creditcard_transactions",
        outlier_columns=("Amount",),
        outlier_cut=5.0,
        weights={"completeness": 0.30, "validity": 0.30, "consistency": 0.10, "uniqueness": 0.15,
                 "plausibility": 0.15},
        columns=(C("Time", "float", min=0.0), *parts, C("Amount", "float", min=0.0, weight=2.0),
                 C("Class", "int", required=False, max_null_rate=1.0, min=0.0, max=1.0)),
    )


def materials() -> Profile:
    return Profile(
        name="erp_materials",
        primary_key=("material_id",),
        outlier_columns=("standard_price", "safety_stock"),
        columns=(
            C("material_id", regex="MAT-[0-9]{6}", unique=True, weight=2.0),
            C("description", regex="[A-Z0-9][A-Z0-9 /.-]*[A-Z0-9]", weight=1.5),
            C("material_group"),
            C("base_uom", allowed_values=UNITS),
            C("standard_price", "float", min=0.01, weight=1.5),
            C("currency", allowed_values=CURRENCIES),
            C("plant", allowed_values=PLANTS),
            C("safety_stock", "int", min=0),
            C("is_active", "bool"),
            C("created_at", "datetime", max_date="today"),
        ),
    )


def vendors() -> Profile:
    return Profile(
        name="erp_vendors",
        primary_key=("vendor_id",),
        columns=(
            C("vendor_id", regex="VEN-[0-9]{5}", unique=True, weight=2.0),
            C("vendor_name", weight=1.5),
            C("country_code", regex="[A-Z]{2}"),
            C("tax_id"),
            C("payment_terms", allowed_values=("NET30", "NET45", "NET60", "IMMEDIATE"), weight=1.5),
            C("currency", allowed_values=CURRENCIES),
            C("is_blocked", "bool"),
            C("created_at", "datetime", max_date="today"),
        ),
    )


def purchase_orders() -> Profile:
    return Profile(
        name="erp_purchase_orders",
        primary_key=("po_id",),
        outlier_columns=("total_net_value",),
        outlier_cut=4.5,
        columns=(
            C("po_id", regex="PO-[0-9]{10}", unique=True, weight=2.0),
            C("vendor_id", regex="VEN-[0-9]{5}", weight=1.5),
            C("order_date", "datetime", min_date="2020-01-01", max_date="today", weight=1.5),
            C("delivery_date", "datetime", min_date="2020-01-01"),
            C("currency", allowed_values=CURRENCIES),
            C("plant", allowed_values=PLANTS),
            C("created_by"),
            C("status", allowed_values=("OPEN", "PARTIAL", "CLOSED", "CANCELLED")),
            C("total_net_value", "float", min=0.0),
        ),
        rules=(
            R("delivery_date_after_order_date", "expression", "Delivery date must not precede the order date",
              expression="delivery_date >= order_date"),
            R("vendor_id_exists_in_vendor_master", "foreign_key", "Every order must reference an existing vendor",
              0.95, column="vendor_id", ref_table="vendors", ref_column="vendor_id"),
        ),
    )


def po_lines() -> Profile:
    return Profile(
        name="erp_po_lines",
        primary_key=("po_line_id",),
        outlier_columns=("quantity", "unit_price", "net_value"),
        columns=(
            C("po_line_id", regex="POL-[0-9]{7}", unique=True, weight=2.0),
            C("po_id", regex="PO-[0-9]{10}", weight=2.0),
            C("position", "int", min=10),
            C("material_id", regex="MAT-[0-9]{6}", weight=1.5),
            C("quantity", "float", min=0.01, weight=2.0),
            C("uom", allowed_values=UNITS),
            C("unit_price", "float", min=0.01, weight=2.0),
            C("net_value", "float", min=0.0, weight=1.5),
            C("currency", allowed_values=CURRENCIES),
            C("delivery_date", "datetime", min_date="2022-01-01"),
            C("goods_receipt_qty", "float", min=0.0),
            C("invoice_qty", "float", min=0.0),
        ),
        rules=(
            R("net_value_matches_quantity_times_price", "expression",
              "Net value must equal ordered quantity times unit price", 0.85,
              expression="abs(net_value - quantity * unit_price) <= 0.01 + 0.005 * abs(net_value)"),
            R("receipt_not_greater_than_order", "expression",
              "Goods receipt cannot exceed the ordered quantity", 0.7,
              expression="goods_receipt_qty <= quantity + 0.01"),
            R("invoice_not_greater_than_receipt", "expression",
              "Invoiced quantity cannot exceed what was actually received", 0.75,
              expression="invoice_qty <= goods_receipt_qty + 0.01"),
            R("material_id_exists_in_material_master", "foreign_key",
              "Every line must reference a material that exists in the master", 0.95,
              column="material_id", ref_table="materials", ref_column="material_id"),
            R("po_id_exists_in_purchase_orders", "foreign_key",
              "Every line must belong to an existing purchase order header", 0.95,
              column="po_id", ref_table="purchase_orders", ref_column="po_id"),
            R("uom_matches_material_master", "lookup_match",
              "Line unit of measure must match the material master base unit", 0.7,
              column="uom", local_key="material_id", ref_table="materials", ref_key="material_id",
              ref_column="base_uom"),
        ),
    )


def bundled_profiles() -> list[Profile]:
    """All profiles, in the order in which ties are settled."""
    return [creditcard(), materials(), po_lines(), purchase_orders(), vendors()]
