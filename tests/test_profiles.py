import json

import pytest
from pyspark.sql import functions as F

from assayer.functions.predicates import PredicateError
from assayer.operators.features import COMPONENTS
from assayer.plans.bundled import bundled_profiles, po_lines
from assayer.plans.inference import infer_profile, resolve_profile
from assayer.plans.profile import ColumnSpec as C, CrossRule as R, Profile, ProfileError, detect_profile, load_profile


@pytest.mark.parametrize("make", [
    lambda: C("a", "decimal"), lambda: C("a", weight=0), lambda: R("r", "expression"),
    lambda: R("r", "foreign_key", column="a", ref_table="t"),
    lambda: R("r", "lookup_match", column="a", ref_table="t", ref_column="b"),
    lambda: R("r", "expression", expression="a > 1", impact=1.5), lambda: R("r", "join"),
    lambda: Profile("p", weights={"beauty": 1.0})])
def test_malformed_profiles(make):
    with pytest.raises(ProfileError):
        make()


def test_load_profile(spark, tmp_path):
    raw = {"name": "t", "primary_key": ["a"], "columns": [{"name": "a", "dtype": "int", "min": 1}],
           "cross_field_rules": [{"id": "r", "kind": "expression", "description": "", "expression": "a > 0"}],
           "dimension_weights": {"validity": 1.0}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(raw))
    profile = load_profile(path)
    assert profile.columns[0].min == 1.0 and profile.weights == {"validity": 1.0} and profile.rules[0].id == "r"
    raw["cross_field_rules"][0]["expression"] = "a > b"
    path.write_text(json.dumps(raw))
    with pytest.raises(PredicateError):
        load_profile(path)
    path.write_text(json.dumps({"name": "t", "colums": []}))
    with pytest.raises(ProfileError):
        load_profile(path)


def test_load_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "t.yaml"
    path.write_text("name: t\ncolumns:\n  - name: a\n    allowed_values: [1, 2]\n")
    assert load_profile(path).columns[0].allowed_values == ("1", "2")


def test_bundled_profiles_compile(spark):
    profiles = [p.checked() for p in bundled_profiles()]
    assert len(profiles) == 5 and len(profiles[0].columns) == 31


def test_detection(spark, erp):
    assert detect_profile(erp["po_lines"], bundled_profiles()).name == "erp_po_lines"
    assert detect_profile(erp["po_lines"].drop("quantity", "uom"), bundled_profiles()) is None
    optional = Profile("optional", columns=(C("a", required=False),))
    assert detect_profile(spark.range(1), [optional]) is None
    first, second = Profile("first", columns=(C("id"),)), Profile("second", columns=(C("id"),))
    assert detect_profile(spark.range(1), [first, second]).name == "first"
    card = spark.range(1).select(*[F.lit(0.0).alias(c) for c in ("Time", "Amount", *COMPONENTS)])
    assert detect_profile(card, bundled_profiles()).name == "creditcard_transactions"


def test_inference(spark):
    df = spark.range(200).select(
        (F.col("id") % 10).alias("bucket"), F.concat(F.lit("T"), "id").alias("ticket"),
        F.when(F.col("id") % 4 > 0, F.col("id") * 1.5).alias("amount_local"),
        F.when(F.col("id") % 2 == 0, "web").otherwise("branch").alias("channel"))
    profile = infer_profile(df)
    columns = {c.name: c for c in profile.columns}
    assert profile.inferred and profile.primary_key == ("ticket",)
    assert profile.outlier_columns == ("bucket", "amount_local")
    assert columns["channel"].allowed_values == ("branch", "web") and columns["ticket"].allowed_values is None
    assert columns["amount_local"].max_null_rate == pytest.approx(0.27) and columns["amount_local"].required
    low, high = df.select(F.percentile("amount_local", F.array(F.lit(0.001), F.lit(0.999)))).first()[0]
    assert columns["amount_local"].min == pytest.approx(low - 0.2 * (high - low))
    assert [c.dtype for c in profile.columns] == ["int", "string", "float", "string"]


def test_resolution(spark, erp):
    given = po_lines()
    assert resolve_profile(erp["po_lines"], given) == (given, [])
    assert resolve_profile(erp["vendors"])[0].name == "erp_vendors"
    profile, notes = resolve_profile(spark.range(30), name="mine")
    assert profile.name == "mine" and profile.inferred and "inferred" in notes[0]
    _, notes = resolve_profile(spark.range(30), registered=[None])
    assert "could not be used" in notes[0]


@pytest.mark.parametrize("words, repeat, key", [(20, False, ("k",)), (21, False, ("k",)), (20, True, ("j",)), (21, True, ("j",))])
def test_inference_is_exact_at_the_limits(spark, monkeypatch, words, repeat, key):
    """The word or repeat that decides comes in the last row, which no look at the first rows sees."""
    from assayer.plans import inference
    monkeypatch.setattr(inference, "LOOK_ROWS", 50)
    last = 399
    rows = [(i if not (repeat and i == last) else 0, f"key {i}", f"w{min(i % 20, 19)}" if i < last or words == 20 else "new", None if i < 390 else "x",
             float(i // 2), i == 0) for i in range(last + 1)]
    df = spark.createDataFrame(rows, "k int, j string, w string, rare string, half double, flag boolean").coalesce(1)
    profile = infer_profile(df)
    spec = {c.name: c for c in profile.columns}
    assert spec["w"].allowed_values == (tuple(sorted(f"w{i}" for i in range(20))) if words == 20 else None)
    assert spec["rare"].allowed_values == ("x",) and spec["j"].allowed_values is None
    assert profile.primary_key == key


def test_inference_of_odd_columns(spark):
    df = spark.createDataFrame([(0.0, {"a": 1}, [1]), (-0.0, None, [1]), (float("nan"), None, None)], "z double, m map<string,int>, a array<int>")
    profile = infer_profile(df)
    assert profile.primary_key == () and [c.dtype for c in profile.columns] == ["float", "string", "string"]
    assert infer_profile(spark.range(0)).primary_key == ("id",)  # nothing repeats
