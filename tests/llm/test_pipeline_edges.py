"""Every pipeline stage on nulls in any column, empty and very long texts, repeated rows and ids, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
EXTRA = ("row", "score", "label", "words", "class", "taken", "component_id", "__x")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 900}" for i in range(40_000))
    base = " ".join(f"plain{i}" for i in range(60))
    rows = [(1, base, "en", "a"), (2, base + " more", None, "a"), (2, "an entirely different text under an id that came before", "en", None),
            (3, None, None, None), (4, "", "en", "b"), (None, base, "en", "b"), (None, None, None, None), (5, long, "en", "b"), (6, " \n ", "en", "b"),
            (7, "call +1 555 123 4567 or write to someone@mail.example.org today", "en", "a"), (7, "call +1 555 123 4567 or write to someone@mail.example.org today", "en", "a")]
    df = spark.createDataFrame([(d, t, g, s, None if t is None else len(t)) for d, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in EXTRA])


def run(spark, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, SF)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, odd, name):
    out = run(spark, name, odd.limit(0))
    assert out.count() == 0
    if name != "mixing":
        assert out.columns == list(corpus_pipeline.COLUMNS)


def test_toxicity(spark, odd):
    toxic = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    docs = toxic.select(*corpus_pipeline.COLUMNS, *[F.lit("clash").alias(c) for c in EXTRA]).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10 ** 6))
    out = run(spark, "toxicity", docs)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    left = [r for r in out.collect() if r.doc_id is None or r.doc_id >= 10 ** 6]
    assert len(left) == odd.count()  # none of the odd rows is toxic


def test_toxicity_without_labels(spark, odd, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.clean_of_toxicity(spark, odd, str(tmp_path))
    assert rows(out) == rows(odd.select(*corpus_pipeline.COLUMNS))


def test_near_duplicates(spark, odd):
    out = run(spark, "near_duplicates", odd)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    kept = [(r.doc_id, None if r.text is None else r.text[:20]) for r in out.collect()]
    want = [(1, "plain0 plain1 plain2"), (2, "an entirely differen"), (3, None), (4, ""), (None, None), (5, "w0 w1 w2 w3 w4 w5 w6"), (6, " \n "),
            (7, "call +1 555 123 4567")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_decontamination(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()
    leak = odd.limit(1).withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.lit("before " + bench.text + " after"))
    out = run(spark, "decontamination", odd.unionByName(leak))
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert rows(out) == rows(odd.select(*corpus_pipeline.COLUMNS))


def test_personal_data(spark, odd):
    out = run(spark, "personal_data", odd)
    assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() == odd.count()
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[7][0] == "call [phone] or write to [email] today" and texts[7][1] == len(texts[7][0])
    assert texts[3] == (None, None) and texts[4] == ("", 0) and texts[5][1] == len(texts[5][0])


def test_mixing(spark, odd):
    out = run(spark, "mixing", odd)
    got = out.collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.taken
        target = r.target
        assert r.taken == r["size"] == len(r.text.split()) and target > 0
    assert set(sizes) <= {"a", "b", None}
    for source, total in sizes.items():
        target = next(r.target for r in got if r.source == source)
        assert abs(total - target) <= 64
