import pytest
from pyspark.sql import functions as F

from assayer.operators.identity import FILE_ROWS, numbered_table
from assayer.operators.quality import QualityRun
from assayer.plans.profile import ColumnSpec as C, Profile
from assayer.session import drop_settled, settled
from assayer.sources.tables import (
    Contract, checked_contract, kind_of, most_recent, read_contracted, read_reference_dir, read_table, write_recent_sample,
    write_tables,
)


def test_kinds():
    assert [kind_of(p) for p in ("a.parquet", "a.PQ", "a.csv", "a")] == ["parquet", "parquet", "csv", "csv"]


def test_csv_types_and_missing_texts(spark, tmp_path):
    (tmp_path / "t.csv").write_text('i,f,b,s,m\n1,1.5,true,x,NA\n2,2,false,"1.234,00",null\n,nan,true,y,\n')
    df = read_table(spark, str(tmp_path / "t.csv"), position=True)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "m": "string",
                               "__position": "bigint"}
    assert [r["m"] for r in df.collect()] == [None] * 3
    assert [r["f"] for r in df.collect()] == [1.5, 2.0, None]
    raw = read_table(spark, str(tmp_path / "t.csv"), typed=False)
    assert set(t for _, t in raw.dtypes) == {"string"}


def test_positions_survive_repartitioning_and_pruning(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(1000).withColumn("v", F.col("id") * 2).repartition(3).write.parquet(path)
    df = read_table(spark, path, position=True)
    one = {r["id"]: r["__position"] for r in df.select("id", "__position").collect()}
    two = {r["id"]: r["__position"] for r in df.repartition(5).filter("v > 100").select("id", "__position").collect()}
    assert len(set(one.values())) == 1000 and all(one[k] == p for k, p in two.items())
    run = QualityRun(df, Profile("t", columns=(C("v", "int", min=10),)))
    assert run.findings().filter(F.col("row_key").rlike("^part.*:[0-9]+$")).count() == 5


LAYOUTS = ((128 << 20, 1), (6_000, 1), (6_000, 23), (1_000, 5))  # split size, least number of splits (by default the parallelism)


@pytest.fixture
def layouts(spark):
    def each():
        for size, least in LAYOUTS:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.minPartitionNum", str(least))
            yield size, least
    yield each
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_csv_numbers_do_not_follow_the_splits(spark, tmp_path, layouts):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for name, first, n in (("b.csv", 1000, 700), ("a.csv", 0, 1000), ("c.csv", 1700, 0), ("d.csv", 1700, 300)):
        (folder / name).write_text("i,text\n" + "".join(f"{i},row {i} {'x' * (i % 40)}\n" for i in range(first, first + n)))
    want = {**{i: i for i in range(1000)}, **{1000 + i: FILE_ROWS + i for i in range(700)}}
    splits = set()
    for _ in layouts():
        df = read_table(spark, str(folder), "csv", position=True)
        got = {r["i"]: r["__position"] for r in df.select("i", "__position").collect()}
        assert {i: p for i, p in got.items() if i < 1700} == want
        assert [got[i] - got[1700] for i in range(1700, 2000)] == list(range(300))
        splits.add(spark.read.csv(str(folder)).rdd.getNumPartitions())
    assert len(splits) > 1


def test_written_numbers_do_not_follow_the_splits(spark, layouts):
    written = settled(spark.range(20_000).selectExpr("id", "repeat(string(id), 20) AS text").repartition(3))
    seen, splits = [], set()
    for _ in layouts():
        again = spark.read.parquet(*written.inputFiles())
        splits.add(again.rdd.getNumPartitions())
        seen.append({r["id"]: r["__position"] for r in numbered_table(again).select("id", "__position").collect()})
    assert len(splits) > 1 and all(s == seen[0] for s in seen) and len(set(seen[0].values())) == 20_000


def test_reference_dir_and_tables(spark, tmp_path):
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "vendors.csv").write_text("vendor_id\nV1\nV2\n")
    (tmp_path / "refs" / "notes.txt").write_text("x")
    refs = read_reference_dir(spark, str(tmp_path / "refs"))
    assert list(refs) == ["vendors"] and refs["vendors"].count() == 2
    write_tables(refs, str(tmp_path / "out"))
    write_tables(refs, str(tmp_path / "out"), "parquet")
    assert read_table(spark, str(tmp_path / "out/vendors.csv")).count() == 2
    assert read_table(spark, str(tmp_path / "out/vendors.parquet")).columns == ["vendor_id"]


def test_contract(spark, tmp_path):
    df = spark.createDataFrame([("'0'",), ("'1'",), ("'0'",)], "Class string")
    assert [r["Class"] for r in checked_contract(df, Contract(3, 1, "Class", 1)).collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        checked_contract(df, Contract(3, 1, "Class", 2))
    df.write.parquet(str(tmp_path / "c.parquet"))
    assert read_contracted(spark, str(tmp_path / "c.parquet"), Contract(3, 1, "Class", 1)).count() == 3


def test_recent(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([3.0, 9.0, 9.0, 1.0])], "id bigint, Time double")
    assert [r["id"] for r in most_recent(df, "Time", 2, "id").collect()] == [2, 1]
    write_recent_sample(df, str(tmp_path / "r"), "Time", 3, "id")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3


def test_settled_tables_can_be_dropped(spark):
    df = settled(spark.range(10).withColumn("v", F.rand()))
    assert df.collect() == df.collect()
    path = df.inputFiles()[0]
    other = settled(spark.range(3))
    assert other.count() == 3
    import os
    from urllib.parse import urlparse
    drop_settled(spark)
    assert not os.path.exists(urlparse(path).path)


def test_positions_are_unique_across_partition_folders(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    rows = spark.range(20).select((F.col("id") % 5).alias("a"), F.lit(1).alias("b"), (F.col("id") % 2).alias("half"))
    rows.coalesce(1).write.partitionBy("half").parquet(path)
    df = read_table(spark, path, position=True)
    assert df.select("__position").distinct().count() == 20
    run = QualityRun(df, Profile("t", columns=(C("a", "int"),)))
    assert run.findings().count() == 10  # one of each two equal rows
