"""Rendezvous shards against a plain version, with nulls, repeated rows, hot keys, empty tables, clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from harness import compare, duck

from assayer.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def plain(key, weights):
    bids = []
    for s, w in enumerate(weights):
        digest = hashlib.md5((str(s) + ("" if key is None else f":{key}")).encode()).hexdigest()
        bids.append((-math.log((int(digest[:13], 16) + 0.5) / 2 ** 52) / w, s))
    return min(bids)[1]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x", 0.5, "y") for d, t in rows],
                                 "doc_id long, text string, shard int, slot int, size string, bid double, read string")


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (None, "ü" * 5), (None, None), (2, ""), (3, "x" * 300_000)] + [(7, "same")] * 500
    weights = [1.0, 2.5, 0.5, 4.0]
    got = sharding.assignment(frame(spark, rows), weights, grown=1.5).collect()
    want = Counter()
    for d, t in rows:
        body = (t or "").encode()
        want[(d, len(body) + 8, zlib.crc32(body), plain(d, weights), plain(d, weights + [1.5]))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    for s in {r.shard for r in got}:
        mine = sorted((r.slot, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert sharding.assignment(frame(spark, []), weights).count() == 0


def test_weights_and_growth(spark):
    weights = [1.0, 3.0, 2.0]
    keys = spark.range(30_000).selectExpr("id AS doc_id", "'t' AS text")
    at = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.with_shard(keys, weights, grown=2.0).collect()}
    share = Counter(s for s, _ in at.values())
    assert all(abs(share[i] / 30_000 - w / 6) < 0.015 for i, w in enumerate(weights))
    moved = [g for s, g in at.values() if g != s]
    assert set(moved) == {3} and abs(len(moved) / 30_000 - 0.25) < 0.015
    with pytest.raises(ValueError):
        sharding.with_shard(keys, [1.0, 0.0])


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write(docs, [1.0] * 5, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert all(r.shard == plain(r.doc_id, [1.0] * 5) for r in back.collect())


def test_query_against_sql(spark):
    assert compare(queries.op13_sharding(spark, SF), duck(SF), queries.ORACLES["op13_sharding"]) == []
