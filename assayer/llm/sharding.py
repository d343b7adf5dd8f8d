"""Shards by rendezvous hashing: each record goes to the shard that bids least for its key.

A shard's bid for a key is -ln(u) / weight, with u in (0, 1) from the first 52 bits of md5("shard:key"); the least bid wins, of equal
bids the smaller shard number. Bids are exponential draws with the weights as rates, so a shard wins its share of the weights, and
adding a shard changes only the records for which the new one bids least: all others stay where they are.

Nothing is known of a record but its key, so a shard is found without a shuffle; slots number a shard's records by key, size and checksum over
range slices with offsets, so neither a shard nor a key with a third of all rows lies in one task. Only DataFrame functions are used.

Null keys are one key, told apart from every text. Null texts have no bytes and checksum 0. Records with one key share its shard, however many
they are, each with a slot of its own; which of two equal records has which slot is not defined. Texts of any length are read in place, an empty table
gives an empty one, and columns other than key and text are neither read nor in the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.running import running_totals

#: Bytes of a record beside its text.
RECORD_BYTES = 8
_BITS = 52


def bid(key: Column, shard: Column, weight: Column) -> Column:
    """What ``shard`` bids for a key (text, null allowed)."""
    name = F.concat(shard.cast("string"), F.coalesce(F.concat(F.lit(":"), key), F.lit("")))
    draw = F.conv(F.substring(F.md5(name), 1, _BITS // 4), 16, 10).cast("double")
    return -F.log((draw + 0.5) / F.lit(2.0 ** _BITS)) / weight


def with_shard(df: DataFrame, weights: Sequence[float], key: str = "doc_id", grown: float | None = None) -> DataFrame:
    """``df`` with the column ``shard``, and ``grown_shard`` if a shard of weight ``grown`` were added; columns of these names are replaced."""
    if not weights or min(weights) <= 0 or (grown is not None and grown <= 0):
        raise ValueError("every shard needs a weight above zero")
    text = F.col(key).cast("string")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    best = F.array_min(F.transform(shards, lambda s: F.struct(bid(text, s["shard"], s["weight"]).alias("bid"), s["shard"].alias("shard"))))
    found = df.drop("shard", "grown_shard").withColumn("__best", best)
    out = found.withColumn("shard", F.col("__best.shard"))
    if grown is not None:
        more = bid(text, F.lit(len(weights)), F.lit(float(grown)))
        out = out.withColumn("grown_shard", F.when(more < F.col("__best.bid"), len(weights)).otherwise(F.col("__best.shard")))
    return out.drop("__best")


def assignment(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: float | None = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), a row per record; slots of a shard have no gaps and start at 0."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    records = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
                        F.crc32(body).alias("text_crc32"))
    # read positions only split records that are equal in all that is returned, so they don't show in the result
    dealt = with_shard(records, weights, grown=grown).withColumn("one", F.lit(1).cast("long")).withColumn("read", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("doc_id", "size", "text_crc32", "read")]
    numbered = running_totals(dealt, order, ["one"], ["shard"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("cum_one") - 1).alias("slot"),
                           *(["grown_shard"] if grown is not None else []))


def write(df: DataFrame, weights: Sequence[float], folder: str, key: str = "doc_id", files: int = 8) -> None:
    """Whole records as Parquet, a folder ``shard=N`` for each shard of ``files`` files, dealt by content so that no key fills one."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    with_shard(df, weights, key).repartition(len(weights) * files, "shard", salt).write.partitionBy("shard").parquet(folder)
