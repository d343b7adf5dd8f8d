"""Mixing sources to target weights from packed blocks.

1. Each source's words are laid end to end in the order of document ids and packed into blocks of ``block`` words; the last one may be short.
2. Targets share ``share`` times all words by weight; a source stops at ``cap`` times its size and the excess is shared again.
3. A source's target becomes a quota of slots. A pseudorandom permutation of all slots deals them to output shards, so the
   counts of sources in a shard are a multinomial draw, conditioned on the quotas: they add up to the targets exactly.
4. Slot ``j`` of a source takes the block at the image of ``j mod blocks`` under a pseudorandom permutation of the source's block
   indices, another one in each round through the blocks, so no block is taken more than ``cap`` times.
5. Blocks are joined to slots by (source, index), and documents to blocks by the words that they share.
6. For the mixed text each document is cut at the bounds of blocks, the cuts of a block are put together in the order of the source's
   words, and every slot gets the text of its block: once for each time it is drawn, and only the words that the block has of a document.

Permutations are four-round Feistel networks with cycle walking, seeded by a parameter: reruns agree, on any layout. A null
source is a source of its own, after all others. Documents without words take part with size 0. A null id comes first
in its source. Rows with equal id and text are interchangeable.

Texts of any length are read whole, an empty table gives an empty one, and columns other than key, text and source are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm.frames import map_batches
from assayer.llm.words import mix, words
from assayer.operators.running import running_totals
from assayer.session import settled

BLOCK = 64
SHARD_SLOTS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
_U = np.uint64


def permuted(x: np.ndarray, n: int | np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """Image of each x under the permutation of 0..n-1 that ``key`` selects."""
    n = np.broadcast_to(np.asarray(n, np.int64), x.shape)
    key = np.broadcast_to(np.asarray(key, np.int64), x.shape).view(_U) if np.ndim(key) else np.full(x.shape, key, np.int64).view(_U)
    bits = np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64)
    half = ((bits + 1) // 2).astype(_U)
    mask = (_U(1) << half) - _U(1)

    def once(v, half, mask, key):
        left, right = v >> half, v & mask
        for turn in range(4):
            left, right = right, left ^ (mix(right + key + _U(turn * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        return (left << half) | right

    out = once(x.astype(_U), half, mask, key)
    while True:
        out_of = np.flatnonzero(out >= n.astype(_U))
        if not len(out_of):
            return out.view(np.int64)
        out[out_of] = once(out[out_of], half[out_of], mask[out_of], key[out_of])


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, mark, source, size): mark is a hash of the text."""
    def count(b: pa.RecordBatch):
        for w in words(b.column("text")):
            r = slice(w.row, w.row + w.texts)
            yield pa.RecordBatch.from_arrays([b.column(c)[r] for c in ("doc_id", "mark", "source")]
                                             + [pa.array(w.counts.astype(np.int64))], ["doc_id", "mark", "source", "size"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"),
                       F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, count, "doc_id long, mark long, source string, size long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, number, source_size, target), one row per source.

    Sources stop in the order of size to weight. With the first k stopped, the others share what is left by weight; k is the least number for
    which no other source is above its limit. The windows below run over one row per source.
    """
    every = Window.orderBy("number")
    stops = Window.orderBy("ratio", "number")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
              .withColumn("weight", F.get(cycle, (F.col("number") % len(weights)).cast("int")))
              .withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight")))
    whole = Window.partitionBy()
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    level = ((share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level if this source is the first that doesn't stop; the first source that can bear its level ends the search
    leveled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(whole)["level"]
    return (leveled.withColumn("final", F.coalesce(final, F.lit(float("inf"))))
            .select("source", "number", "source_size", F.least("limit", F.col("weight") * F.col("final")).alias("target")))


def _slots(plan: DataFrame, seed: int, block: int, shard_slots: int) -> DataFrame:
    """(number, index, shard, place): one row per slot."""
    step = 1 << 16

    def deal(b: pa.RecordBatch):
        for number, blocks, quota, start, total, low in zip(*[b.column(c).to_pylist() for c in
                                                              ("number", "blocks", "quota", "start", "total", "low")]):
            j = np.arange(low, min(low + step, quota))
            place = permuted(start + j, total, seed)
            key = mix(np.full(len(j), number, _U) + _U(seed)) + (j // blocks).astype(_U)
            index = permuted(j % blocks, blocks, mix(key).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), number)), pa.array(index),
                                              pa.array(place // shard_slots), pa.array(place % shard_slots)],
                                             ["number", "index", "shard", "place"])

    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    runs = (plan.where("quota > 0").withColumn("start", F.coalesce(F.sum("quota").over(before), F.lit(0).cast("long")))
            .withColumn("total", F.sum("quota").over(Window.partitionBy()))
            .withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(step).cast("long"))))
            .select("number", "blocks", "quota", "start", "total", "low"))
    return map_batches(runs.repartition("number", "low"), deal, "number long, index long, shard long, place long")


def _laid(docs: DataFrame, key: str, text: str, source: str, weights: tuple, share: float, cap: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(plan, documents): a row per source with its blocks and quota of slots, and the documents as ``mixture`` returns them."""
    sizes = settled(sized(docs, key, text, source))
    plan = targets(sizes, weights, share, cap)
    blocks = F.ceil(F.col("source_size") / block)
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round((F.col("target") - rounds * F.col("source_size")) / (F.col("source_size") / blocks))
    plan = settled(plan.withColumn("blocks", blocks).withColumn(
        "quota", F.when(F.col("source_size") > 0, rounds * blocks + rest).otherwise(0).cast("long")))
    named = (sizes.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
             .join(plan.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"),
                               "number", "source_size", "target"), ["none", "name"]).drop("none", "name"))
    named = settled(named.withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    placed = running_totals(named, [F.col("order"), F.col("mark")], ["size"], ["number"])
    return plan, settled(placed.drop("order").withColumnRenamed("cum_size", "until"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
            share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS,
            seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).

    pieces: shard, place, number, doc_id, mark, first, words - what a slot holds, as runs of words of documents. documents: doc_id, mark, number,
    size, source, source_size, target, until - until is the end of the document in its source's words.
    """
    plan, placed = _laid(docs, key, text, source, weights, share, cap, block)
    start = F.col("until") - F.col("size")
    parts = (placed.where("size > 0")
             .withColumn("index", F.explode(F.sequence(F.floor(start / block), F.floor((F.col("until") - 1) / block))))
             .withColumn("low", F.greatest(start, F.col("index") * block))
             .select("number", "index", "doc_id", "mark", "until", (F.col("low") - start).alias("first"),
                     (F.least("until", (F.col("index") + 1) * block) - F.col("low")).alias("words")))
    # the blocks grow with the corpus, and the size of their compressed files would pass for a small side
    pieces = _slots(plan, seed, block, shard_slots).join(parts.hint("merge"), ["number", "index"])
    return pieces.select("shard", "place", "number", "doc_id", "mark", "until", "first", "words"), placed


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
           share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 8) -> DataFrame:
    """(shard, place, source, source_size, target, size, taken, pieces, text), one row per slot: the mix itself.

    pieces: doc_id, first, words, in the order of the text; a line break stands between the pieces. size is what the pieces add up to, taken the
    words found in the text. Inside a piece the text is as it was. A block that is drawn twice comes out twice.
    """
    plan, placed = _laid(docs, key, text, source, weights, share, cap, block)
    keys = ["__id", "mark", "__source"]
    own = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("mark"),
           F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source")]
    # rows with equal id, text and source are interchangeable: one text serves all of them
    held = (docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"),
                        F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
            .select(*own, "text").dropDuplicates(keys))

    def cut(b: pa.RecordBatch):
        number, until, size = (b.column(c).to_numpy() for c in ("number", "until", "size"))
        for w in words(b.column("text")):
            row = w.row + np.arange(w.texts)
            start = until[row] - size[row]
            many = (until[row] - 1) // block - start // block + 1
            at = np.repeat(np.arange(w.texts), many)  # the text of each piece
            index = start[at] // block + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            low = np.maximum(start[at], index * block)
            first = low - start[at]
            count = np.minimum(until[row][at], (index + 1) * block) - low
            a, z = w.first[:-1][at] + first, np.minimum(w.first[:-1][at] + first + count, w.first[1:][at])
            texts = [w.data[i:j].tobytes() for i, j in zip(w.start[a], w.end[z - 1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[row][at]), pa.array(index), pa.array(low), b.column("doc_id").take(pa.array(row[at])), pa.array(first),
                 pa.array(count), pa.array(z - a), pa.array(texts, pa.binary()).cast(pa.string())],
                ["number", "index", "low", "doc_id", "first", "words", "found", "text"])

    rows = placed.where("size > 0").select(*own, "doc_id", "number", "until", "size").join(held.hint("merge"), keys)
    parts = map_batches(rows.select("doc_id", "number", "until", "size", "text"), cut,
                        "number long, index long, low long, doc_id long, first long, words long, found long, text string")
    # a piece has a word at least, so a block has at most ``block`` of them
    blocks = (parts.groupBy("number", "index")
              .agg(F.sum("words").alias("size"), F.sum("found").alias("taken"),
                   F.sort_array(F.collect_list(F.struct("low", "doc_id", "first", "words", "text"))).alias("__parts")))
    blocks = blocks.select("number", "index", "size", "taken",
                           F.transform("__parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["first"].alias("first"),
                                                                     x["words"].alias("words"))).alias("pieces"),
                           F.array_join(F.transform("__parts", lambda x: x["text"]), "\n").alias("text"))
    mixed = _slots(plan, seed, block, shard_slots).join(blocks.hint("merge"), ["number", "index"])
    return (mixed.join(F.broadcast(plan.select("number", "source", "source_size", "target")), "number")
            .select("shard", "place", "source", "source_size", "target", "size", "taken", "pieces", "text"))


def shares(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, mark, size, source, source_size, target, taken), one row per row of ``docs``."""
    pieces, placed = mixture(docs, **settings)
    taken = pieces.groupBy("number", "until").agg(F.sum("words").alias("taken"))
    return (placed.join(taken, ["number", "until"], "left")
            .select("doc_id", "mark", "size", "source", "source_size", "target",
                    F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken")))
