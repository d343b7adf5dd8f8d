"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of the benchmark items; an item with fewer words is one pattern.
Patterns of one length form one searcher. Its shift table tells, for the block of two words at the end of a
candidate position, how many words the search may skip; where it tells none, the hash of that block selects a bucket of
patterns, which are compared in full. The benchmark is read in blocks of a fixed number of patterns, and only one
block at a time is broadcast, so no broadcast grows with the benchmark.

Nulls and texts without words hit nothing and are not contaminated. Repeated documents are judged each; items
that repeat a window all count. An empty benchmark leaves every document clean. Rows with a null item id are no items.

Texts of any length are read whole, an empty table gives an empty one, and columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from assayer.llm.frames import batch, lists, map_batches, texts
from assayer.llm.words import words
from assayer.session import settled

WINDOW = 10
#: Patterns of one broadcast block: about 100 bytes each with their words.
BLOCK_PATTERNS = 200_000
_PAIR = 0xD1342543DE82EF95


class WuManber:
    """Search for patterns of one length, given as rows of word hashes."""

    def __init__(self, patterns: np.ndarray):
        self.length = m = patterns.shape[1]
        self.block = block = min(2, m)
        self.rest = m - block + 1  # shift of a block that ends in no pattern
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple]] = {}
        keys = self._keys(patterns.ravel())
        for row, pattern in enumerate(patterns.tolist()):
            for end in range(block, m + 1):
                key = int(keys[row * m + end - block])
                if m - end < self.shift.get(key, self.rest):
                    self.shift[key] = m - end
            self.buckets.setdefault(int(keys[row * m + m - block]), []).append((tuple(pattern), row))
        self.table = np.array(sorted(self.shift), np.uint64)

    def _keys(self, hashes: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return hashes
        out = hashes * np.uint64(_PAIR)
        out[:-1] += hashes[1:]
        return out

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence inside one text."""
        m, found = self.length, []
        if not len(hashes) or not len(self.table):
            return found
        keys = self._keys(hashes)
        at = np.searchsorted(self.table, keys)
        known = self.table[np.minimum(at, len(self.table) - 1)] == keys
        # next position whose block is in the table, so that runs of full shifts are one step
        places = np.flatnonzero(known)
        if not len(places):
            return found
        shift, buckets, block = self.shift, self.buckets, self.block
        starts = places.tolist()
        values = keys[places].tolist()
        owner = np.searchsorted(first, places, "right") - 1
        low, high = first[owner].tolist(), first[owner + 1].tolist()
        bound = -1  # no occurrence's last block lies before this place; holds across texts, as it starts after the last one
        for place, key, a, b in zip(starts, values, low, high):
            if place < bound:
                continue
            skip = shift[key]
            if skip:
                bound = place + skip
                continue
            begin = place - (m - block)
            if begin >= a and place + block <= b:
                window = tuple(hashes[begin:begin + m].tolist())
                for pattern, row in buckets[key]:
                    if pattern == window:
                        found.append((begin, row))
            bound = place + 1
        return found


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(pattern: word hashes, items: ids of the items that hold it), one row per distinct pattern."""
    def cut(b: pa.RecordBatch):
        ids = b.column(0)
        for w in words(b.column(1), items=True):
            for i in range(w.texts):
                h = w.hash[w.first[i]:w.first[i + 1]]
                if len(h):
                    m = min(window, len(h))
                    rows = np.lib.stride_tricks.sliding_window_view(h, m)
                    yield batch(item=[ids[w.row + i].as_py()] * len(rows), pattern=lists(rows.ravel(), np.full(len(rows), m)))

    source = texts(items, key, text).where("doc_id IS NOT NULL")
    return (map_batches(source, cut, "item long, pattern array<long>")
            .groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")))


def _hits(docs: DataFrame, patterns: list) -> DataFrame:
    """(doc_id, text, n_words, spans, items) by one block of patterns."""
    by_length: dict[int, tuple[list, list]] = {}
    for pattern, items in patterns:
        rows, owners = by_length.setdefault(len(pattern), ([], []))
        rows.append(pattern)
        owners.append(items)
    shared = docs.sparkSession.sparkContext.broadcast(by_length)
    made: dict = {}

    def find(b: pa.RecordBatch):
        if not made:
            made["searchers"] = [(WuManber(np.array(rows, np.int64).view(np.uint64)), owners)
                                 for rows, owners in shared.value.values()]
        for w in words(b.column("text"), items=True):
            hit: list[list] = [[] for _ in range(w.texts)]
            for searcher, owners in made["searchers"]:
                for begin, row in searcher.search(w.hash, w.first):
                    i = int(np.searchsorted(w.first, begin, "right")) - 1
                    hit[i].append((begin, searcher.length, owners[row]))
            spans, items = [], []
            for i, found in enumerate(hit):
                covered = sorted({p for begin, m, _ in found for p in range(begin, begin + m)})
                spans.append([p - int(w.first[i]) for p in covered])
                items.append(sorted({x for _, _, owned in found for x in owned}))
            rows = b.slice(w.row, w.texts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text"), pa.array(w.counts.astype(np.int64)),
                 pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "text", "n_words", "hit_words", "items"])

    return map_batches(docs, find, "doc_id long, text string, n_words long, hit_words array<int>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """Per document: n_words, the positions of hit words and the ids of the items found.

    Blocks of patterns are taken in turn, each in one pass over the texts whose hits are then added up. A benchmark of
    up to ``block_patterns`` windows takes a single pass without a shuffle of texts.
    """
    windows = settled(benchmark_windows(benchmark, item_key, item_text, window))
    n_blocks = max(1, -(-windows.count() // block_patterns))
    source = texts(docs, key, text)
    if n_blocks == 1:
        return _hits(source, [(r[0], r[1]) for r in windows.collect()]).drop("text")
    numbered = settled(windows.withColumn("__block", F.pmod(F.xxhash64("pattern"), F.lit(n_blocks))))
    source = settled(source.withColumn("__row", F.monotonically_increasing_id()))
    parts = []
    for block in range(n_blocks):  # a block holds block_patterns on average, by hash
        rows = numbered.where(F.col("__block") == block).collect()
        keyed = source.select(F.col("__row").alias("doc_id"), "text")
        parts.append(_hits(keyed, [(r[0], r[1]) for r in rows]).drop("text"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    total = every.groupBy(F.col("doc_id").alias("__row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return source.select("__row", "doc_id").join(total, "__row").select("doc_id", "n_words", "hit_words", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``contamination`` finds."""
    ids = F.array_join(F.array_sort(F.col("items").cast(T.ArrayType(T.StringType()))), ",")
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
                        (F.size("hit_words") > 0).alias("contaminated"))
