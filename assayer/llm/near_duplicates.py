"""Near-duplicate documents by MinHash: banded minima of universal hashes, exact verification, connected components.

1. A document's set holds the hashes of its distinct word shingles. Equal sets form one class, found by a 128-bit
   sum over the set, so copies cost one row each and never meet as pairs.
2. A class has ``bands * rows`` minima of multiply-add hashes. Classes that agree in all rows of a band share a bucket. At a
   similarity of 0.85 a pair misses all 32 buckets of 6 rows with a probability under 3e-7.
3. Every member of a bucket is held against one centre, the least class in it. Pairs are confirmed on full sets.
4. Buckets that still hold several components are gone through once more in blocks of bounded size. Members of different components that
   their signatures leave possible are compared on full sets inside the block, which gives out only the links that join
   two of its components. Pairs are never listed, and a pair is compared in the first bucket that it shares only.
5. Links join into components by large-star and small-star.

Texts without words have an empty set and link with nothing. Rows with the same id are one node, each with its own set. Rows
with a null id stay, link with nothing and have no component.

Texts of any length are read whole, an empty table gives an empty one, and columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.components import components
from assayer.llm.frames import lists, map_batches, texts
from assayer.llm.words import Words, grams, mix, words
from assayer.session import settled

SHINGLE = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 32, 6
#: Members of one block of a bucket that is compared within.
BLOCK = 1024
#: Standard deviations that a signature's estimate may fall short of the threshold.
SLACK = 5
_U = np.uint64


def shingle_sets(w: Words, size: int):
    """Sorted distinct shingle hashes of each text of a chunk."""
    hashes, whole = grams(w.hash, w.first, size)
    for i in range(w.texts):
        a, z = w.first[i], w.first[i + 1]
        if z - a >= size:
            yield np.unique(hashes[a:z - size + 1])
        elif z > a:
            yield grams(w.hash[a:z], np.array([0, z - a]), int(z - a))[0][:1]
        else:
            yield np.empty(0, _U)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seeds[:n, None] | _U(1), seeds[n:, None]


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, _U)
    for at in range(0, len(values), 256):
        np.minimum(out, (a * values[None, at:at + 256] + b).min(axis=1), out=out)
    return out


def signatures(source: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, n, class, bands, signature): row is a hash of the text, class one of the set."""
    a, b_ = _universal(bands * rows)

    def sign(b: pa.RecordBatch):
        for w in words(b.column("text"), lower=True):
            n, cls, banded, marks = [], [], [], []
            for s in shingle_sets(w, shingle):
                n.append(len(s))
                if not len(s):
                    cls.append(0), marks.append(b"")
                    continue
                total = np.array([mix(s).sum(), mix(s + _U(0x5851F42D4C957F2D)).sum()], _U)
                cls.append(int(mix(total[:1] + mix(total[1:] + _U(len(s)))).view(np.int64)[0]))
                least = minima(s, a, b_)
                keys = mix(least + np.arange(len(least), dtype=_U)).reshape(bands, rows).sum(axis=1)
                banded.append(mix(keys + np.arange(bands, dtype=_U)))
                marks.append((mix(least) >> _U(48)).astype("<u2").tobytes())
            size = np.where(np.array(n) > 0, bands, 0)
            r = slice(w.row, w.row + w.texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[r], b.column("row")[r], pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                 lists(np.concatenate(banded) if banded else np.empty(0, _U), size), pa.array(marks, pa.binary())],
                ["doc_id", "row", "n", "class", "bands", "signature"])

    return map_batches(source, sign, "doc_id long, row long, n long, class long, bands array<long>, signature binary")


def _texts_of(needed: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    return (classes.select("class", "doc_id", "row").join(needed, "class")
            .join(source, ["doc_id", "row"]).dropDuplicates(["class"]).select("class", "text"))


def _confirmed(pairs: DataFrame, classes: DataFrame, source: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are similar enough. Texts come in once per class that is in a pair."""
    needed = pairs.select(F.col("u").alias("class")).union(pairs.select(F.col("v").alias("class"))).distinct()
    held = settled(_texts_of(needed, classes, source))

    def judge(b: pa.RecordBatch):
        sides = [[s for w in words(b.column(c), lower=True) for s in shingle_sets(w, shingle)] for c in ("text_u", "text_v")]
        good = []
        for x, y in zip(*sides):
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(den * both >= num * (len(x) + len(y) - both))
        return b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    full = (pairs.join(held.select(F.col("class").alias("u"), F.col("text").alias("text_u")), "u")
            .join(held.select(F.col("class").alias("v"), F.col("text").alias("text_v")), "v"))
    return map_batches(full, judge, "u long, v long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block's sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[place] > 1
    column = np.cumsum(held > 1)[place[shared]] - 1
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, (low, low + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:z], column[a:z] - low] = 1
        total += part @ part.T
    return total


def _remaining(members: DataFrame, roots: DataFrame, classes: DataFrame, source: DataFrame, shingle: int, num: int, den: int,
               bands: int, rows_: int) -> DataFrame:
    """Links (u, v) between a bucket's members in different components."""
    placed = (members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
              .withColumn("root", F.coalesce("root", "class")))
    mixed = (placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"))
             .where("lo != hi AND m > 2").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    share, minima_ = num / den, bands * rows_
    least = (share - SLACK * (share * (1 - share) / minima_) ** 0.5) * minima_
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    open_ = settled(placed.join(mixed, "bucket").withColumn("own", own)
                    .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("bucket", "band", "class", "v", "root", "own",
                            F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    held = settled(_texts_of(open_.select("class").distinct(), classes, source))
    rows = open_.join(classes.select("class", "signature"), "class").join(held, "class")

    def compare(table: pa.Table) -> pa.Table:
        cls, centre, root, own = (table.column(c).to_numpy() for c in ("class", "v", "root", "own"))
        band, lo, hi = (table.column(c)[0].as_py() for c in ("band", "lo", "hi"))
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(cls), minima_)
        tried = []
        for i in range(len(cls)):
            near = (root != root[i]) & (cls > cls[i] if lo == hi else (own != own[i]) & (own[i] == lo))
            if cls[i] == centre[i]:
                continue
            at = np.flatnonzero(near & (cls != centre))
            equal = marks[at] == marks[i]
            at, equal = at[equal.sum(axis=1) >= least], equal[equal.sum(axis=1) >= least]
            first = equal.reshape(len(at), bands, rows_).all(axis=2)[:, :band].any(axis=1)
            tried.append(np.stack([np.full(len(at), i), at])[:, ~first])
        pairs = np.concatenate(tried, axis=1) if tried else np.empty((2, 0), np.int64)
        if not pairs.shape[1]:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        at = np.unique(pairs)
        sets = [s for w in words(table.column("text").take(pa.array(at)), lower=True) for s in shingle_sets(w, shingle)]
        both, size = _overlaps(sets), np.array([len(x) for x in sets])
        x, y = np.searchsorted(at, pairs)
        good = den * both[x, y] >= num * (size[x] + size[y] - both[x, y])
        parent: dict = {}

        def find(r):
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        u, v = [], []
        for i, j in pairs[:, good].T.tolist():
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b:  # nothing is gained by a second link between the same two components
                parent[max(a, b)] = min(a, b)
                u.append(int(cls[i])), v.append(int(cls[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: tuple[int, int] = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    num, den = threshold
    source = texts(docs, key, text).withColumn("row", F.xxhash64("text"))
    signed = settled(signatures(source, shingle, bands, rows))
    usable = signed.where("doc_id IS NOT NULL AND n > 0")
    picked = usable.groupBy("class").agg(
        F.min(F.struct("doc_id", "row")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("signature").alias("signature"))
    classes = settled(picked.select("class", "least.doc_id", "least.row", "n", "bands", "signature"))
    buckets = classes.select("class", "n", F.posexplode("bands").alias("band", "bucket"))
    centres = (buckets.groupBy("bucket").agg(F.min(F.struct("class", "n")).alias("centre"), F.count("*").alias("m"))
               .where("m > 1").select("bucket", "m", F.col("centre.class").alias("v"), F.col("centre.n").alias("nv")))
    members = settled(buckets.join(centres, "bucket"))
    pairs = settled(members.where(f"class != v AND {den} * least(n, nv) >= {num} * greatest(n, nv)")
                    .select(F.col("class").alias("u"), "v").distinct())
    links = settled(_confirmed(pairs, classes, source, shingle, num, den))
    named = usable.groupBy("doc_id").agg(F.min("class").alias("u"), F.max("class").alias("hi")).where("u != hi").select("doc_id", "u")
    bridges = usable.join(named, "doc_id").where("class != u").select("u", F.col("class").alias("v"))
    roots = components(links.unionByName(bridges))
    later = settled(_remaining(members.where("m > 2"), roots, classes, source, shingle, num, den, bands, rows))
    if not later.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(later))
    placed = (classes.select("class", "doc_id").join(roots.withColumnRenamed("node", "class"), "class", "left")
              .withColumn("root", F.coalesce("root", "class")))
    label = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = placed.select("class", "root").join(label, "root").select("class", "component_id")
    told = signed.select("doc_id", "n", F.when(F.expr("doc_id IS NOT NULL AND n > 0"), F.col("class")).alias("class")).join(found, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
