"""Toxicity by logistic regression that FTRL-proximal fits to hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with one word between them, hashed to ``2**bits`` places. Words are
runs of lower-cased letters and digits; so that inflected forms share what is learned, the first 3, 4 and 5 bytes of a word count as words too. Every coordinate has its own learning rate, and the L1 term keeps most weights at
exactly zero, so what is broadcast to score all texts is a short list of (place, weight).

Fitting reads at most ``max_rows`` labelled rows, those with the least hashes of their ids, so that it takes the same time on any corpus;
everything is scored. Examples are seen in the order of that hash. Null labels are no examples; without any
example every score is 0.5. Null and empty texts are scored by the bias alone. Rows with repeated ids are
scored each, and each of their labels is an example.

Texts of any length are read whole; an empty table of documents gives no scores; other columns are carried only where they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.frames import batch, flat, lists, map_batches, texts
from assayer.llm.words import Words, hash_words, mix, words
from assayer.session import settled

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """alpha, beta: learning rate of a coordinate; l1, l2: penalties; epochs: passes over the sample."""

    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 5
    max_rows: int = 10_000


#: Bytes of a word that stand in for its stem.
STEMS = (3, 4, 5)


def features(w: Words, bits: int):
    """Distinct places of each text of a chunk."""
    kinds, size = [(0, w.hash)], len(w.hash)
    for gap in (1, 2):
        pair = np.zeros(size, _U)
        if size > gap:
            pair[:-gap] = mix(w.hash[:-gap] * _U(0xD1342543DE82EF95) + w.hash[gap:] + _U(gap))
        kinds.append((gap, pair))
    kinds += [(0, mix(hash_words(w.data, w.start, np.minimum(w.end, w.start + n)) + _U(n))) for n in STEMS]
    places = [(gap, (k >> _U(64 - bits)).astype(np.int32)) for gap, k in kinds]
    for i in range(w.texts):
        a, z = int(w.first[i]), int(w.first[i + 1])
        yield np.unique(np.concatenate([p[a:max(z - gap, a)] for gap, p in places]))


def ftrl(examples: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias. Each example adds its gradient to z and its square to n of the places it has."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias = 1 << s.bits

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= s.l1, 0.0,
                        (np.sign(own) * s.l1 - own) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for places, label in zip(examples, labels):
            at = np.append(places, bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - rate * w
            n[at] += g * g
    every = weights(np.arange(bias + 1))
    return every[:-1], float(every[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the weights that aren't zero: at most ``2**bits`` reach the driver."""
    s = settings
    sample = (labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .where("doc_id IS NOT NULL AND label IN (0, 1)")
              .withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id", "label").limit(s.max_rows))

    def extract(b: pa.RecordBatch):
        for w in words(b.column("text"), items=True):
            found = list(features(w, s.bits))
            r = slice(w.row, w.row + w.texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("turn")[r], b.column("label")[r],
                 lists(np.concatenate(found), np.array([len(x) for x in found]))], ["turn", "label", "places"])

    # the sample is bounded by max_rows, 20 bytes a row
    rows = settled(map_batches(texts(docs, key, text).join(F.broadcast(sample), "doc_id"), extract,
                               "turn long, label int, places array<int>"))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("turn", "ascending"), ("label", "ascending")])
        values, bound = flat(table.column("places"), np.int32)
        examples = [values[a:b] for a, b in zip(bound, bound[1:])]
        weights, bias = ftrl(examples, table.column("label").to_numpy(), s)
        at = np.flatnonzero(weights)
        return pa.table({"place": np.append(at, -1), "weight": np.append(weights[at], bias)})

    # one group of at most max_rows examples
    model = rows.groupBy(F.lit("all")).applyInArrow(learn, "place long, weight double").toArrow()
    place, weight = model.column("place").to_numpy(), model.column("weight").to_numpy()
    real = place >= 0
    return place[real], weight[real], float(weight[~real].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text",
          bits: int = Settings.bits, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score, and the columns in ``keep``) for every row."""
    places, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((places, weights, bias))
    keep = keep or []
    made: dict = {}

    def judge(b: pa.RecordBatch):
        if not made:
            table = np.zeros(1 << bits)
            table[shared.value[0]] = shared.value[1]
            made["table"] = table
        sums = [made["table"][f].sum() + shared.value[2] for w in words(b.column("__text"), items=True)
                for f in features(w, bits)]
        out = {"doc_id" if n == "__id" else n: b.column(n) for n in b.schema.names if n != "__text"}
        return pa.RecordBatch.from_pydict(out | {"score": pa.array(1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35))))})

    source = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"), *keep)
    fields = ", ".join(["doc_id long", *(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep), "score double"])
    return map_batches(source, judge, fields)
