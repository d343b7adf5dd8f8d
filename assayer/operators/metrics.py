"""Detection metrics: M-PRCURVE, M-AP, M-ROC, M-LIFT, M-CONF, M-ATK, M-WORK, M-COMPARE, M-SWEEP, M-OVERSTATE, M-HIST, M-BOOT.

Input is a table with a double ``score``, a 0/1 ``label`` and, where ties must be
settled, a position. Rows collapse to one per distinct score before anything is
ordered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.hashing import draw
from assayer.operators.identity import POSITION
from assayer.operators.running import running_totals
from assayer.operators.thresholds import Threshold
from assayer.session import settled

# Review effort per alert, list lengths, resamples.
SECONDS_PER_REVIEW = 90
LIST_LENGTHS = (50, 100, 285, 500, 1000)
RESAMPLES = 200
HISTOGRAM_BINS = 70
COMPARISON_COLUMNS = (
    "model", "pr_auc", "pr_auc_lift", "roc_auc", "precision", "recall", "f1", "alerts", "true_positives",
    "false_positives", "false_negatives", "precision_at_100", "review_hours", "review_hours_per_fraud_found",
    "threshold_name", "threshold_is_oracle",
)


def score_steps(scored: DataFrame) -> DataFrame:
    """One row per distinct score, from the highest: rows and positives at it and down to it."""
    label = F.col("label").cast("bigint")
    distinct = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    return running_totals(distinct, [F.col("score").desc()], ["n", "pos"])


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision, recall and false positive rate at every cut."""
    steps = score_steps(scored)
    total = steps.agg(F.max("cum_pos").alias("p"), F.max("cum_n").alias("n")).first()
    positives, negatives = total["p"] or 0, (total["n"] or 0) - (total["p"] or 0)

    def rate(part: Column, whole: int) -> Column:
        return part / F.lit(float(whole)) if whole else F.lit(0.0)

    return steps.select(
        "score", F.col("cum_pos").alias("tp"), (F.col("cum_n") - F.col("cum_pos")).alias("fp"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"), rate(F.col("cum_pos"), positives).alias("recall"),
        rate(F.col("cum_n") - F.col("cum_pos"), negatives).alias("fpr"))


def ranking_metrics(scored: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Counts, average precision, its lift over the base rate, and ROC-AUC, in one row.

    Average precision is a sum of precision over the positives; ROC-AUC counts,
    for each negative, the positives above it and half of those level with it.
    """
    steps = score_steps(scored) if steps is None else steps
    pos, n = F.col("pos"), F.col("n")
    wins = (n - pos) * (F.col("cum_pos") - pos + pos / 2)
    sums = steps.agg(
        F.sum(n).alias("n_records"), F.sum(pos).alias("n_positives"),
        F.sum(pos * F.col("cum_pos") / F.col("cum_n")).alias("ap_sum"), F.sum(wins).alias("wins"))
    p = F.col("n_positives")
    both = p * (F.col("n_records") - p)
    return sums.select(
        "n_records", "n_positives", (p / F.col("n_records")).alias("prevalence"),
        F.when(both > 0, F.col("wins") / both).alias("roc_auc"),
        F.when(p > 0, F.col("ap_sum") / p).otherwise(F.lit(0.0)).alias("pr_auc"),
    ).withColumn("pr_auc_lift", F.when(F.col("prevalence") > 0, F.col("pr_auc") / F.col("prevalence"))
                 .otherwise(F.lit(float("nan"))))


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _derived(counted: DataFrame) -> DataFrame:
    """Rates and reviewer workload from tp, fp, fn, tn."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    n = tp + fp + fn + F.col("true_negatives")
    alerts = tp + fp
    hours = alerts * SECONDS_PER_REVIEW / 3600.0
    never = F.lit(float("inf"))
    return counted.select(
        "*", alerts.alias("alerts"), (alerts / n).alias("flag_rate"), _safe(tp, alerts).alias("precision"),
        _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
        hours.alias("review_hours"),
        F.when(tp > 0, fp / tp).otherwise(never).alias("false_positives_per_true_positive"),
        F.when(tp > 0, hours / tp).otherwise(never).alias("review_hours_per_fraud_found"),
        (1000 * alerts / n).alias("alerts_per_1000_records"))


def _outcomes(flag: Column) -> list[Column]:
    hit = F.col("label") == 1
    return [
        F.count_if(flag & hit).alias("true_positives"), F.count_if(flag & ~hit).alias("false_positives"),
        F.count_if(~flag & hit).alias("false_negatives"), F.count_if(~flag & ~hit).alias("true_negatives")]


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Outcome counts, rates and workload at one threshold."""
    return _derived(scored.agg(*_outcomes(F.col("score") >= threshold)))


def budget_sweep(scored: DataFrame, thresholds: list[Threshold]) -> DataFrame:
    """The same at several thresholds, from one scan."""
    tag = F.explode(F.array(*[
        F.struct(F.lit(t.name).alias("threshold_name"), F.lit(t.expected_flag_rate).alias("budget"),
                 F.lit(t.value).alias("threshold_value")) for t in thresholds]))
    spread = scored.select("score", "label", tag.alias("t")).select("score", "label", "t.*")
    return _derived(spread.groupBy("threshold_name", "budget", "threshold_value").agg(
        *_outcomes(F.col("score") >= F.col("threshold_value"))))


def precision_at_k(
    scored: DataFrame, n_records: int, n_positives: int, ks: tuple[int, ...] = LIST_LENGTHS, tie: str = POSITION
) -> DataFrame:
    """Hits among the k highest scores; k is cut to the number of rows, which also names the metric."""
    ks = tuple(dict.fromkeys(min(k, n_records) for k in ks))
    top = scored.orderBy(F.desc("score"), tie).limit(max(ks)).select("score", "label", tie)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), tie)))
    hits = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("label"))), F.lit(0)).alias(f"h{k}")
                        for k in ks])
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"h{k}").cast("bigint").alias("hits"),
                 (F.col(f"h{k}") / k).alias("precision"), (F.col(f"h{k}") / max(1, n_positives)).alias("recall"))
        for k in ks]))
    return hits.select(rows.alias("r")).select("r.*")


def evaluate_scores(scored: DataFrame, threshold: Threshold, tie: str = POSITION) -> DataFrame:
    """All metrics of one model at one threshold, in one row."""
    ranking = ranking_metrics(scored)
    size = ranking.select("n_records", "n_positives").first()
    lists = precision_at_k(scored, size["n_records"], size["n_positives"], tie=tie).collect()  # five rows at most
    row = confusion(scored, threshold.value).withColumn("one", F.lit(1)).join(
        ranking.withColumn("one", F.lit(1)), "one").drop("one")  # single rows on both sides
    for item in lists:
        row = row.withColumn(f"precision_at_{item['k']}", F.lit(item["precision"])).withColumn(
            f"recall_at_{item['k']}", F.lit(item["recall"]))
    return row.select(
        "*", F.lit(threshold.name).alias("threshold_name"), F.lit(float(threshold.value)).alias("threshold_value"),
        F.lit(threshold.rule).alias("threshold_rule"), F.lit(threshold.is_oracle).alias("threshold_is_oracle"))


def comparison(models: dict[str, DataFrame]) -> DataFrame:
    """Models side by side, best average precision first."""
    rows = []
    for name, metrics in models.items():
        row = metrics.withColumn("model", F.lit(name))
        for c in COMPARISON_COLUMNS:
            if c not in row.columns:
                row = row.withColumn(c, F.lit(None).cast("double"))
        rows.append(row.select(*COMPARISON_COLUMNS))
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("pr_auc"))


def overstatement(honest: DataFrame, oracle: DataFrame) -> DataFrame:
    """How much the labelled best threshold flatters each model."""
    a = honest.select("model", F.col("f1").alias("honest_f1"))
    b = oracle.select("model", F.col("f1").alias("oracle_f1"))
    return a.join(b, "model").withColumn("overstatement", F.col("oracle_f1") - F.col("honest_f1"))


def score_histogram(scored: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per class and logarithmic score bin, over the positive scores."""
    positive = scored.filter(F.col("score") > 0).withColumn("x", F.log10("score"))
    ends = positive.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    if ends["low"] is None:
        return positive.select(F.lit(0).alias("bin"), "label", F.lit(0).cast("bigint").alias("n")).limit(0)
    low, width = ends["low"], (ends["high"] - ends["low"]) / bins
    place = F.floor((F.col("x") - low) / width) if width > 0 else F.lit(0)
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), place)).cast("int")
    return positive.groupBy(place.alias("bin"), "label").agg(F.count(F.lit(1)).alias("n"))


# --- bootstrap --------------------------------------------------------------------------

# distribution function of Poisson(1), as far as 32-bit draws reach
POISSON_STEPS = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(10)))
DRAWS_PER_HASH = 3
#: Distinct scores whose weights a task adds up before it passes them on.
_HELD_SCORES = 4096


def poisson_weights(keys: Iterable[str | None], resamples: int, seed: int) -> np.ndarray:
    """A row of Poisson(1) weights per key, one for each resample: 32 bits of md5("key:block:seed") give each."""
    blocks, out = -(-resamples // DRAWS_PER_HASH), []
    ends = [f":{block}:{seed}" for block in range(blocks)]
    for key in keys:
        starts = ["" if key is None else key] * blocks
        names = [s + e if key is not None else e[1:] for s, e in zip(starts, ends)]
        out.append(b"".join(hashlib.md5(n.encode()).digest()[:4 * DRAWS_PER_HASH] for n in names))
    draws = np.frombuffer(b"".join(out), dtype=">u4").reshape(len(out), -1)[:, :resamples]
    return np.searchsorted(POISSON_STEPS, draws / 2.0**32, side="right")


def _vectors(**columns) -> pa.RecordBatch:
    """Integer matrices travel as bytes, a row each."""
    made = {n: pa.array([r.tobytes() for r in np.ascontiguousarray(c, np.int64)] if isinstance(c, np.ndarray) and c.ndim == 2 else c)
            for n, c in columns.items()}
    return pa.RecordBatch.from_pydict(made)


def _matrix(column: pa.Array, resamples: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, resamples)


def _added(scores: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal scores added up."""
    kinds, at = np.unique(scores, return_inverse=True)
    sums = []
    for part in parts:
        total = np.zeros((len(kinds), part.shape[1]), np.int64)
        np.add.at(total, at, part)
        sums.append(total)
    return kinds, *sums


def _score_weights(scored: DataFrame, key: Column, resamples: int, seed: int) -> DataFrame:
    """(score, n, pos): weights per resample of a task's rows with that score, and of the positive ones among them."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, _HELD_SCORES):
                part = batch.slice(at, _HELD_SCORES)
                weights = poisson_weights(part.column("k").to_pylist(), resamples, seed)
                mine = _added(part.column("score").to_numpy(), weights, weights * part.column("label").to_numpy()[:, None])
                held = mine if held is None else _added(*(np.concatenate(two) for two in zip(held, mine)))
                if len(held[0]) > _HELD_SCORES:
                    yield _vectors(score=held[0], n=held[1], pos=held[2])
                    held = None
        if held is not None:
            yield _vectors(score=held[0], n=held[1], pos=held[2])

    rows = scored.select(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"),
                         F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), key.cast("string").alias("k"))
    return rows.mapInArrow(body, "score double, n binary, pos binary")


def _slice_offsets(sliced: DataFrame, resamples: int) -> DataFrame:
    """(slice, n, pos): weights per resample in all earlier slices; one row per slice goes through one task."""
    def add(batches):
        for batch in batches:
            kinds, n, pos = _added(batch.column("slice").to_numpy(), _matrix(batch.column("n"), resamples), _matrix(batch.column("pos"), resamples))
            yield _vectors(slice=kinds, n=n, pos=pos)

    def together(table):
        return pa.Table.from_batches(add(table.combine_chunks().to_batches()))

    def earlier(batches):
        n, pos = np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)
        for batch in batches:
            more = [_matrix(batch.column(c), resamples) for c in ("n", "pos")]
            before = [t + np.cumsum(m, axis=0) - m for t, m in zip((n, pos), more)]
            yield _vectors(slice=batch.column("slice"), n=before[0], pos=before[1])
            n, pos = n + more[0].sum(axis=0), pos + more[1].sum(axis=0)

    schema = "slice int, n binary, pos binary"
    totals = sliced.select("slice", "n", "pos").mapInArrow(add, schema).groupBy("slice").applyInArrow(together, schema)
    return totals.coalesce(1).sortWithinPartitions("slice").mapInArrow(earlier, schema)


def bootstrap_replicates(
    scored: DataFrame, threshold: float, key: Column, resamples: int = RESAMPLES, seed: int = 42
) -> DataFrame:
    """Average precision and recall of each resample that holds a positive.

    Each row enters a resample with a Poisson(1) weight drawn from its key, the
    distributed form of drawing with replacement. A score carries its weights of
    all resamples as one vector: vectors of equal scores are added up where the rows
    are, the scores are sliced by range once, and each slice runs its cumulative
    sums for all resamples at once, from the totals of the slices before it. Rows
    without a score come last.
    """
    parts = _score_weights(scored, key, resamples, seed)
    sliced = settled(parts.repartitionByRange(F.col("score").desc()).withColumn("slice", F.spark_partition_id()))
    marks = _slice_offsets(sliced, resamples).select("slice", F.lit(0).alias("kind"), F.lit(0.0).alias("score"), "n", "pos")
    stream = marks.unionByName(sliced.select("slice", F.lit(1).alias("kind"), "score", "n", "pos"))
    stream = stream.repartition("slice").sortWithinPartitions("slice", "kind", F.col("score").desc())

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = pos = None
        score, group_n, group_pos = None, 0, 0
        area, above, total = np.zeros(resamples), np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)

        def close():
            """Count the group of one score, now that it is whole."""
            nonlocal n, pos, area, above, total, score, group_n, group_pos
            if score is not None:
                n, pos = n + group_n, pos + group_pos
                area = area + group_pos * (pos / np.maximum(n, 1))
                total = total + group_pos
                if score >= threshold:
                    above = above + group_pos
            score, group_n, group_pos = None, 0, 0

        for batch in batches:
            kinds, scores = batch.column("kind").to_numpy(), batch.column("score").to_numpy()
            ns, poss = _matrix(batch.column("n"), resamples), _matrix(batch.column("pos"), resamples)
            for k in range(batch.num_rows):
                if kinds[k] == 0:
                    close()
                    n, pos = ns[k], poss[k]
                    continue
                if score is None or not (scores[k] == score or (scores[k] != scores[k] and score != score)):
                    close()
                    score = scores[k]
                group_n, group_pos = group_n + ns[k], group_pos + poss[k]
        close()
        if n is not None:
            yield pa.RecordBatch.from_pydict({"area": [area], "above": [above], "positives": [total]})

    sums = stream.mapInArrow(body, "area array<double>, above array<bigint>, positives array<bigint>")
    each = sums.select(F.posexplode(F.arrays_zip("area", "above", "positives")).alias("replicate", "one"))
    return each.groupBy("replicate").agg(
        (F.sum("one.area") / F.sum("one.positives")).alias("pr_auc"), (F.sum("one.above") / F.sum("one.positives")).alias("recall"),
        F.sum("one.positives").alias("positives")).filter("positives > 0")


def bootstrap_interval(
    scored: DataFrame, threshold: float, key: Column, resamples: int = RESAMPLES, seed: int = 42
) -> DataFrame:
    """95 % percentile intervals; the percentile holds one value per resample."""
    both = [F.lit(0.025), F.lit(0.975)]
    row = bootstrap_replicates(scored, threshold, key, resamples, seed).agg(
        F.percentile("pr_auc", F.array(*both)).alias("a"), F.percentile("recall", F.array(*both)).alias("r"),
        F.count(F.lit(1)).alias("n_resamples"))
    return row.select(F.col("a")[0].alias("pr_auc_low"), F.col("a")[1].alias("pr_auc_high"),
                      F.col("r")[0].alias("recall_low"), F.col("r")[1].alias("recall_high"), "n_resamples")
