"""Perplexity by an interpolated modified Kneser-Ney model of word pairs, counted in Spark and kept as sorted hash arrays.

1. Each batch counts its distinct (word before, word) pairs and deals them, packed, into parts by ranges of the first word's hash.
2. A part adds its pairs up and writes three files to the shared folder: sorted hashes of pairs with counts, and
   sorted hashes of contexts with their totals and their numbers of pairs seen once, twice and more. It passes on, per
   word, its occurrences and the number of words before it; ranges of words add these up and write theirs.
3. Discounts come from the counts of counts, one row for each part. Workers map the files into memory and look up the distinct pairs
   of a batch in sorted order. Nothing of the model passes through the driver but some twenty numbers.

Words are lower-cased and hashed to 48 bits; each text ends in an end token and starts from a begin context. Files are written under a
new name and moved, so repeated tasks agree. In a shared folder that isn't a local path, workers first copy the files they map.

Null texts are empty: one end token. Without training text every word has the same probability. Repeated rows count and are scored each.

Texts of any length are read whole, an empty table gives an empty one, and columns other than key and text are not read.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from assayer.llm.frames import map_batches, texts
from assayer.llm.words import mix, words
from assayer.session import settled, shared_folder

#: Characters of training text behind one part, about two million words.
PART_CHARS = 12_000_000
#: Text bytes that are counted, or scored, at a time; a longer text is one piece. Counting gains by larger ones.
COUNT_BYTES, SCORE_BYTES = 24 << 20, 4 << 20
BEGIN, END = 1, 2
_U = np.uint64
_PAIR = np.dtype([("c", "<u2", 3), ("w", "<u2", 3), ("n", "u1")])
_WORD = np.dtype([("w", "<u8"), ("n", "<u4"), ("d", "<u4")])


def _pieces(b: pa.RecordBatch, size: int):
    """Runs of rows with about ``size`` bytes of text each, so that what is held for them does not follow the batch."""
    ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, to - at)
        at = to


def _tokens(b: pa.RecordBatch):
    """(token keys, contexts, bounds of texts) of a batch: words and an end for each text."""
    keys, bounds = [], [np.zeros(1, np.int64)]
    total = 0
    for w in words(b.column("text"), lower=True):
        out = np.full(len(w.hash) + w.texts, END, _U)
        out[np.arange(len(w.hash)) + w.owner] = (w.hash >> _U(16)) | _U(4)  # apart from the two marks
        keys.append(out)
        bounds.append(total + w.first[1:] + np.arange(1, w.texts + 1))
        total += len(out)
    keys, bounds = np.concatenate(keys), np.concatenate(bounds)
    before = np.empty(len(keys), _U)
    before[1:] = keys[:-1]
    before[bounds[:-1]] = BEGIN
    return keys, before, bounds


def _pair(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(c * _U(0xD1342543DE82EF95) + w)


def _pack(x: np.ndarray) -> np.ndarray:
    return x.view("<u2").reshape(-1, 4)[:, :3]


def _unpack(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 4), "<u2")
    out[:, :3] = x
    return out.view("<u8").ravel()


def _save(folder: str, name: str, array: np.ndarray) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    new = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(new) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    system.move(new, f"{path}/{name}.npy")


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder)
    full = f"{path}/{name}.npy"
    size = system.get_file_info(full).size
    if size is None:
        raise FileNotFoundError(full)
    if not isinstance(system, fs.LocalFileSystem):
        import tempfile

        held = tempfile.TemporaryFile()  # goes with the worker
        with system.open_input_stream(full) as source:
            while piece := source.read(1 << 20):
                held.write(piece)
        held.seek(0)
        version = np.lib.format.read_magic(held)
        shape, _, kind = np.lib.format._read_array_header(held, version)
        return np.memmap(held, kind, "r", held.tell(), shape) if shape[0] else np.empty(shape, kind)
    if size <= 128:
        return np.load(full)
    return np.load(full, mmap_mode="r")


def _counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> dict:
    """A description of the model: where its files are and its sums."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/settled-kneser-ney-{uuid.uuid4().hex}"
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    place, path = fs.FileSystem.from_uri(folder)
    place.create_dir(path)
    source = texts(docs, key, text).select("text")
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, chars / part_chars)))))

    def pairs(b: pa.RecordBatch):
        w, c, _ = _tokens(b)
        order = np.lexsort((w, c))
        c, w = c[order], w[order]
        start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        n = np.diff(np.r_[start, len(c)])
        c, w = c[start], w[start]
        times = -(-n // 255)  # a count over 255 takes several rows
        c, w = np.repeat(c, times), np.repeat(w, times)
        left = np.repeat(n, times) - 255 * (np.arange(len(c)) - np.repeat(np.cumsum(times) - times, times))
        rows = np.empty(len(c), _PAIR)
        rows["c"], rows["w"], rows["n"] = _pack(c), _pack(w), np.minimum(left, 255)
        part = (c >> _U(48 - bits)).astype(np.int64) if bits else np.zeros(len(c), np.int64)
        edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array([rows[a:z].tobytes() for a, z in zip(edge, edge[1:])], pa.binary())],
                                         ["part", "rows"])

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), _PAIR)
        c, w, n = _unpack(rows["c"]), _unpack(rows["w"]), rows["n"].astype(np.int64)
        order = np.lexsort((w, c))
        c, w, n = c[order], w[order], n[order]
        start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        c, w, n = c[start], w[start], np.add.reduceat(n, start)
        own = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        _save(folder, f"context-{part}", c[own])
        weight = np.stack([np.add.reduceat(x.astype(np.int64), own) for x in (n, n == 1, n == 2, n >= 3)], axis=1)
        _save(folder, f"weight-{part}", weight.astype(np.min_scalar_type(int(weight.max()))))
        hashes = _pair(c, w)
        order = np.argsort(hashes)
        _save(folder, f"pair-{part}", hashes[order])
        _save(folder, f"count-{part}", n[order].astype(np.min_scalar_type(int(n.max()))))
        order = np.argsort(w, kind="stable")
        start = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
        out = np.empty(len(start), _WORD)
        out["w"], out["n"], out["d"] = w[order][start], np.add.reduceat(n[order], start), np.diff(np.r_[start, len(w)])
        at = (out["w"] >> _U(48 - bits)).astype(np.int64) if bits else np.zeros(len(out), np.int64)
        edge = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
        blobs = [out[a:z].tobytes() for a, z in zip(edge, edge[1:])]
        stats = [_counts(n)] + [None] * (len(blobs) - 1)
        return pa.table({"part": at[edge[:-1]], "rows": pa.array(blobs, pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})

    def unite(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), _WORD)
        order = np.argsort(rows["w"], kind="stable")
        rows = rows[order]
        start = np.flatnonzero(np.r_[True, rows["w"][1:] != rows["w"][:-1]])
        n, d = np.add.reduceat(rows["n"].astype(np.int64), start), np.add.reduceat(rows["d"].astype(np.int64), start)
        _save(folder, f"word-{part}", rows["w"][start])
        _save(folder, f"seen-{part}", np.stack([n, d], axis=1))
        stats = [len(n), int(n.sum()), int(d.sum()), *_counts(d), int((d >= 3).sum())]
        return pa.table({"part": [part], "stats": pa.array([stats], pa.list_(pa.int64()))})

    counted = map_batches(source, lambda b: (out for piece in _pieces(b, COUNT_BYTES) for out in pairs(piece)), "part long, rows binary")
    built = settled(counted.groupBy("part").applyInArrow(build, "part long, rows binary, stats array<long>"))
    united = settled(built.select("part", "rows").groupBy("part").applyInArrow(unite, "part long, stats array<long>"))

    def added(rows: DataFrame, size: int) -> list[int]:
        got = rows.agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(size)]).first()
        return [int(x or 0) for x in got]

    vocabulary, tokens, kinds, *lower, several = added(united, 8)
    return {"folder": folder, "bits": bits, "words": vocabulary, "tokens": tokens, "kinds": kinds, "lower": lower, "several": several, "upper": added(built, 4)}


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, from the numbers of pairs that occur once to four times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


def _lookup(model: dict, keys: np.ndarray, kind: str, values: str, hashed: np.ndarray | None = None) -> np.ndarray:
    """Values of sorted keys; zeros where there are none. ``hashed`` is looked up instead of the keys that select the part."""
    wanted = keys if hashed is None else hashed
    part = (keys >> _U(48 - model["bits"])).astype(np.int64) if model["bits"] else np.zeros(len(keys), np.int64)
    out = None
    edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
    for a, z in zip(edge, edge[1:]):
        try:
            table, value = (_mapped(model["folder"], f"{x}-{part[a]}") for x in (kind, values))
        except FileNotFoundError:  # no training pair falls into this range
            continue
        if out is None:
            out = np.zeros((len(keys), *value.shape[1:]), np.int64)
        at = np.minimum(np.searchsorted(table, wanted[a:z]), len(table) - 1)
        hit = table[at] == wanted[a:z]
        out[a:z][hit] = value[at[hit]]
    return out if out is not None else np.zeros((len(keys), {"weight": 4, "seen": 2}.get(values, 1)), np.int64).squeeze()


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): sums of log10 probabilities over words and the end."""
    high, low = discounts(model["upper"]), discounts(model["lower"])
    words_, tokens, kinds = model["words"], model["tokens"], max(model["kinds"], 1)
    spare = float(low[1] * model["lower"][0] + low[2] * model["lower"][1] + low[3] * model["several"]) / kinds
    spare = spare if model["kinds"] else 1.0

    def judge(b: pa.RecordBatch):
        w, c, bounds = _tokens(b)
        order = np.lexsort((w, c))
        cs, ws = c[order], w[order]
        start = np.flatnonzero(np.r_[True, (cs[1:] != cs[:-1]) | (ws[1:] != ws[:-1])])
        inverse = np.empty(len(w), np.int64)
        inverse[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(w)]))
        c, w = cs[start], ws[start]
        n = _lookup(model, c, "pair", "count", _pair(c, w))
        own = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        weight = np.repeat(_lookup(model, c[own], "context", "weight").reshape(-1, 4), np.diff(np.r_[own, len(c)]), axis=0)
        unique, place = np.unique(w, return_inverse=True)
        seen, kept = _lookup(model, unique, "word", "seen").reshape(-1, 2)[place].T
        lower = np.maximum(kept - low[np.minimum(kept, 3)], 0) / kinds + spare / (words_ + 1)
        total = np.maximum(weight[:, 0], 1)
        upper = np.maximum(n - high[np.minimum(n, 3)], 0) / total + weight[:, 1:] @ high[1:] / total * lower
        full = np.log10(np.where(weight[:, 0] > 0, upper, lower))
        base = np.log10((seen + 1) / (tokens + words_ + 1))
        add = lambda x: np.add.reduceat(x[inverse], bounds[:-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(add((seen > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(full))],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return map_batches(texts(docs, key, text), lambda b: (out for piece in _pieces(b, SCORE_BYTES) for out in judge(piece)),
                       "doc_id long, n_tokens long, n_known long, base_score double, score double")
