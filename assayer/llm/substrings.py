"""Substring deduplication by matching statistics against suffix automata of reference shards.

A window is ``length`` consecutive words. A word goes if a window covers it whose word sequence also starts in a document with a
smaller id. References are the passages that more than one document holds; they are found first:

1. A document whose whole word sequence stands in a smaller one goes altogether; copies cost one narrow row each.
2. Every window names an anchor, the run of ``ANCHOR`` words in it with the least hash. Equal windows name
   equal anchors, so a window held by two documents leaves an anchor held by two documents. Each document offers
   an anchor once; anchors of one document only are dropped after one shuffle of (anchor, document).
3. At a shared anchor a document has a context, the words of all its windows that name the anchor. Equal contexts are
   counted once, with their smallest document. Where all documents agree on the context, that settles it.
4. Other contexts are dealt by anchor into shards of bounded size. A shard builds the suffix automaton of its contexts, those of an anchor in order
   of their documents, so that a state's first visitor is the smallest document which holds its word sequences, and streams the
   contexts through it: where the matching statistic is at least ``length``, suffix links lead to the state of the window
   itself, and the window goes if the state's document is smaller than the context's. An anchor with more contexts than a
   shard may hold (the edges of a line that very many documents share) has its windows put in order instead.
5. Spans come back to their documents, overlapping ones merge into maximal spans, and the words in them go.

The automata are not broadcast to every task: together they grow with the corpus, so each context goes to the one shard that can match it.
Sequences of words are compared by 64-bit hashes, in automata word by word by 32 bits each. Texts are shuffled once, and that
shuffle serves all steps.

Null texts have no words. Windows never leave a document; shorter documents keep all. Rows with the
same id are one document for the question whether a smaller one exists, each with its own text. A null id is larger than any
other and never a reference.

Texts of any length are read whole, an empty table gives an empty one, and columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.frames import batch, flat, lists, map_batches, texts
from assayer.llm.words import grams, mix, per_text, words
from assayer.session import settled

LENGTH = 13
ANCHOR = 6
#: Context words of one shard on average, about 1.5 KB of automaton each at most.
SHARD_WORDS = 60_000


def anchors(hashes: np.ndarray, first: np.ndarray, length: int, k: int):
    """Anchors of all windows of ``length`` words: places, hashes, and the (first, last) window that names each; ties go to the later run."""
    size = len(hashes)
    if size < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), (np.empty(0, np.int64),) * 2
    runs, _ = grams(hashes, first, k)
    _, whole = grams(hashes, first, length)
    best, at = runs.copy(), np.arange(size)
    for j in range(1, length - k + 1):  # the least of the runs that begin in the window
        better = runs[j:] <= best[:size - j]
        best[:size - j][better] = runs[j:][better]
        at[:size - j][better] = (np.arange(j, size))[better]
    windows = np.flatnonzero(whole)
    named = at[windows]
    start = np.flatnonzero(np.r_[True, named[1:] != named[:-1]]) if len(named) else np.empty(0, np.int64)
    last = np.r_[start[1:], len(named)] - 1 if len(named) else start
    # 48 bits: two runs that share a name only meet in a shard
    return named[start], (runs[named[start]] >> np.uint64(16)).view(np.int64), (windows[start], windows[last])


class Automaton:
    """Suffix automaton of several sequences added one after the other; a state knows the first of them that visited it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.owner = [None]

    def add(self, sequence, owner: int) -> None:
        nxt, link, size, own = self.next, self.link, self.size, self.owner
        last = 0
        for c in sequence:
            p, q = last, nxt[last].get(c)
            if q is not None and size[q] == size[p] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                size.append(size[p] + 1)
                link.append(0)
                own.append(owner)
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    continue
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur = None
            clone = len(nxt)
            nxt.append(nxt[q].copy())
            size.append(size[p] + 1)
            link.append(link[q])
            own.append(own[q])  # what the clone holds was seen wherever q was
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if cur is not None:
                link[cur] = clone
                last = cur
            else:
                last = clone

    def windows(self, sequence, length: int):
        """Owner of each window of the sequence: its first visitor, by matching statistics; None if unknown."""
        nxt, link, size, own = self.next, self.link, self.size, self.owner
        state, matched, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while matched >= length and size[link[state]] >= length:
                state = link[state]
            matched = min(matched, size[state])
            if i + 1 >= length:
                out.append(own[state] if matched >= length else None)
        return out


#: Null ids rank from here on, spread by their texts so that they don't meet in one task; among themselves they are equal.
_NULLS = (1 << 63) - (1 << 20)


def _copies(source: DataFrame, length: int) -> DataFrame:
    """(rank, copies): the texts of an id, by hash, whose whole word sequence is that of a smaller document."""
    def whole(b: pa.RecordBatch):
        for w in words(b.column("text")):
            n = w.counts
            place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(np.uint64)
            keys = [per_text(mix(w.hash + (place + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)), w.first)
                    for salt in (1, 1 << 40)]
            r = slice(w.row, w.row + w.texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("rank")[r], b.column("row")[r], *[pa.array(k.view(np.int64)) for k in keys]],
                ["rank", "row", "a", "b"]).filter(pa.array(n >= length))

    rows = map_batches(source, whole, "rank long, row long, a long, b long")
    least = rows.groupBy("a", "b").agg(F.min(_order()).alias("least"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(least, ["a", "b"]).where(_order() > F.col("least"))
    return later.groupBy("rank").agg(F.collect_set("row").alias("copies"))


def _order():
    return F.least("rank", F.lit(_NULLS))


def _shared(source: DataFrame, length: int, k: int) -> DataFrame:
    """(rank, anchor) for the anchors that several documents hold."""
    def offer(b: pa.RecordBatch):
        rank = b.column("rank").to_numpy()
        for w in words(b.column("text")):
            places, hashes, _ = anchors(w.hash, w.first, length, k)
            owner = rank[w.row + np.searchsorted(w.first, places, "right") - 1]
            pairs = np.unique(np.stack([hashes, owner]), axis=1)
            yield batch(anchor=pairs[0], rank=pairs[1])

    def keep(batches):
        # rows come in order of the anchor: its first document is held back until another one comes
        last, held, many = None, None, False
        for b in batches:
            a, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(a):
                continue
            start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            shared = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
            early: list[int] = []
            if a[0] == last and (many or shared[0] or d[0] != held):
                shared[0] = True
                early = [] if many else [held]
            rows = np.repeat(shared, np.diff(np.r_[start, len(a)]))
            yield batch(rank=np.r_[np.array(early, np.int64), d[rows]],
                        anchor=np.r_[np.full(len(early), a[0]), a[rows]])
            last, held, many = a[-1], d[-1], bool(shared[-1])

    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (map_batches(source.select("rank", "text"), offer, "anchor long, rank long").repartition(n, "anchor")
            .sortWithinPartitions("anchor").mapInArrow(keep, "rank long, anchor long"))


def _contexts(source: DataFrame, shared: DataFrame, length: int, k: int) -> DataFrame:
    """(rank, row, begin, n, anchor, context, words) for each place of a shared anchor."""
    def cut(b: pa.RecordBatch):
        rank, row = b.column("rank").to_numpy(), b.column("row").to_numpy()
        wanted, bound = flat(b.column("anchors"))
        for w in words(b.column("text")):
            places, hashes, windows = anchors(w.hash, w.first, length, k)
            owner = np.searchsorted(w.first, places, "right") - 1
            held = np.zeros(len(places), bool)
            edge = np.searchsorted(owner, np.arange(w.texts + 1))
            for i in range(w.texts):
                own = slice(edge[i], edge[i + 1])
                held[own] = np.isin(hashes[own], wanted[bound[w.row + i]:bound[w.row + i + 1]])
            hashes, owner = hashes[held], owner[held]
            begin, end = windows[0][held], windows[1][held] + length
            size = end - begin
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            codes = w.hash[inner]
            total = np.add.reduceat(mix(codes + (inner - np.repeat(begin, size) + 64).astype(np.uint64)
                                        * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(size) - size) if len(size) else codes
            yield batch(rank=rank[w.row + owner], row=row[w.row + owner], begin=(begin - w.first[owner]).astype(np.int32),
                        n=size.astype(np.int32), anchor=hashes, context=mix(total + size.astype(np.uint64)),
                        words=lists(codes.astype(np.uint32).view(np.int32), size))

    wanted = shared.groupBy("rank").agg(F.collect_set("anchor").alias("anchors"))
    return map_batches(source.join(wanted, "rank").select("rank", "row", "text", "anchors"), cut,
                       "rank long, row long, begin int, n int, anchor long, context long, words array<int>")


def _judged(contexts: DataFrame, length: int, shard_words: int) -> DataFrame:
    """(anchor, context, least, mask): the context's smallest document and, for that one, a bit per window that goes."""
    def judge(batches):
        shard: list[tuple] = []
        held: list[tuple] = []  # contexts of the anchor that is being read
        many, size = False, 0  # whether that anchor outgrew a shard; words of the shard

        def flush():
            automaton = Automaton()
            for _, _, least, codes in shard:
                automaton.add(codes, least)
            for anchor, context, least, codes in shard:
                mask = 0
                for j, owner in enumerate(automaton.windows(codes, length)):
                    mask |= (owner is not None and owner < least) << j
                yield anchor, context, least, mask, anchor ^ context, False
            shard.clear()

        def windows(rows):
            for anchor, context, least, codes in rows:
                h = mix(np.array(codes, np.int32).astype(np.uint64))
                keys = grams(h, np.array([0, len(h)]), length)[0][:len(h) - length + 1].view(np.int64)
                for j, key in enumerate(keys.tolist()):
                    yield anchor, context, least, 1 << j, key, True

        def finish():
            nonlocal size
            if many:
                yield from windows(held)
            elif len(held) == 1:
                yield *held[0][:3], 0, held[0][0], False
            else:
                shard.extend(held)
                size += sum(len(r[3]) for r in held)
                if size >= shard_words:
                    yield from flush()
                    size = 0
            held.clear()

        def rows():
            nonlocal many
            for b in batches:
                for row in zip(*[b.column(i).to_pylist() for i in range(4)]):
                    if held and held[0][0] != row[0]:
                        yield from finish()
                        many = False
                    held.append(row)
                    if len(held) * length > shard_words:
                        many = True
                        yield from windows(held[:-1])
                        del held[:-1]
            if held:
                yield from finish()
            yield from flush()

        kept: list[tuple] = []
        for made in rows():
            kept.append(made)
            if len(kept) == 20_000:
                yield table(kept)
                kept = []
        if kept:
            yield table(kept)

    def table(rows):
        names = ("anchor", "context", "least", "mask", "window", "open")
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)

    def first_stays(batches):
        # open windows come in order of their documents: only those of the first one stay
        last = least = None
        for b in batches:
            window, rank, mask, open_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("window", "least", "mask", "open"))
            if not len(window):
                continue
            new = np.r_[window[0] != last, window[1:] != window[:-1]]
            start = np.flatnonzero(np.r_[True, new[1:]])
            low = rank[start].copy()
            if not new[0]:
                low[0] = least
            group = np.cumsum(np.r_[0, new[1:]])
            mask = np.where(open_ & (rank == low[group]), 0, mask)
            yield batch(anchor=b.column("anchor"), context=b.column("context"), least=b.column("least"), mask=mask)
            last, least = window[-1], low[-1]

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "anchor long, context long, least long, mask long"
    return (contexts.groupBy("anchor", "context").agg(F.min(_order()).alias("least"), F.first("words").alias("words"))
            .repartition(n, "anchor").sortWithinPartitions("anchor", "least")
            .mapInArrow(judge, kind + ", window long, open boolean")
            .repartition(n, "window").sortWithinPartitions("window", "least").mapInArrow(first_stays, kind)
            .groupBy("anchor", "context").agg(F.min("least").alias("least"), F.bit_or("mask").alias("mask")))


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, copy, spans): the windows that also start in a document with a smaller id, or all of a copy.

    A span is a first word and a mask of the windows that begin there and at the words after it.
    """
    row = F.xxhash64("text")
    # never null by its type: a null check pushed below the shuffle of texts would make it another one, and run it twice
    rank = F.coalesce("doc_id", F.lit(_NULLS) + row.bitwiseAND(F.lit((1 << 20) - 1)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = texts(docs, key, text).select(rank.alias("rank"), row.alias("row"), "text")
    copies = settled(_copies(source, length))
    dealt = source.repartition(n, "rank").join(copies, "rank", "left")  # the one shuffle of texts, which all joins below share
    copy = F.coalesce(F.array_contains("copies", F.col("row")), F.lit(False))
    single = dealt.where(~copy).select("rank", "row", "text")
    contexts = _contexts(single, _shared(single, length, anchor), length, anchor)
    every = F.expr(f"shiftleft(1L, n - {length - 1}) - 1")
    spans = (contexts.select("rank", "row", "begin", "n", "anchor", "context")
             .join(_judged(contexts, length, shard_words), ["anchor", "context"])
             .select("rank", "row", "begin", F.when(_order() > F.col("least"), every).otherwise(F.col("mask")).alias("mask"))
             .where("mask != 0")
             .groupBy("rank").agg(F.collect_list(F.struct("row", "begin", "mask")).alias("spans")))
    return dealt.withColumn("copy", copy).join(spans, "rank", "left").select(
        F.when(F.col("rank") < _NULLS, F.col("rank")).alias("doc_id"), "text", "copy",
        F.filter("spans", lambda x: x["row"] == F.col("row")).alias("spans"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                    anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that stand in an earlier document's window."""
    def cut(b: pa.RecordBatch):
        spans = b.column("spans")
        begins, bound = flat(field(spans, "begin"))
        masks, _ = flat(field(spans, "mask"))
        bits, copy = np.arange(length), b.column("copy").to_numpy(zero_copy_only=False)
        for w in words(b.column("text")):
            change = np.zeros(len(w.hash) + 1, np.int32)
            for i in range(w.texts):
                own = slice(bound[w.row + i], bound[w.row + i + 1])
                if own.start < own.stop:
                    set_ = (masks[own, None] >> bits) & 1 == 1
                    starts = np.unique((begins[own, None] + bits)[set_]) + w.first[i]
                    change[starts] += 1
                    np.subtract.at(change, starts + length, 1)
            gone = (np.cumsum(change[:-1]) > 0) | np.repeat(copy[w.row:w.row + w.texts], w.counts)
            kept, removed = [], []
            data = w.data.tobytes()
            for i in range(w.texts):
                a, z = w.first[i], w.first[i + 1]
                stay = np.flatnonzero(~gone[a:z]) + a
                kept.append(b" ".join([data[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]).decode())
                removed.append(int(z - a - len(stay)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(w.row, w.texts), pa.array(w.counts.astype(np.int64)),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return map_batches(repeated_words(docs, key, text, length, anchor, shard_words), cut,
                       "doc_id long, n_words long, n_removed long, kept string")


def field(column: pa.Array, name: str) -> pa.ListArray:
    """A list of one field from a list of structs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists(column.flatten().field(name).to_numpy(zero_copy_only=False), sizes)
