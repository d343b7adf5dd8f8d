"""Personal data: plain patterns, and a skip-chain conditional random field that adds what the patterns miss.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Looser patterns give further candidates of the same shapes that a check
turned down or a typing slip hides. The candidates of a document are the nodes of a random field with the labels
none, email, ip, card and phone. Neighbours are joined in a chain; candidates with the same first or last seven characters (digits only for
numbers) are joined by skip edges, wherever in the document they stand. Loopy sum-product passes messages until they settle, so
that a damaged second mention takes the label of the first. Nodes of plain patterns keep their label; others become spans
when a label other than none has a probability over one half.

Weights are logarithms of counts over the whole corpus (piecewise training): how often a shape has a label when the deciding check is
left out, how often turned-down candidates are mentioned again in an accepted form, how often linked and
neighbouring candidates agree. The key space of these counts is fixed, so the driver gets a bounded table.

Null texts are empty. Texts without a digit and without @ are passed over. Positions are code points. Repeated rows are judged each.

At most one label has a probability over one half, so there are no ties. An empty table gives an empty one, and learning from one gives
counts of zero; texts of any length are read whole, and columns other than key and text pass through or are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm.frames import map_batches, texts

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DAMPING = 30, 0.3
#: Characters that two linked candidates share at their start or end.
SHARED = 7
# The patterns of the contract. Quantifiers that can't give back keep long runs linear; matches are the same.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser shapes of candidates.
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)*")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9]([\x20().-]{0,2}[0-9]){6,}")
_SEEN = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str, loose: bool = False):
    """Leftmost addresses: an address starts where the run of local characters before its @ starts."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = (_HOST if loose else _DOMAIN).match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = max(end, at + 1)  # a run of local characters can't cross an @
        at = text.find("@", max(at + 1, end))


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns alone, in order."""
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, plain: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None]]:
    """The plain spans and what the looser shapes find beside them, in order."""
    loose = [(a, b) for a, b in _emails(text, loose=True)] + [(m.start(), m.end()) for m in _NUMBER.finditer(text)]
    out, taken, end = list(plain), 0, 0
    ends = sorted((a, b) for a, b, _ in plain)
    for a, b in sorted(loose):
        while taken < len(ends) and ends[taken][1] <= a:
            taken += 1
        if a >= end and not any(x < b and a < y for x, y in ends[max(taken - 3, 0):taken + 4]):
            out.append((a, b, None))
            end = b
    return sorted(out, key=lambda s: s[:2])


def shape(s: str) -> str:
    """What a candidate looks like without the checks that decide: no plus, no top-level domain, no sums."""
    if "@" in s:
        return "mail"
    n = len(_digits(s))
    dots = s.count(".")
    return ("dots" if dots >= 2 else "long" if n >= 13 else "mid" if n >= 10 else "short") + ("()" if "(" in s else "")


def _content(s: str) -> str:
    return s.lower() if "@" in s else _digits(s)


def links(marks: list[str]) -> list[tuple[int, int]]:
    """Skip edges: each candidate with the one before it that has the same start, and the same end."""
    last: dict = {}
    out = set()
    for i, s in enumerate(marks):
        c = _content(s)
        if len(c) >= SHARED:
            for key in (("a", "@" in s, c[:SHARED]), ("z", "@" in s, c[-SHARED:])):
                if key in last:
                    out.add((last[key], i))
                last[key] = i
    return sorted(out)


def _number(kind: str | None) -> int:
    return 0 if kind is None else 1 + KINDS.index(kind)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """Counts of (shape, label), of agreement along both kinds of edges, and of repeated mentions, over all documents."""
    def tally(b: pa.RecordBatch):
        count: Counter = Counter()
        for t in b.column("text").to_pylist():
            if t and _SEEN.search(t):
                nodes = candidates(t, plain_spans(t))
                marks = [t[a:z] for a, z, _ in nodes]
                for m, n in zip(marks, nodes):
                    count["shape", shape(m), _number(n[2])] += 1
                pairs = links(marks)
                accepted = {i for pair in pairs for i in pair if any(nodes[j][2] for j in pair)}
                for i, n in enumerate(nodes):
                    if n[2] is None:
                        count["again", "yes" if i in accepted else "no", 0] += 1
                for what, edges in (("skip", pairs), ("chain", [(i, i + 1) for i in range(len(nodes) - 1)])):
                    for i, j in edges:
                        if nodes[i][2] and nodes[j][2]:
                            count[what, "same" if nodes[i][2] == nodes[j][2] else "other", 0] += 1
        rows = [(*k, v) for k, v in count.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()),
                                           pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], ["what", "name", "label", "n"])

    rows = (map_batches(texts(docs, key, text).select("text"), tally, "what string, name string, label int, n long")
            .groupBy("what", "name", "label").agg(F.sum("n").alias("n")).collect())  # some dozen keys
    return {(r[0], r[1], r[2]): r[3] for r in rows}


class Field:
    """Potentials from counts, and inference in one document."""

    def __init__(self, counts: dict):
        def n(*k):
            return counts.get(k, 0) + 1.0

        self.shapes: dict = {}
        for what, name, _ in counts:
            if what == "shape":
                kinds = np.array([n("shape", name, k) for k in range(1, 5)])
                self.shapes[name] = np.log(kinds / kinds.sum())
        # a turned-down candidate is taken for real about as often as its like is seen in an accepted form
        self.turned_down = float(np.clip(np.log(n("again", "yes", 0) / n("again", "no", 0)), -6.0, -1.0))
        self.skip = self._edge(np.clip(np.log(n("skip", "same", 0) / n("skip", "other", 0)), 2.0, 8.0))
        self.chain = self._edge(np.clip(np.log(n("chain", "same", 0) / n("chain", "other", 0)), -0.5, 0.5), none=0.0)

    @staticmethod
    def _edge(agree: float, none: float | None = None) -> np.ndarray:
        table = np.zeros((5, 5))
        np.fill_diagonal(table, agree)
        if none is not None:
            table[0] = table[:, 0] = none
        return table

    def labels(self, text: str, nodes: list[tuple[int, int, str | None]]) -> list[tuple[int, float]]:
        """(label, its probability) of each node by loopy sum-product."""
        marks = [text[a:z] for a, z, _ in nodes]
        own = np.zeros((len(nodes), 5))
        for i, (m, node) in enumerate(zip(marks, nodes)):
            if node[2]:
                own[i] = -30.0
                own[i, _number(node[2])] = 0.0
            else:
                own[i, 1:] = self.turned_down + self.shapes.get(shape(m), np.full(4, np.log(0.25)))
        edges = [(i, j, self.skip) for i, j in links(marks)] + [(i, i + 1, self.chain) for i in range(len(nodes) - 1)]
        if not edges:
            return self._read(own)
        tables = np.array([t for _, _, t in edges] + [t.T for _, _, t in edges])
        source = np.array([i for i, _, _ in edges] + [j for _, j, _ in edges])
        target = np.array([j for _, j, _ in edges] + [i for i, _, _ in edges])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        message = np.zeros((len(source), 5))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            sent = belief[source] - message[back]
            new = np.logaddexp.reduce(sent[:, :, None] + tables, axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            step = np.abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if step < 1e-4:
                break
        belief = own.copy()
        np.add.at(belief, target, message)
        return self._read(belief)

    @staticmethod
    def _read(belief: np.ndarray) -> list[tuple[int, float]]:
        p = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
        best = p.argmax(axis=1)
        return list(zip(best.tolist(), p[np.arange(len(p)), best].tolist()))

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(plain spans, all spans)."""
        plain = plain_spans(text)
        nodes = candidates(text, plain)
        if len(nodes) == len(plain):
            return plain, plain
        added = [(a, z, KINDS[k - 1]) for (a, z, kind), (k, p) in zip(nodes, self.labels(text, nodes))
                 if kind is None and k and p > 0.5]
        return plain, sorted(plain + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame, counts: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): numbers and list of plain spans, list of all spans."""
    def judge(b: pa.RecordBatch):
        field = Field(counts)
        plain, every = [], []
        for t in b.column("text").to_pylist():
            p, e = field.spans(t) if t and _SEEN.search(t) else ([], [])
            plain.append(p), every.append(e)
        kinds = [Counter(k for *_, k in p) for p in plain]
        told = [[",".join(f"{k}:{a}:{z}" for a, z, k in s) for s in side] for side in (plain, every)]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array([c[k] for c in kinds], pa.int64()) for k in KINDS], *[pa.array(t, pa.string()) for t in told]],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return map_batches(texts(docs, key, text), judge, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(docs: DataFrame, counts: dict, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    def cover(b: pa.RecordBatch):
        field = Field(counts)
        out = []
        for t in b.column(text).to_pylist():
            if t and _SEEN.search(t):
                parts, at, until = [], 0, 0
                for a, z, kind in field.spans(t)[1]:
                    if a >= until:
                        parts += [t[at:a], f"[{kind}]"]
                    at = until = max(until, z)
                t = "".join(parts) + t[at:]
            out.append(t)
        return b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))

    return map_batches(docs, cover, docs.schema)
