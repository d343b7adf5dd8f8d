"""Repair of conversation structure: turns in an order of roles ``(system? (user assistant)+)?``, at the least cost of edits.

Faults and the alignment are in ``alignment``. Turns are taken by turn number, nulls first; those of one number by role, then by the md5 of their text, so
equal turns are neighbours. Roles count by their first character; new ones are 'user' or 'assistant', inserted turns have no text.

Range slices of (conversation, turn) are written once, so a conversation with a third of all turns lies in many of them. A first occurrence per (conversation,
role, text) comes from a minimum that combines before its shuffle. Runs of at most ``RUN`` turns, without their texts, are aligned each for every
pair of states they can be entered and left in; joining a conversation's runs needs a dozen numbers of each, a few bits a turn. The texts meet their audits in a
sorted stream: a task holds one turn at a time. Only the digest needs a whole conversation in one task, as SHA-256 has no parallel form; ``repaired``,
the turns themselves, deals runs out.

Null conversation ids are one conversation. Null roles and texts are one space. Null turns come first and don't count in gaps. Texts of any length
and characters, repeated rows, an empty table, and other columns, whatever their names, are fine. A conversation all of whose turns are dropped is
reported with zeros. gaps beyond the long range are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import alignment
from assayer.session import settled

#: Turns of a run that is aligned at once.
RUN = 512
_BLANK = " \t\n\x0b\f\r"
_NAMES = {"u": "user", "a": "assistant"}


def turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Only what the operator reads: (conv_id, turn, role, text, gone)."""
    return df.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def damaged(df: DataFrame) -> DataFrame:
    """Turns with faults dealt by crc32 of ``conv_id:turn``; dropped ones stay as marks without text, so that no conversation is lost."""
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = (F.when(draw.isin(0, 1), "").when(draw == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return df.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                     (draw == 0).alias("gone"), F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add slice, at (place in the slice), rank (place in the conversation's part of it) and whether the conversation surely begins here."""
    part, at, start, first, before = TaskContext.get().partitionId(), 0, 0, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        earlier = pa.concat_arrays([ids.slice(0, 1) if before is None else before, ids.slice(0, len(ids) - 1)])
        same = pc.or_(pc.fill_null(pc.equal(ids, earlier), False), pc.and_(pc.is_null(ids), pc.is_null(earlier)))
        new = ~same.to_numpy(zero_copy_only=False)
        places = at + np.arange(len(ids))
        starts = np.maximum.accumulate(np.where(new, places, start))
        rank = places - starts
        begins = (starts > 0) if first else np.ones(len(ids), bool)
        at, start, first, before = at + len(ids), int(starts[-1]), first and not new.any(), ids.slice(len(ids) - 1, 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int64)), pa.array(places), pa.array(rank), pa.array(begins)],
                                         names=[*batch.schema.names, "slice", "at", "rank", "begins"])


def ordered(rows: DataFrame, length: int = RUN) -> DataFrame:
    """Turns in slices of their order, written once, with their places and the place where their run starts."""
    end = F.substring(F.rtrim(F.col("text"), F.lit(_BLANK)), -1, 1)
    told = rows.select("*", F.md5("text").alias("digest"), F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise(".").alias("fault"),
                       F.monotonically_increasing_id().alias("read"))  # splits rows that are equal in all else
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "read")]
    sliced = told.repartitionByRange(*order).sortWithinPartitions(*order).drop("read")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sliced.schema) + ", slice long, at long, rank long, begins boolean"
    return settled(sliced.mapInArrow(_numbered, schema)).withColumn("start", F.col("at") - F.col("rank") % length).withColumn(
        "begins", F.col("begins") & (F.col("rank") < length))


def runs(rows: DataFrame) -> DataFrame:
    """A row per run: (conv_id, slice, start, initials, faults, begins, turns), dropped turns left out."""
    sound = rows.where("NOT gone AND fault <> 'b'")
    firsts = sound.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("slice", "at")).alias("first")).select(
        F.col("first.slice").alias("slice"), F.col("first.at").alias("at"), F.lit(True).alias("new"))
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", "slice", "start", "at", "begins", "gone", "fault",
                         F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    fault = F.when(F.col("fault") == "b", "b").when(F.col("new").isNull(), "d").otherwise(F.col("fault"))
    marked = narrow.join(firsts, ["slice", "at"], "left")
    live = F.when(~F.col("gone"), F.struct("at", "initial", fault.alias("fault"), "turn"))
    grouped = marked.groupBy("conv_id", "slice", "start").agg(F.min("begins").alias("begins"), F.sort_array(F.collect_list(live)).alias("live"))
    return grouped.select("conv_id", "slice", "start", "begins",
                          F.array_join("live.initial", "").alias("initials"), F.array_join("live.fault", "").alias("faults"), F.col("live.turn").alias("turns"))


_WAYS = "array<struct<entry: string, end: string, cost: long, rank: int, audit: string>>"


def aligned(found: DataFrame) -> DataFrame:
    """Runs with their cheapest ways between states, and what the conversation's numbers need of them."""
    def body(batches):
        for batch in batches:
            ways, span = [], []
            for row in batch.select(["initials", "faults", "begins", "turns"]).to_pylist():
                made = []
                for _, same in groupby(alignment.align(row["initials"], row["faults"], row["begins"]), key=lambda w: w[0]):
                    ranked = sorted(same, key=lambda w: w[3])
                    made += [{"entry": e, "end": x, "cost": c, "rank": k, "audit": a} for k, (e, x, c, a) in enumerate(ranked)]
                ways.append(made)
                known = [t for t in row["turns"] if t is not None]
                span.append({"low": known[0], "high": known[-1], "distinct": len(set(known))} if known else None)
            kept = [batch.column(c) for c in ("conv_id", "slice", "start", "initials", "faults")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(span, pa.struct([(n, pa.int64()) for n in ("low", "high", "distinct")])), pa.array(ways, pa.list_(pa.struct(
                [("entry", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])))],
                names=["conv_id", "slice", "start", "initials", "faults", "span", "ways"])

    kind = found.schema["conv_id"].dataType.simpleString()
    return found.mapInArrow(body, f"conv_id {kind}, slice long, start long, initials string, faults string, "
                                  f"span struct<low: long, high: long, distinct: long>, ways {_WAYS}")


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _joined(parts: list[dict]) -> tuple[dict, list[dict]]:
    """A conversation's numbers, and for each run the states it is entered and left in."""
    cost, states = alignment.join([{(w["entry"], w["end"]): (w["cost"], w["rank"]) for w in p["ways"]} for p in parts])
    low = high = None
    distinct, illegal, last = 0, 0, ""
    for p in parts:
        illegal += p["illegal"] + (bool(last and p["first"]) and alignment.illegal_pairs(last + p["first"]))
        last = p["last"] or last
        if p["span"]:
            distinct += p["span"]["distinct"] - (high == p["span"]["low"])
            low, high = p["span"]["low"] if low is None else low, p["span"]["high"]
    gaps = 0 if low is None else high - low + 1 - distinct
    numbers = {"gaps": gaps if gaps < 2 ** 63 else None, "illegal": illegal, "cost": cost}
    for name in ("blank", "duplicate", "truncated"):
        numbers[name] = sum(p[name] for p in parts)
    return numbers, [{"slice": p["slice"], "start": p["start"], "entry": e, "end": x} for p, (e, x) in zip(parts, states)]


def audits(found: DataFrame) -> DataFrame:
    """(conv_id, slice, start, entry, audit, numbers): the run's edits in the cheapest repair; numbers only with a conversation's first run.

    The last run's audit has what is inserted at the very end.
    """
    found = settled(aligned(found))

    def count(fault: str) -> Column:
        return (F.length("faults") - F.length(F.replace(F.col("faults"), F.lit(fault), F.lit("")))).cast("long")

    brief = F.struct("slice", "start", "span", F.substring("initials", 1, 1).alias("first"), F.substring("initials", -1, 1).alias("last"),
                     count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"),
                     F.transform("ways", lambda w: w.dropFields("audit")).alias("ways"), _illegal(F.col("initials")).alias("illegal"))
    grouped = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "start", brief.alias("brief")))).alias("parts")).select(
        "conv_id", F.col("parts.brief").alias("parts"))
    numbers_type = pa.struct([(n, pa.int64()) for n in _NUMBERS])
    step_type = pa.struct([("slice", pa.int64()), ("start", pa.int64()), ("entry", pa.string()), ("end", pa.string())])

    def body(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, steps = _joined(batch.column("parts")[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(k, 1), pa.array([numbers], numbers_type), pa.array([steps], pa.list_(step_type))],
                                                 names=["conv_id", "numbers", "steps"])

    kind = found.schema["conv_id"].dataType.simpleString()
    chosen = grouped.mapInArrow(body, f"conv_id {kind}, numbers struct<{', '.join(f'{n}: long' for n in _NUMBERS)}>, "
                                      "steps array<struct<slice: long, start: long, entry: string, end: string>>")
    steps = chosen.select("numbers", F.size("steps").alias("many"), F.posexplode("steps").alias("place", "step")).select(
        F.when(F.col("place") == 0, F.col("numbers")).alias("numbers"), (F.col("place") == F.col("many") - 1).alias("final"), "step.*")
    ending = F.create_map(*[F.lit(v) for s, (e, _) in alignment.ENDING.items() for v in (s, e)])
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["end"] == F.col("end")))[0]
    return found.join(steps, ["slice", "start"]).select(
        "conv_id", "slice", "start", "entry", F.concat(way["audit"], F.when(F.col("final"), ending[F.col("end")]).otherwise("")).alias("audit"), "numbers")


def _illegal(initials: Column) -> Column:
    """Neighbouring initials other than su, ua and au."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(initials) - 1, F.lit(1))), lambda k: F.substr(initials, k, F.lit(2)))
    return F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("long")


def _stream(rows: DataFrame, edits: DataFrame, *deal: str) -> DataFrame:
    """Each run's edits before its turns, in order, dealt by the columns ``deal``."""
    texts = rows.where("NOT gone").select("conv_id", "slice", "at", "start", F.lit(1).alias("kind"), "role", "text",
                                          F.lit("").alias("audit"), F.lit("").alias("entry"),
                                          F.lit(None).cast(edits.schema["numbers"].dataType).alias("numbers"))
    marks = edits.select("conv_id", "slice", F.col("start").alias("at"), "start", F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"),
                         "audit", "entry", "numbers")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "slice", "at", "kind")]
    return marks.unionByName(texts).repartition(*deal).sortWithinPartitions(*order)


class _Repair:
    """Applies audits to turns as they stream by: ``mark`` starts a run, ``turn`` gives what stands before and for a turn."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, ""

    def mark(self, audit: str, entry: str) -> None:
        self.audit, self.at, self.state = audit, 0, entry

    def _new(self) -> str:
        self.state = alignment.following(self.state)
        return _NAMES[self.state]

    def inserted(self) -> list[tuple[str, str]]:
        made = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            made.append((self._new(), ""))
            self.at += 1
        return made

    def turn(self, role: str, text: pa.Scalar) -> list[tuple[str, str]]:
        made, edit = self.inserted(), self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = role[0]
            made.append((role, text.as_py()))
        elif edit == "R":
            made.append((self._new(), text.as_py()))
        # insertions at the very end follow the last turn
        return made + (self.inserted() if self.audit[self.at:].strip("I") == "" else [])


def report(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{n} long' for n in _NUMBERS)}, audit string, repaired_sha256 string"
    names = ["conv_id", *_NUMBERS, "audit", "repaired_sha256"]

    def body(batches):
        held, repair = None, _Repair()

        def add(made):
            for role, text in made:
                held["digest"].update((("\n" if held["any"] else "") + f"{role}:{text}").encode())
                held["any"] = True

        def out():
            n = held["numbers"]
            return pa.RecordBatch.from_arrays([held["id"], *[pa.array([n[c]], pa.int64()) for c in _NUMBERS], pa.array(["".join(held["audits"])]),
                                               pa.array([held["digest"].hexdigest()])], names=names)

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            marks = columns["kind"].to_numpy() == 0
            for k in range(batch.num_rows):
                if not marks[k]:
                    add(repair.turn(columns["role"][k].as_py(), columns["text"][k]))
                    continue
                numbers, audit = columns["numbers"][k].as_py(), columns["audit"][k].as_py()
                if numbers is not None:
                    if held:
                        yield out()
                    held = {"id": columns["conv_id"].slice(k, 1), "numbers": numbers, "audits": [], "digest": hashlib.sha256(), "any": False}
                held["audits"].append(audit)
                repair.mark(audit, columns["entry"][k].as_py())
                if not audit.strip("I"):  # a run without turns
                    add(repair.inserted())
        if held:
            yield out()

    return _stream(rows, edits, "conv_id").mapInArrow(body, schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, slice, at, place, role, text): the turns after repair in the order of slice, at and place, dealt out by runs."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def body(batches):
        repair = _Repair()
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                if columns["kind"][k].as_py():
                    made = repair.turn(columns["role"][k].as_py(), columns["text"][k])
                else:
                    repair.mark(columns["audit"][k].as_py(), columns["entry"][k].as_py())
                    made = [] if repair.audit.strip("I") else repair.inserted()
                if made:
                    n, one = len(made), np.zeros(len(made), np.int64)
                    ids = columns["conv_id"].take(pa.array(one + k))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(one + columns["slice"][k].as_py()), pa.array(one + columns["at"][k].as_py()),
                                                      pa.array(np.arange(n)), pa.array([r for r, _ in made]), pa.array([t for _, t in made])],
                                                     names=["conv_id", "slice", "at", "place", "role", "text"])

    return _stream(rows, edits, "conv_id", "slice", "start").mapInArrow(
        body, f"conv_id {kind}, slice long, at long, place long, role string, text string")


def repair(rows: DataFrame, length: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Ordered turns and the audits of their runs, from ``turns`` or ``damaged``, for ``report`` and ``repaired``."""
    placed = ordered(rows, length)
    return placed, settled(audits(runs(placed)))
