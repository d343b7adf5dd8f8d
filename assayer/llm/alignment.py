"""Cheapest edits that turn a run of turns into the grammar ``(s?(ua)+)?`` of roles, by Wagner-Fischer alignment.

Of a turn only its role's initial ('s', 'u', 'a', or 'o' for any other) and its fault matter: blank 'b' and duplicate 'd' turns must be deleted,
a truncated one 't' costs more if it stays, '.' is sound. Edits are D(elete), I(nsert), K(eep) and R(erole).

A run is a piece of a conversation. It is entered in a state (what was emitted last: nothing '', 's', 'u' or 'a') and left in one; every target between the
two is an alternating string, with an s before it where nothing came before. All targets with one end are suffixes of one another, so one
table over reversed turns serves every length: cell (i, j) is the cheapest way from the last i turns to the last j roles. An Ukkonen band around the
diagonal leaves out cells that can't lie on a path as cheap as the incumbent, a greedy repair: i - j deletions cost 2 each, j - i insertions 5.
The audits of all lengths with the least cost are traced back and the least in ASCII order stays.

Insertions are made before a turn of the run, never after its last, so audits of joined runs are the joined audits, and two audits of one run are never
prefixes of each other: their order decides whatever follows. The caller appends what a conversation lacks at its very end.
"""

from __future__ import annotations

from functools import lru_cache

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = ("", "s", "u", "a")
#: What completes a conversation that would end in a state, and its cost.
ENDING = {"": ("", 0), "a": ("", 0), "u": ("I", INSERT), "s": ("II", 2 * INSERT)}
_FAR = 1 << 60


def other(role: str) -> str:
    return "a" if role == "u" else "u"


def following(state: str) -> str:
    """The role that comes after a state, an s apart."""
    return "a" if state == "u" else "u"


def _stay(initial: str, fault: str, role: str) -> int:
    """Cost of a turn that stays as ``role``."""
    if fault in "bd":
        return _FAR
    return (KEEP if initial == role else REROLE) + (TRUNCATED if fault == "t" else 0)


def incumbent(initials: str, faults: str, entry: str, end: str) -> int:
    """Cost of some repair between two states, so none that matters costs more."""
    state, kept, cost = entry, 0, 0
    for initial, fault in zip(initials, faults):
        if fault != ".":
            cost += DELETE
        else:
            cost += _stay(initial, fault, following(state))
            state, kept = following(state), kept + 1
    plain = DELETE * len(initials) + 2 * INSERT
    if state == end:
        return min(cost, plain)
    return min(cost + DELETE, plain) if kept > 1 or (kept and entry in "ua" and entry) else plain


class Tails:
    """Costs of turning the last turns into the last roles of the alternating string that ends in ``end``."""

    def __init__(self, initials: str, faults: str, end: str, most: int):
        self.initials, self.faults, self.end, self.n = initials, faults, end, len(initials)
        self.fewer, self.more = most // DELETE, most // INSERT
        self.rows = [{0: 0}]
        for i in range(1, self.n + 1):
            at = self.n - i
            initial, fault, above, row, left = initials[at], faults[at], self.rows[-1], {}, _FAR
            cost = {role: _stay(initial, fault, role) for role in "ua"}
            for j in range(max(0, i - self.fewer), i + self.more + 1):
                best = min(above.get(j, _FAR) + DELETE, left + INSERT)
                if j:
                    best = min(best, above.get(j - 1, _FAR) + cost[self.role(j)])
                left = best
                if best <= most:
                    row[j] = best
            self.rows.append(row)

    def role(self, j: int) -> str:
        """The j-th role from the end."""
        return self.end if j % 2 else other(self.end)

    def cost(self, i: int, j: int) -> int:
        return self.rows[i].get(j, _FAR)

    def audit(self, i: int, j: int) -> str:
        """The least audit of the cheapest edits from the last i turns to the last j roles."""
        made = []
        while i:
            here, at = self.cost(i, j), self.n - i
            if self.cost(i - 1, j) + DELETE == here:
                made.append("D")
                i -= 1
            elif j and self.cost(i, j - 1) + INSERT == here:
                made.append("I")
                j -= 1
            else:
                made.append("K" if self.initials[at] == self.role(j) else "R")
                i, j = i - 1, j - 1
        return "".join(made)


@lru_cache(maxsize=1 << 14)
def align(initials: str, faults: str, begins: bool) -> tuple[tuple[str, str, int, str], ...]:
    """(entry, end, cost, audit) for every pair of states that some edits lead from and to; only entry '' if the run begins its conversation."""
    n = len(initials)
    if not n:
        return tuple((s, s, 0, "") for s in (STATES[:1] if begins else STATES))
    entries = STATES[:1] if begins else STATES
    found = {("", ""): (DELETE * n, "D" * n)}
    system = [(p, TRUNCATED if faults[p] == "t" else KEEP) for p in range(n) if initials[p] == "s" and faults[p] in ".t"]
    if system:
        least = min(k for _, k in system)
        last = max(p for p, k in system if k == least)
        found["", "s"] = (DELETE * (n - 1) + least, "D" * last + "K" + "D" * (n - 1 - last))
    if not begins:
        found["s", "s"] = found["", ""]
    for end in "ua":
        tails = Tails(initials, faults, end, max(incumbent(initials, faults, e, end) for e in entries))
        lengths = range(max(0, n - tails.fewer), n + tails.more + 1)
        starts_u = [(tails.cost(n, j), n, j, "") for j in lengths if j and tails.role(j) == "u"]
        starts_a = [(tails.cost(n, j), n, j, "") for j in lengths if j and tails.role(j) == "a"]
        nothing = [(tails.cost(n, 0), n, 0, "")]
        led = [(DELETE * p + k + tails.cost(n - p - 1, j), n - p - 1, j, "D" * p + "K")
               for p, k in system for j in tails.rows[n - p - 1] if j and tails.role(j) == "u"]
        for entry in entries:
            ways = starts_a if entry == "u" else starts_u
            ways = ways + (led if entry == "" else []) + (nothing if entry == end else [])
            cost = min((w[0] for w in ways), default=_FAR)
            if cost < _FAR:
                found[entry, end] = (cost, min(before + tails.audit(i, j) for c, i, j, before in ways if c == cost))
    return tuple((entry, end, cost, audit) for (entry, end), (cost, audit) in sorted(found.items()))


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def join(runs: list[dict[tuple[str, str], tuple[int, int]]]) -> tuple[int, list[tuple[str, str]]]:
    """Least cost over joined runs, and the states each is entered and left in.

    A run gives for (entry, end) its cost and the rank of its audit among those of the entry.
    """
    ahead = [{s: cost for s, (_, cost) in ENDING.items()}]
    for run in reversed(runs):
        here: dict[str, int] = {}
        for (entry, end), (cost, _) in run.items():
            if end in ahead[-1]:
                here[entry] = min(here.get(entry, _FAR), cost + ahead[-1][end])
        ahead.append(here)
    ahead.reverse()
    state, states = "", []
    for run, here, after in zip(runs, ahead, ahead[1:]):
        ways = [(rank, end) for (entry, end), (cost, rank) in run.items()
                if entry == state and end in after and cost + after[end] == here[state]]
        end = min(ways)[1]
        states.append((state, end))
        state = end
    return ahead[0][""], states
