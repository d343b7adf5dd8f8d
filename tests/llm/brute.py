"""Plain one-machine versions of what the operators compute, to test against."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(FOLD)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, n=13):
    """op3: rows of (doc_id, text)."""
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            least = first.get(tuple(w[i:i + n]))
            if least is not None and (d is None or least < d):
                gone[i:i + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), sha(" ".join(kept))))
    return out


def contaminated(rows, items, n=10):
    """op7: rows of (doc_id, text), items of (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM.findall(lower(text))
        if item is not None and w:
            m = min(n, len(w))
            for i in range(len(w) - m + 1):
                windows[tuple(w[i:i + m])].add(item)
    lengths = {len(g) for g in windows}
    out = []
    for d, text in rows:
        w = ITEM.findall(lower(text))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                g = tuple(w[i:i + m])
                if g in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def near(rows, k=3, num=85, den=100):
    """op2: rows of (doc_id, text) with distinct ids."""
    sets = []
    for d, text in rows:
        w = WORD.findall(lower(text))
        grams = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append((d, grams))
    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            held[g].append(i)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        seen = defaultdict(int)
        for g in s:
            for j in held[g]:
                if j < i:
                    seen[j] += 1
        for j, n in seen.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)], least[find(i)] == d) for i, (d, s) in enumerate(sets)]
