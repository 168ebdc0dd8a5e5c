"""Small tables with hard rows, and what the contracts say about them, by brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words int, row_key string, keep string, pos int"
LABELS = "doc_id bigint, quality int, toxic int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves; ``ids`` default to positions."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), 1, "k", "x", 7) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(seed: int, parts: list[str], n: int, most: int, between: str = "") -> list[str]:
    """Random texts made of ``parts``."""
    draw = random.Random(seed)
    return [between.join(draw.choice(parts) for _ in range(draw.randrange(most))) for _ in range(n)]


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only_digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 12,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def spans(rules, text):
    """(kind, start, end) by kind, then start."""
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text or "") if ok(m)]


def listed(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def dedup_lines(rows):
    """(doc_id, n_lines, n_dropped, kept text) for (doc_id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    first: dict[str, int] = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(rows, items):
    """(doc_id, n_words, n_hit, items, contaminated) for (doc_id, text)."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[s : s + 13]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(rows, similarity=85):
    """(doc_id, n_shingles, component_id, kept) for (doc_id, text) with different ids."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i), root(i) == i) for i in ids]


def bag(rows) -> Counter:
    return Counter(map(tuple, rows))
