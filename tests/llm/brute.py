"""Brute-force versions that the operators are compared with."""

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def near_duplicates(texts, size, share):
    """texts: {doc_id: text}; {doc_id: (set size, component)}."""
    sets = {}
    for k, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= share * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def repeated(texts, size=13):
    """{doc_id: (words, removed, digest of what is left)}."""
    w = {k: words(t) for k, t in texts.items()}
    first = {}
    for k in sorted(w):
        for i in range(len(w[k]) - size + 1):
            first.setdefault(tuple(w[k][i : i + size]), k)
    out = {}
    for k, x in w.items():
        gone = set()
        for i in range(len(x) - size + 1):
            if first[tuple(x[i : i + size])] < k:
                gone.update(range(i, i + size))
        left = [v for i, v in enumerate(x) if i not in gone]
        out[k] = (len(x), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest())
    return out


def contamination(texts, items, size=13, share=20):
    windows = collections.defaultdict(set)
    for k, t in items.items():
        w = alnum_words(t)
        for i in range(max(len(w) - size + 1, 1)):
            if w:
                windows[tuple(w[i : i + size])].add(k)
    out = {}
    for k, t in texts.items():
        w = alnum_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[k] = (len(w), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(w))
    return out


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, t):
    d = re.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(p) <= 255 for p in t.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        total = sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d))))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return True


def personal(text):
    return [(k, m.start(), m.end()) for k, p in PERSONAL.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
