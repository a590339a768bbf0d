"""Suffix arrays, conversation repair and periodic runs against brute force, with odd inputs."""

import hashlib
import heapq
import random

import numpy as np
import pytest

from torqueline.llm import conversation_repair, induced_sort, periodic_runs, suffix_dedup

SCHEMA = "doc_id long, text string, spans string, tag int, block int"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in texts], SCHEMA).repartition(5)


def key(data, i, horizon):
    s = data[i : i + horizon]
    k = s.find(b"\xfe")
    return s[: k + 1] if k >= 0 else s


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize(("memory", "block"), [(50, 7), (1 << 20, 13), (1 << 20, 1 << 18)])
def test_suffixes(monkeypatch, memory, block):
    """Order and common prefixes, with queues in memory and on disk, long runs and repeated parts."""
    monkeypatch.setattr(induced_sort, "MEMORY", memory)
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = random.Random(3)
    for horizon in (3, 8, 20, 100):
        parts = []
        for _ in range(12):
            alphabet = rng.choice(["ab", "a", "abcdefghij ", "xyz\x00"])
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            parts.append(s + rng.choice(parts) + s[:5] if parts and rng.random() < 0.5 else s)
        data = b"".join(p.encode() + b"\xfe" for p in parts)
        blocks = list(induced_sort.suffixes(np.frombuffer(data, np.uint8), horizon))
        place, prefix = (np.concatenate(x).tolist() for x in zip(*blocks, strict=True))
        assert sorted(place) == list(range(len(data)))
        for before, now, n in zip(place, place[1:], prefix[1:], strict=False):
            a, b = key(data, before, horizon), key(data, now, horizon)
            if b"\xfe" not in a[: common(a, b) + 1]:
                assert a >= b
                assert n == common(a, b)


def repeated_bytes(rows, size):
    """{doc_id: (bytes, removed, spans, digest)} of rows with different ids."""
    raw = {k: (t or "").encode() for k, t in rows}
    first, out = {}, {}
    for k in sorted(raw):
        for i in range(len(raw[k]) - size + 1):
            first.setdefault(raw[k][i : i + size], (k, i))
    for k, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] != (k, i):
                gone[i : i + size] = b"\x01" * size
        left = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(t), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(40), say(60)
    texts = {i: say(rng.randint(1, 60)) + (f"\n{passage} {i}" if i % 3 else "") for i in range(60)}
    texts |= {100 + i: base[: 200 + i] + say(i) for i in range(12)}
    return texts | {200: "", 201: None, 202: "x" * 5000, 203: "ha " * 2000, 204: "é" * 300, 205: passage, 206: passage, 207: "a" * 47, 208: "y" + "x" * 300, -5: base}


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    """Removed bytes agree, whether anchors are hot or not; equal rows count as one document, null ids lose nothing."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = list(corpus().items())
    found = suffix_dedup.repeat_digests(frame(spark, rows), 64).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == repeated_bytes(rows, 64)
    kept = {r.doc_id: r.kept for r in suffix_dedup.without_repeated_bytes(frame(spark, rows), 64).collect()}
    assert all(hashlib.sha256(kept[r.doc_id]).hexdigest() == r.kept_sha256 for r in found)


def test_suffix_dedup_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text), (1, text), (None, text), (2, text), (None, None)]
    found = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix_dedup.repeat_digests(frame(spark, rows), 48).collect())
    assert found == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (2, len(text), 1)]
    assert suffix_dedup.repeat_digests(frame(spark, []), 48).collect() == []
    with pytest.raises(ValueError, match="size"):
        suffix_dedup.repeat_digests(frame(spark, rows), 300)


def cheapest(rows):
    """(cost, audit) of the least edits, by search over (cost, letters)."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, t, state = heapq.heappop(heap)
        if (t, state) in done:
            continue
        if t == len(rows) and state in (0, 3):
            return cost, audit
        done.add((t, state))
        heapq.heappush(heap, (cost + 3, audit + "I", t, after[state]))
        if t < len(rows):
            initial, fault = rows[t]
            heapq.heappush(heap, (cost + 4, audit + "D", t + 1, state))
            if fault not in (1, 2):
                late = 3 if fault == 3 else 0
                heapq.heappush(heap, (cost + 3 + late, audit + "R", t + 1, after[state]))
                if kept := {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((state, initial)):
                    heapq.heappush(heap, (cost + late, audit + "K", t + 1, kept))
    return None


@pytest.mark.parametrize("block", [4096, 3, 5])
def test_least_edits(monkeypatch, block):
    """Costs and letters, with conversations whole and cut into blocks."""
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    monkeypatch.setattr(conversation_repair, "BLOCKS", 2)
    rng = random.Random(1)
    for _ in range(80):
        turns, n = rng.randint(0, 14), rng.randint(1, 9)
        all_ = [[(rng.choice([0, 1, 2, 1, 2, 3]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(turns)] for _ in range(n)]
        initial, fault = (np.array([[c[t][j] for c in all_] for t in range(turns)], np.int64).reshape(turns, n) for j in (0, 1))
        cost, audits = conversation_repair.least_edits(initial, fault)
        assert [(c, a.decode()) for c, a in zip(cost.tolist(), audits, strict=True)] == [cheapest(c) for c in all_]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy string, present string, kind int")


def test_conversation_repair(spark, monkeypatch):
    """Counts, order, nulls, a conversation that goes to a file, and one whose rows are all dropped."""
    monkeypatch.setattr(conversation_repair, "SPOOL_BYTES", 100)
    monkeypatch.setattr(conversation_repair, "RECENT", 4)
    extra = ("c", "p", 1)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 20}.", *extra) for t in range(60)]
    rows += [(None, None, None, None, *extra), (8, 3, "", "Nothing", *extra)]
    damaged = conversation_repair.damaged(rows_of(spark, rows))
    by_conv = {}
    for r in sorted(damaged.where("present").collect(), key=lambda r: (r.conv_id or 0, r.turn is not None, r.turn or 0, r.role, r.text, r.copy)):
        by_conv.setdefault(r.conv_id, []).append(r)
    found = {r.conv_id: r for r in conversation_repair.repair_digests(damaged).collect()}
    assert set(found) == {7, 8, None}
    texts = {}
    for r in conversation_repair.repaired_conversations(damaged).collect():
        texts.setdefault(r.conv_id, []).append((r.turn, f"{r.role}:{r.text}"))
    for conv, r in found.items():
        seen, faults, listed = set(), [], by_conv.get(conv, [])
        for x in listed:
            last = x.text.rstrip(" \t\n\r\x0b\x0c")[-1:]
            faults.append(1 if not last else 2 if (x.role, x.text) in seen else 3 if last not in ".!?" else 0)
            seen.add((x.role, x.text))
        assert (r.cost, r.audit) == cheapest([({"s": 0, "u": 1, "a": 2}.get(x.role[:1], 3), f) for x, f in zip(listed, faults, strict=True)])
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(k) for k in (1, 2, 3))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(x for _, x in sorted(texts.get(conv, []))).encode()).hexdigest()
    assert conversation_repair.repair_digests(conversation_repair.damaged(rows_of(spark, []))).collect() == []


def runs_of(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, p, n) for (s, n), p in found.items())


def test_periodic_runs(spark):
    """All runs, digests and collapsed texts; nested and Fibonacci runs, Thue-Morse words (equal hashes), nulls and repeats."""
    rng, rows = random.Random(5), [(900, None), (901, ""), (902, " \t"), (903, "a " * 40), (903, "a " * 40), (None, "b c " * 9)]
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            if words and rng.random() < 0.4:
                words += words[rng.randrange(len(words)) :] * rng.randint(1, 4)
            words += [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 15))]
        rows.append((k, " ".join(words[:200])))
    a, b, t = ["a"], ["a", "b"], [0]
    while len(b) < 200:
        a, b = b, b + a
    while len(t) < 1 << 9:
        t += [1 - x for x in t]
    rows += [(904, " ".join(b)), (905, " ".join(map(str, t)))]
    docs = frame(spark, rows)
    want = {(k, s, n, p) for k, x in rows for s, p, n in runs_of((x or "").split())}
    assert {tuple(r) for r in periodic_runs.periodic_runs(docs).collect()} == want
    texts = {r.doc_id: r.text for r in periodic_runs.collapsed_texts(docs).collect()}
    assert texts[900] is None
    for r in periodic_runs.run_digests(docs, 12, periodic_runs.made_periodic).collect():
        words = [w.encode() for w in (dict(rows)[r.doc_id] or "").split()]
        words = [w.decode() for w in periodic_runs.made_periodic(words, r.doc_id)]
        runs = runs_of(words)
        gone = {i for s, p, n in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda x: (x[2], -x[0], -x[1]), default=None)
        assert (r.n_runs, r.start, r.period, r.length) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[2] // best[1] if best else None)
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert periodic_runs.run_digests(frame(spark, [])).collect() == []


def test_plain_comparison_agrees():
    """The comparison that stands in where hashes fail gives the same runs."""
    rng = random.Random(2)
    texts = [[b"%d" % rng.randrange(2) for _ in range(120)] + [b"x", b"y"] * k for k in range(12)]
    words = periodic_runs._Words(texts)
    assert [x.tolist() for x in words.runs(12)] == [x.tolist() for x in words._compared(12)]


def test_only_windows_that_may_repeat_are_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 150, np.uint8).tobytes()
    pieces = [rng.integers(97, 123, 900, np.uint8).tobytes() + (passage if i % 4 == 0 else b"") + rng.integers(97, 123, 300, np.uint8).tobytes() for i in range(20)]
    sizes, real = [], suffix_dedup.suffixes
    monkeypatch.setattr(suffix_dedup, "suffixes", lambda data, size: (sizes.append(len(data)), real(data, size))[1])
    rows = np.array([(i, 0, 7, len(p) - 99) for i, p in enumerate(pieces)], np.int64)
    assert sorted(map(tuple, suffix_dedup._covered(rows, pieces, 100).tolist())) == [(i, 0, 907, 51) for i in (4, 8, 12, 16)]
    assert sum(sizes) == 5 * 151
    assert not len(suffix_dedup._covered(rows[1:4], pieces[1:4], 100)) and len(sizes) == 1
