"""Faults of conversations, and their cheapest repair by a tensor of state costs.

A repaired conversation's roles are an optional system turn and then pairs of user and
assistant.  The states are: nothing yet, after system, after user, after assistant.
Conversations of one length go through the same arrays, turn by turn: backward costs of
all states of all conversations are updated at once, and edits are traced forward for all
conversations at once along costs that stay least, the edit with the smallest letter
first.  As each state allows one inserted role and one other role, the letters determine
the repair.

Rows come sorted by conversation and turn through bounded batches.  Of a conversation a
task keeps some forty bytes a row; its texts wait in a file of the task beyond
SPOOL_BYTES.  A conversation of more than BLOCK turns is cut into blocks that go through
the arrays side by side: first for each state behind a block, which gives the least costs
through it from state to state, then with the true costs behind it, then traced from each
state before it.  (The digest of a repaired text is one sequential stream by its
definition, so one task reads a conversation's rows, one after the other.)
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batch

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Turns of a block of a long conversation, and blocks whose costs are kept at once.
BLOCK, BLOCKS = 4096, 64
#: Digests of one conversation's rows that are kept as a set; older ones are sorted arrays.
RECENT = 1 << 16
#: Rows of finished conversations that are repaired together, and bytes of texts kept in memory.
GROUP_ROWS, SPOOL_BYTES = 1 << 15, 16 << 20
_NEVER = np.int64(1) << 40
#: The state after an inserted or changed role, by the state before.
_NEXT = np.array([2, 2, 3, 2])
#: The state after a kept turn, by the state before and the role's initial (s, u, a, other); 4 for none.
_KEEP = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
_ROLE = {2: b"user", 3: b"assistant"}
_INITIAL = {b"s": 0, b"u": 1, b"a": 2}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text, present): rows with faults by the CRC of ``conv_id:turn``, modulo 20.

    0 drops the row (present is false; the row tells that the conversation exists), 1
    empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it (copy 1), 4 sets the role to
    user.  A null is one space, in the checksum too; a null turn stays null beside it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("present"),
    )


class _Texts:
    """Lines of texts in order: in memory, or in a file of the task from SPOOL_BYTES on."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # unlinked at once, so that nothing stays behind
        self.sizes = array("q")

    def add(self, role: bytes, text: bytes) -> None:
        self.file.write(role)
        self.file.write(text)
        self.sizes.extend((len(role), len(text)))

    def rows(self) -> Iterator[tuple[bytes, bytes]]:
        self.file.seek(0)
        for r, t in zip(self.sizes[::2], self.sizes[1::2], strict=True):
            yield self.file.read(r), self.file.read(t)


class _Seen:
    """Digests that came before: the latest as a set, the others as few sorted arrays of 16 bytes each."""

    def __init__(self):
        self.recent: set[bytes] = set()
        self.older: list[np.ndarray] = []

    def __contains__(self, digest: bytes) -> bool:
        if digest in self.recent:
            return True
        one = np.array([digest], "S16")
        return any(x[min(int(np.searchsorted(x, one)[0]), len(x) - 1)] == one[0] for x in self.older)

    def add(self, digest: bytes) -> None:
        self.recent.add(digest)
        if len(self.recent) >= RECENT:
            new = np.array(list(self.recent), "S16")
            while self.older and len(self.older[-1]) <= len(new):
                new = np.concatenate([self.older.pop(), new])
            self.older.append(np.sort(new))
            self.recent = set()


class _Conversation:
    """What is kept of one conversation's rows as they come, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.texts = conv_id, _Texts()
        self.initial, self.fault = bytearray(), bytearray()
        self.seen = _Seen()
        self.low = self.high = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        initial = _INITIAL.get(role[:1], 3)
        if self.initial and (self.initial[-1], initial) not in _LEGAL:
            self.illegal += 1
        digest = hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
        last = text.rstrip()[-1:]  # bytes.rstrip() has the same white space
        again = digest in self.seen
        self.fault.append(1 if not last else 2 if again else 3 if last not in b".!?" else 0)
        if not again:
            self.seen.add(digest)
        self.initial.append(initial)
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.texts.add(role, text)

    def repaired(self, audit: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(role, text) of the repaired conversation."""
        rows, state = self.texts.rows(), 0
        for edit in audit:
            if edit == 73:  # I
                state = int(_NEXT[state])
                yield _ROLE[state], b""
                continue
            role, text = next(rows)
            if edit == 68:  # D
                continue
            if edit == 82:  # R
                state = int(_NEXT[state])
                role = _ROLE[state]
            else:
                state = int(_KEEP[state, _INITIAL[role[:1]]])
            yield role, text

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *(self.fault.count(k) for k in (1, 2, 3)), self.illegal]


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs of the states (first axis) where turns may be inserted before what costs that much."""
    out = cost.copy()
    out[2] = np.minimum(cost[2], INSERT + cost[3])
    out[3] = np.minimum(cost[3], INSERT + cost[2])
    out[:2] = np.minimum(cost[:2], INSERT + out[2])
    return out


def _choices(after: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling one turn, by state and conversation; after: costs behind it."""
    n = np.arange(len(initial))
    late = np.where(fault == 3, TRUNCATED, 0) + np.where((fault == 1) | (fault == 2), _NEVER, 0)
    padded = np.concatenate([after, np.full((1, len(initial)), _NEVER)])
    return DELETE + after, padded[_KEEP[:, initial], n] + late, REROLE + after[_NEXT] + late


def _backward(after: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Costs from before each turn of a block on, and behind the block: (turns + 1, states, conversations)."""
    costs = np.empty((len(initial) + 1, *after.shape), np.int64)
    costs[-1] = after
    for t in range(len(initial) - 1, -1, -1):
        costs[t] = _inserted(np.minimum.reduce(_choices(costs[t + 1], initial[t], fault[t])))
    return costs


def _inserts(edits: list[np.ndarray], state: np.ndarray, cost: np.ndarray, better: np.ndarray | None = None) -> None:
    """Traces inserted turns where they lie on a least path and deleting (of costs ``better``) doesn't; changes state."""
    n = np.arange(len(state))
    while True:
        now = INSERT + cost[_NEXT[state], n] == cost[state, n]
        if better is not None:
            now &= better[state, n] != cost[state, n]
        if not now.any():
            return
        edits.append(np.where(now, ord("I"), 0).astype(np.uint8))
        state[now] = _NEXT[state[now]]


def _traced(costs: np.ndarray, initial: np.ndarray, fault: np.ndarray, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Edits of a block's turns along least costs, from given states on, and the states behind it."""
    n, edits = np.arange(len(state)), []
    state = state.copy()
    for t in range(len(initial)):
        gone, kept, _ = _choices(costs[t + 1], initial[t], fault[t])
        _inserts(edits, state, costs[t], gone)
        least = costs[t][state, n]
        delete = gone[state, n] == least
        keep = ~delete & (kept[state, n] == least)
        edits.append(np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R"))).astype(np.uint8))
        state = np.where(delete, state, np.where(keep, _KEEP[state, initial[t]], _NEXT[state]))
    return edits, state


def _letters(edits: list[np.ndarray]) -> list[bytes]:
    return [row[row != 0].tobytes() for row in np.ascontiguousarray(np.stack(edits).T)]


def _behind(n: int) -> np.ndarray:
    """Costs behind the last turn."""
    end = np.full((4, n), _NEVER)
    end[0] = end[3] = 0
    return _inserted(end)


def least_edits(initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Costs and edits of conversations of equal length; initial and fault are (turns, conversations)."""
    turns, n = initial.shape
    if turns > BLOCK:
        both = [_long_edits(initial[:, i], fault[:, i]) for i in range(n)]
        return np.array([c for c, _ in both]), [a for _, a in both]
    costs = _backward(_behind(n), initial, fault)
    edits, state = _traced(costs, initial, fault, np.zeros(n, np.int64))
    _inserts(edits, state, costs[-1])
    return costs[0][0], _letters(edits) if edits else [b""] * n


def _long_edits(initial: np.ndarray, fault: np.ndarray) -> tuple[int, bytes]:
    """Cost and edits of one conversation, by blocks side by side; the last block is shorter."""
    whole = len(initial) // BLOCK * BLOCK
    parts = [(initial[:whole].reshape(-1, BLOCK).T[:, i : i + BLOCKS], fault[:whole].reshape(-1, BLOCK).T[:, i : i + BLOCKS]) for i in range(0, whole // BLOCK, BLOCKS)]
    if whole < len(initial):
        parts.append((initial[whole:, None], fault[whole:, None]))
    through = []  # of each block, [state before, state behind]
    for x, y in parts:
        cost = np.tile(np.where(np.eye(4, dtype=bool), 0, _NEVER), x.shape[1])
        x4, y4 = np.repeat(x, 4, axis=1), np.repeat(y, 4, axis=1)
        for t in range(len(x) - 1, -1, -1):
            cost = np.minimum(_inserted(np.minimum.reduce(_choices(cost, x4[t], y4[t]))), _NEVER)
        through += list(cost.reshape(4, -1, 4).transpose(1, 0, 2))
    borders = [_behind(1)[:, 0]]
    for m in reversed(through):
        borders.append((m + borders[-1]).min(axis=1))
    borders.reverse()
    out, state, at = bytearray(), 0, 0
    for x, y in parts:
        k = x.shape[1]
        costs = np.repeat(_backward(np.stack(borders[at + 1 : at + k + 1], axis=1), x, y), 4, axis=2)
        edits, behind = _traced(costs, np.repeat(x, 4, axis=1), np.repeat(y, 4, axis=1), np.tile(np.arange(4), k))
        letters = _letters(edits)
        for i in range(k):
            out += letters[4 * i + state]
            state = int(behind[4 * i + state])
        at += k
    edits = []
    _inserts(edits, np.array([state]), borders[-1][:, None])
    return int(borders[0][0]), bytes(out) + (_letters(edits)[0] if edits else b"")


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[_Conversation, int, bytes]]]:
    """Conversations of sorted rows with their costs and edits, some at a time."""
    done: list[_Conversation] = []
    open_: _Conversation | None = None

    def solved():
        buckets = defaultdict(list)
        for c in done:
            buckets[len(c.initial)].append(c)
        for length, group in buckets.items():
            step = max(1, GROUP_ROWS // max(length, 1))
            for part in (group[i : i + step] for i in range(0, len(group), step)):
                major = [np.frombuffer(b"".join(x), np.uint8).reshape(len(part), length).T.astype(np.int64) for x in ([c.initial for c in part], [c.fault for c in part])]
                cost, audits = least_edits(*major)
                yield list(zip(part, cost.tolist(), audits, strict=True))

    rows = size = 0
    for b in batches:
        for conv, turn, role, text, present in zip(*(c.to_pylist() if i < 2 or i == 4 else c for i, c in enumerate(b.columns)), strict=True):
            if open_ is None or conv != open_.conv_id:
                if open_ is not None:
                    done.append(open_)
                    if rows >= GROUP_ROWS or size >= SPOOL_BYTES:
                        yield from solved()
                        done, rows, size = [], 0, 0
                open_ = _Conversation(conv)
            if present:
                open_.add(turn, role.as_buffer().to_pybytes(), text.as_buffer().to_pybytes())
                rows, size = rows + 1, size + len(text.as_buffer())
    if open_ is not None:
        done.append(open_)
    yield from solved()


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "present")


def repair_digests(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows are as ``damaged`` gives them; a conversation is sorted by turn, nulls first, rows of
    one turn by role, text and copy.  Of faults each row has its first: blank (no word),
    duplicate (role and text came before), truncated (its last character, but for white
    space, is none of ``.!?``).  audit has the least edits' letters, of equally cheap ones
    the smallest by ASCII.  A null conv_id is a conversation too; one without present
    rows has zeros, an empty audit and the digest of nothing; empty tables give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _repairs(batches):
            out = []
            for c, cost, audit in group:
                digest = hashlib.sha256()
                for i, (role, text) in enumerate(c.repaired(audit)):
                    digest.update(b"\n%b:" % role if i else b"%b:" % role)
                    digest.update(text)
                out.append((c.conv_id, *c.counts(), cost, audit.decode(), digest.hexdigest()))
            *numbers, audit, digest = zip(*out, strict=True)
            yield batch(["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"], [*(pa.array(x, pa.int64()) for x in numbers), list(audit), list(digest)])

    return _sorted(rows).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns counted from 0; those without turns left have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _repairs(batches):
            out, size = [], 0
            for c, _, audit in group:
                for turn, (role, text) in enumerate(c.repaired(audit)):
                    out.append((c.conv_id, turn, role.decode(), text.decode()))
                    size += len(text)
                    if size >= SPOOL_BYTES:
                        yield _turns(out)
                        out, size = [], 0
            if out:
                yield _turns(out)

    return _sorted(rows).mapInArrow(run, "conv_id long, turn long, role string, text string")


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return batch(["conv_id", "turn", "role", "text"], [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)])
