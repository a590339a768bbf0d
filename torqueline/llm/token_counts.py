"""Token counts by a tokenizer file, with overlap resynchronisation.

A text of more than CHUNK characters is encoded in chunks that overlap, with offsets.
The pattern that cuts pre-tokens looks back at nothing and ahead by one character, so
where a pre-token starts at the same place in two chunks, the later chunk's tokens from
there on are the text's own; what the earlier chunk has up to there is its own too, as
long as the place keeps clear of that chunk's end by the longest special string.  Chunks
are spliced at such a place; if their overlap has none, the earlier chunk is widened, by
twice as much each time, and encoded again.  All chunks of a batch go to the library in
one call.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import groups_by_size
from .kernels import batch

#: Characters of a chunk without its overlap, and of an overlap.
CHUNK, OVERLAP = 4096, 256
LIMIT = 512
_BEHIND_BLANK = re.compile(r" [^\W\d_]")


@functools.lru_cache(2)
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def _starts(encoding, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the text where a pre-token starts, and the tokens before each."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    first = np.array([s for s, _ in encoding.offsets], np.int64)
    new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)][: len(words)])
    return first[new] + base, new


def _starts_word(encoding, at: int) -> tuple[int, int] | None:
    """Of the token over the character ``at``: its number and its first character, if it begins a pre-token."""
    t = encoding.char_to_token(at)
    if t is None:
        return None
    word = encoding.token_to_word(t)
    if t and word is not None and encoding.token_to_word(t - 1) == word:
        return None
    return t, encoding.token_to_chars(t)[0]


def _splice(text: str, here, start: int, end: int, known: int, there, then: int, keep: int) -> tuple[int, int] | None:
    """Tokens before one place where a pre-token starts in both chunks, by ``here`` and by ``there``; None if there is none.

    ``here`` covers text[start:end], ``there`` begins at ``then``.  Letters behind a blank
    are looked at first, as nearly all of them will do; then every place.
    """
    for m in _BEHIND_BLANK.finditer(text, then + 1, end - keep + 1):
        at = m.start() + 1
        if at > end - keep:
            break
        a, b = _starts_word(here, at - start), _starts_word(there, at - then)
        if a and b and a[1] + start == b[1] + then > then and a[0] >= known:
            return a[0], b[0]
    a, n_a = _starts(here, start)
    b, n_b = _starts(there, then)
    both, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    ok = (both <= end - keep) & (both > then) & (n_a[i] >= known)
    if not ok.any():
        return None
    k = int(np.argmax(ok))
    return int(n_a[i[k]]), int(n_b[j[k]])


def chunk_places(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """First and last (not included) characters of the chunks of a text of n characters."""
    return [(at, min(at + chunk + overlap, n)) for at in range(0, max(n - overlap, 1), chunk)]


def spliced_count(text: str, places: list[tuple[int, int]], parts: list, tokenizer, keep: int = 64) -> int:
    """Tokens of a text as if encoded whole, from the encodings of its chunks; keep is at least the longest special string's length and two."""
    total, known = 0, 0
    (start, end), here = places[0], parts[0]
    for (then, to), there in zip(places[1:], parts[1:], strict=True):
        wide = end - then
        while end < to or to == len(text) > end:
            found = _splice(text, here, start, end, known, there, then, keep)
            if found:
                total += found[0] - known
                known, start, end, here = found[1], then, to, there
                break
            wide *= 2
            end = min(then + max(wide, 2 * keep), len(text))
            here = tokenizer.encode(text[start:end], add_special_tokens=False)
    return total + len(here) - known


def _count(spec: str, chunk: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(spec)
        keep = 2 + max([62, *(len(x.content) for x in t.get_added_tokens_decoder().values())])
        for b in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(1)], np.int64)
            counts, chunks = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int32)
            for s, e in groups_by_size(sizes, 1 << 19):
                texts = [x or "" for x in b.column(1).slice(s, e - s).to_pylist()]
                places = [chunk_places(len(x), chunk, overlap) for x in texts]
                chunks[s:e] = [len(p) for p in places]
                one = [i for i, p in enumerate(places) if len(p) == 1]
                for i, got in zip(one, t.encode_batch_fast([texts[i] for i in one], add_special_tokens=False), strict=True):
                    counts[s + i] = len(got)
                for i in sorted(set(range(e - s)).difference(one)):
                    text, own = texts[i], places[i]
                    parts = t.encode_batch([text[x:y] for x, y in own], add_special_tokens=False)
                    counts[s + i] = spliced_count(text, own, parts, t, keep)
            yield batch(["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"], [b.column(0), sizes, counts, counts > limit, chunks])

    return run


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks of each row by the tokenizer file at ``path``.

    Counts are the library's, without added special tokens, truncation or padding;
    special strings inside a text count as the library's default has it.  A null text
    is an empty one.  n_chunks is the number of chunks that the text was spliced from.
    Rows are independent: null or repeated ids pass through, an empty table gives an
    empty result.
    """
    with open(path) as f:
        spec = json.dumps(json.load(f))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(spec, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int")
