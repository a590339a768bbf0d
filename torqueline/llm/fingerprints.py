"""Document fingerprints by a homomorphic multiset hash, in DataFrame operations only.

A fingerprint is a sum over the text's paragraphs (lines), so it doesn't depend on their
order, and a paragraph is inserted or deleted by adding or subtracting its own.  It has
two parts.  EQUAL lanes sum a 32-bit hash of each whole paragraph modulo 2**32.  The
LIKE part sums, for each short piece of a paragraph (up to eight words, ending at
punctuation), the bits of its hashes, two counters of 30 bits to a word: a piece takes two
bytes or more and a string less than 2**31, so no counter can carry.  (They are counted
as three of 20 bits a word, over at most CHUNK pieces, and then widened.)  It is a random +-1 projection of the multiset of pieces, so the cosine of two such vectors
estimates how alike two texts are.

Neighbours in the order of ids are found on ids alone (range partitions, then the
borders between them); texts travel once, and each sends its head and LIKE part to the
document before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import write_table

#: Lanes of the first part; hashes of a piece, and words of PER_WORD counters that each fills.
EQUAL, SEEDS, WORDS = 8, 3, 30
PER_WORD, BITS = 2, 30
#: Pieces that counters of 20 bits hold.
CHUNK = (1 << 20) - 1
_MASK = 1 | 1 << 20 | 1 << 40
_PIECE = r"(?:[^\s.,;:!?|]+[ \t]*){1,8}[.,;:!?|]*"


def equal_part(text: str) -> str:
    """SQL of the array of EQUAL lanes."""
    lanes = ", ".join(f"aggregate(lines, 0L, (a, x) -> (a + (xxhash64(x, {1000 + i}) & 4294967295)) & 4294967295)" for i in range(EQUAL))
    return f"transform(array(split({text}, '\\n')), lines -> array({lanes}))[0]"


def like_part(text: str) -> str:
    """SQL of the array of SEEDS * WORDS packed counters; the last element counts the pieces."""
    n = SEEDS * WORDS
    sums = [f"aggregate(q, 0L, (a, x) -> a + (shiftrightunsigned(x.h{s}, {k}) & {_MASK}L))" for s in range(SEEDS) for k in range(20)]
    pieces = f"regexp_extract_all({text}, r'{_PIECE}', 0)"
    hashes = ", ".join(f"'h{s}', xxhash64(p, {2000 + s})" for s in range(SEEDS))
    counter = lambda i: f"(shiftrightunsigned(s[({i}) div 3], cast(20 * (({i}) % 3) as int)) & 1048575L)"
    wide = f"transform(sequence(0, {n - 1}), j -> {counter('2 * j')} + shiftleft({counter('2 * j + 1')}, {BITS}))"
    chunks = f"transform(sequence(0, cast(greatest(size(h) - 1, 0) div {CHUNK} as int)), c -> transform(array(slice(h, c * {CHUNK} + 1, {CHUNK})), q -> array({', '.join(sums)}))[0])"
    total = f"aggregate({chunks}, array_repeat(0L, {n}), (a, s) -> zip_with(a, {wide}, (x, y) -> x + y))"
    return f"transform(array(transform({pieces}, p -> named_struct({hashes}))), h -> concat({total}, array(cast(size(h) as bigint))))[0]"


def text_of(equal: str, like: str) -> Column:
    """The fingerprint as a string of hexadecimal digits."""
    return F.expr(f"concat(array_join(transform({equal}, x -> lpad(hex(x), 8, '0')), ''), '-', array_join(transform({like}, x -> lpad(hex(x & 1152921504606846975), 15, '0')), ''))")


def parts_of(fingerprint: str) -> tuple[str, str]:
    """SQL of the EQUAL lanes and of the LIKE part of a fingerprint's string."""
    digits = lambda at, n: f"cast(conv(substring({fingerprint}, {at}, {n}), 16, 10) as bigint)"
    lanes = f"transform(sequence(0, {EQUAL - 1}), i -> {digits('8 * i + 1', 8)})"
    return lanes, f"transform(sequence(0, {SEEDS * WORDS}), i -> {digits(f'{8 * EQUAL + 2} + 15 * i', 15)})"


def _changed(fingerprint: str, paragraph: str, sign: str) -> Column:
    (equal, like), text = parts_of(fingerprint), f"coalesce({paragraph}, '')"
    equal = f"zip_with({equal}, {equal_part(text)}, (x, y) -> (x {sign} y) & 4294967295)"
    return text_of(equal, f"zip_with({like}, {like_part(text)}, (x, y) -> x {sign} y)")


def inserted(fingerprint: str, paragraph: str) -> Column:
    """The fingerprint (a column's name) of a text with the paragraphs of another column inserted, wherever that is.

    Paragraphs are lines, and an empty text is one empty line: "a" and "b" make "a\nb" or
    "b\na", "" and "b" make "\nb".  A null paragraph is an empty line, a null fingerprint
    stays null.
    """
    return _changed(fingerprint, paragraph, "+")


def deleted(fingerprint: str, paragraph: str) -> Column:
    """The fingerprint of a text without one of its paragraphs; only for a paragraph that the text has."""
    return _changed(fingerprint, paragraph, "-")


def signed(like: str) -> str:
    """SQL of the vector of a LIKE part: twice each counter less the pieces."""
    n = SEEDS * WORDS
    return f"transform(sequence(0, {PER_WORD * n - 1}), i -> cast(2 * (shiftrightunsigned({like}[i div {PER_WORD}], {BITS} * cast(i % {PER_WORD} as int)) & {(1 << BITS) - 1}) - {like}[{n}] as double))"


def likeness(a: str, b: str) -> Column:
    """Cosine of two LIKE parts, 0 where it is negative; 1 for two empty ones, 0 for an empty and another."""
    n = SEEDS * WORDS
    dot = "aggregate(zip_with({}, {}, (p, q) -> p * q), 0D, (s, x) -> s + x)"
    x, y = signed(a), signed(b)
    return F.expr(
        f"case when {a} = {b} then 1D when {a}[{n}] = 0 or {b}[{n}] = 0 then 0D else "
        f"transform(array(named_struct('x', {x}, 'y', {y})), v -> greatest(0D, least(1D, coalesce({dot.format('v.x', 'v.y')} / nullif(sqrt({dot.format('v.x', 'v.x')} * {dot.format('v.y', 'v.y')}), 0D), 0D))))[0] end"
    )


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, version, prev_id, prev_version, prev_chars) of each distinct (id, version) of docs (id, version, chars).

    prev is the document before it by descending id (null ids last), then version; the
    first one's is the last.  Only ids travel; borders of range partitions are matched
    on one row each.  The partitioned ids are written before they are read twice, as a
    second range partitioning may draw its borders elsewhere.
    """
    rows = docs.groupBy("id", "version").agg(F.max("chars").alias("chars"))
    order = [F.col("id").desc_nulls_last(), F.col("version")]
    rows = write_table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    here = F.struct("id", "version", "chars")
    within = Window.partitionBy("part").orderBy(*order)
    placed = rows.select("part", "id", "version", F.lag(here).over(within).alias("prev"), F.when(F.lead(F.lit(1)).over(within).isNull(), here).alias("last"))
    ends = placed.where("last is not null").select("part", "last")
    before = Window.orderBy("part")
    borders = ends.select("part", F.coalesce(F.lag("last").over(before), F.last("last").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("border"))
    joined = placed.join(borders, "part")
    prev = F.coalesce("prev", "border")
    return joined.select("id", "version", prev["id"].alias("prev_id"), prev["version"].alias("prev_version"), prev["chars"].alias("prev_chars"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts.

    docs has doc_id and text; other columns aren't looked at.  Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.
    The next document is that of the next smaller doc_id, after the last the first.  A
    null text is empty.  Rows without doc_id come last in the order; texts under one
    doc_id follow by their hash; repeated equal rows stand at one place and give one row
    each.  A single document is its own next.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), "text", F.coalesce(F.col("doc_id"), F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"))
    key = ["k0", "k1", "version"]
    ids = neighbours(rows.select(F.col("doc_id").alias("id"), "version", F.char_length("text").alias("chars")))
    ids = ids.select(F.coalesce("id", F.lit(0)).alias("k0"), F.col("id").isNull().alias("k1"), "version", F.coalesce("prev_id", F.lit(0)).alias("p0"), F.col("prev_id").isNull().alias("p1"), "prev_version", "prev_chars")
    texts = rows.select(*key, "text").repartition(*key)  # both joins read these columns alone, and so one shuffle
    sent = texts.join(ids, key).select(
        F.col("p0").alias("k0"), F.col("p1").alias("k1"), F.col("prev_version").alias("version"),
        F.expr("substring(text, 1, prev_chars div 3)").alias("head"), F.expr(like_part("text")).alias("next_like"),
    )
    sent = sent.groupBy(*key).agg(F.first(F.struct("head", "next_like")).alias("s")).select(*key, "s.head", "s.next_like")
    both = texts.join(sent, key).select(F.when(~F.col("k1"), F.col("k0")).alias("doc_id"), "text", F.char_length("text").alias("n"), "head", "next_like")
    both = both.select("doc_id", "text", "n", "next_like", F.expr("concat(substring(text, 1, n - n div 3), head)").alias("edited"))
    made = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "next_like", F.expr(equal_part("text")).alias("e"), F.expr(like_part("text")).alias("l"), F.expr(equal_part("edited")).alias("ee"), F.expr(like_part("edited")).alias("el"))
    return made.select("doc_id", "n_chars", "edited_sha256", text_of("e", "l").alias("fingerprint"), text_of("ee", "el").alias("edited_fingerprint"), likeness("l", "el").alias("near_edited"), likeness("l", "next_like").alias("near_next"))
