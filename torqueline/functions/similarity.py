"""Vector and string similarity: exact top-k over blocks, Indel ratio, a hashing embedder, Student's t."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..runtime import COPIED_BYTES

#: Rows of a block of queries and of a block of vectors.
QUERY_ROWS, VECTOR_ROWS = 512, 2048


def rounded_half_up(x: np.ndarray, dp: int) -> np.ndarray:
    """x to ``dp`` places as ``F.round`` does it: half up on the shortest decimal of each number."""
    scale = 10.0**dp
    size = np.abs(x) * scale
    out = np.sign(x) * np.floor(size + 0.5) / scale
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-5):  # the product's own error could decide these
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-dp), ROUND_HALF_UP))
    return np.where(size < 2.0**52, out, x) + 0.0


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score, then least id."""
    return np.lexsort((ids, -scores))[:k]


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def _packed(rows: int, keys: int):
    """Rows (keys..., id, embedding) of a task's batches as blocks (keys..., ids, matrix) of one combination of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            if keys:
                table = table.sort_by([(n, "ascending") for n in table.column_names[:keys]]).combine_chunks()
            values = [table.column(i).to_numpy() for i in range(keys)]
            new = np.any([v[1:] != v[:-1] for v in values], axis=0) if keys else np.zeros(max(table.num_rows - 1, 0), bool)
            edge = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
            spans = [(i, min(i + rows, e)) for s, e in zip(edge, edge[1:], strict=False) for i in range(s, e, rows)]
            if not spans:
                continue
            ids = table.column(keys).to_numpy()
            flat = table.column(keys + 1).combine_chunks()
            blocks = [(ids[s:e].tobytes(), _matrix(flat.slice(s, e - s)).tobytes()) for s, e in spans]
            heads = [pa.array(v[[s for s, _ in spans]]) for v in values]
            yield pa.RecordBatch.from_arrays([*heads, pa.array([i for i, _ in blocks], pa.binary()), pa.array([m for _, m in blocks], pa.binary())], [*table.column_names[:keys], "ids", "matrix"])

    return run


def _block_topk(k: int, dp: int):
    """For blocks of vectors against blocks of queries: each query's k best over all of a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row in zip(*b.columns, strict=True):  # blocks are read where they lie
                asked, q, own, x = (v.as_buffer() for v in row)
                asked, own = np.frombuffer(asked, np.int64), np.frombuffer(own, np.int64)
                q, x = np.frombuffer(q).reshape(len(asked), -1), np.frombuffer(x).reshape(len(own), -1)
                for i, s in zip(asked.tolist(), q @ x.T, strict=True):
                    s = rounded_half_up(s, dp)
                    top = _best(own, s, k)
                    ids, scores = own[top], s[top]
                    if i in held:
                        ids, scores = np.r_[held[i][0], ids], np.r_[held[i][1], scores]
                        top = _best(ids, scores, k)
                        ids, scores = ids[top], scores[top]
                    held[i] = ids, scores
        for i, (ids, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    return run


#: Tasks that the vectors which meet one block of queries are spread over.
SPREAD = 8


def packed_topk(vectors: DataFrame, queries: DataFrame, k: int, dp: int, keys: list[str]) -> DataFrame:
    """(query_id, id, raw_score): each task's k best of every query among the vectors with equal keys; ranks are the caller's.

    Vectors are packed into matrices as they are read, without a shuffle, and each block goes to the
    blocks of queries of its keys; it is dealt by that block and a salt of its own, so
    few queries don't make few tasks.  Queries without keys that COPIED_BYTES hold are copied to the tasks,
    and vectors stay where they were read.
    """
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    block = f"{kinds}{', ' if kinds else ''}ids binary, matrix binary"
    count = queries.count()
    n = max(-(-count // QUERY_ROWS), 1)
    q = queries.select(*keys, F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("qb"), F.col("query_id").cast("long"), "embedding")
    q = q.repartition(*keys, "qb").mapInArrow(_packed(QUERY_ROWS, len(keys) + 1), f"{kinds}{', ' if kinds else ''}qb int, ids binary, matrix binary")
    v = vectors.select(*keys, F.col("id").cast("long"), "embedding")
    if not keys and count:
        width = queries.select(F.max(F.size("embedding"))).first()[0] or 0
        if count * 8 * (width + 1) <= COPIED_BYTES:
            both = v.mapInArrow(_packed(VECTOR_ROWS, 0), block).crossJoin(F.broadcast(q.select(F.col("ids").alias("asked"), F.col("matrix").alias("q"))))
            return both.select("asked", "q", "ids", "matrix").mapInArrow(_block_topk(k, dp), "query_id long, id long, score double").withColumnRenamed("score", "raw_score")
    q = q.select(*keys, "qb", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"), F.col("ids").alias("asked"), F.col("matrix").alias("q"))
    v = v.mapInArrow(_packed(VECTOR_ROWS, len(keys)), block)
    v = v.withColumns({"salt": F.pmod(F.xxhash64("ids"), F.lit(SPREAD)).cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    both = v.join(q, [*keys, "qb", "salt"]).select("asked", "q", "ids", "matrix")
    return both.mapInArrow(_block_topk(k, dp), "query_id long, id long, score double").withColumnRenamed("score", "raw_score")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, dp: int = 4) -> DataFrame:
    """(query_id, id, raw_score, rank): the k largest dot products of each query, rounded to ``dp`` places, ties by id.

    vectors has id and embedding, queries query_id and embedding.  Every block of queries
    meets every block of vectors (queries are a stated set, and the smaller side),
    multiplied as matrices on the executors, where a task passes on its own k best of each
    query, so no row for every pair is made.  Scores are rounded before anything is
    ranked, so that a task keeps what the whole would.
    """
    out = packed_topk(vectors.select("id", "embedding"), queries.select("query_id", "embedding"), k, dp, [])
    w = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def multi_query_topk(vectors: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """(query_id, id, raw_score, rank): best score of each vector over a query's variants, first 2k.

    variants has query_id, variant_id and embedding; each variant keeps its own k first.
    """
    each = vector_topk(vectors, variants.select(F.col("variant_id").alias("query_id"), "embedding"), k)
    back = variants.select("query_id", F.col("variant_id").alias("v"))
    best = each.withColumnRenamed("query_id", "v").join(back, "v").groupBy("query_id", "id").agg(F.max("raw_score").alias("raw_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * k)


def indel(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def letters(word: str) -> str:
    """SQL of a word's letters, each with how often it came before: equal arrays' intersection is that of multisets."""
    return f"transform(split({word}, ''), (c, i) -> concat(c, size(filter(slice(split({word}, ''), 1, i + 1), d -> d = c))))"


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel`` of two columns, for words of any length."""
    return pd.Series([200.0 * common_letters(x, y) / (len(x) + len(y)) if x and y else 100.0 * (x == y) for x, y in zip(a, b, strict=True)], dtype=float)


def indel_ratio(a: str, b: str) -> str:
    """SQL of ``indel``: a row of the common-subsequence table is the running maximum of what the row above and the letter allow."""
    letters_b = f"split({b}, '')"
    allowed = f"transform(y, (c, j) -> greatest(row[j + 1], row[j] + int(c = x)))"  # noqa: F541
    running = f"transform({allowed}, (v, j) -> array_max(slice({allowed}, 1, j + 1)))"
    longest = f"transform(array({letters_b}), y -> element_at(aggregate(split({a}, ''), array_repeat(0, size(y) + 1), (row, x) -> concat(array(0), {running})), -1))[0]"
    return f"case when {a} = '' and {b} = '' then 100D when {a} = '' or {b} = '' then 0D else 200D * {longest} / (length({a}) + length({b})) end"


def hashed_embedding(text: str, width: int = 256) -> str:
    """SQL of a unit vector of hashed words and letter trigrams; a stand-in where no encoder is given."""
    words = f"filter(split(lower({text}), '[^a-z0-9]+'), w -> w <> '')"
    grams = f"flatten(transform({words}, w -> transform(sequence(1, length(w)), i -> substring(concat(' ', w, ' '), i, 3))))"
    slots = f"transform(concat({words}, {grams}), g -> struct(pmod(xxhash64(g), {width}) as at, if(pmod(xxhash64(g, 1), 2) = 0, 1D, -1D) as sign))"
    raw = f"transform(array({slots}), z -> transform(sequence(0, {width - 1}), j -> aggregate(z, 0D, (a, x) -> a + if(x.at = j, x.sign, 0D))))[0]"
    return f"transform(array({raw}), v -> transform(v, x -> x / greatest(sqrt(aggregate(v, 0D, (a, y) -> a + y * y)), 1e-12D)))[0]"


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta of df / (df + t^2), by continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
            c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    if x <= 0:
        return 1.0 if swap else 0.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return 1 - front * f if swap else front * f


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(x, d) if pd.notna(x) and pd.notna(d) and d > 0 else None for x, d in zip(t, df, strict=True)], dtype="float64")
