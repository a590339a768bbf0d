"""A stored index of vectors: inverted lists of a coarse quantiser, with batches added and ids deleted.

The quantiser is fitted by k-means on a bounded sample (SAMPLE vectors, those with the
smallest hashes of their ids); every vector goes to the list of its nearest centre.  Under
the index's path are the centres, one folder for each batch (Parquet, partitioned by
list), one for each deletion, and a manifest of them: a batch or deletion counts once its
line is in the manifest, so a batch that fails half-way is never read.  A vector is the
one of the last batch that has its id; a deletion holds for the batches before it.

A search reads only the lists nearest to its queries (partition pruning by a join on the list),
and ranks by exact products: with all lists it equals ``vector_topk``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .similarity import packed_topk, vector_topk

#: Vectors that the quantiser is fitted on, and rounds of k-means.
SAMPLE, ROUNDS = 1 << 16, 12
#: Bits of the salt that spreads a list over several tasks.
SALTS = 8


def matrix(col: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def _centres(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centres of k-means, begun with vectors spread evenly over the sample; an empty list takes the vector farthest from its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = 2 * sample @ centres.T - (centres * centres).sum(1)
        own = near.argmax(1)
        far = np.argsort(near[np.arange(len(sample)), own])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        n = np.bincount(own, minlength=len(centres))
        empty = np.flatnonzero(n == 0)
        centres = total / np.maximum(n, 1)[:, None]
        centres[empty] = sample[far[: len(empty)]]
    return centres


def _nearest(centres: np.ndarray, probes: int, key: str):
    """Each vector with its first lists: the nearest centre's for what is stored, those of the largest products for queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (centres * centres).sum(1) if key == "id" else 0.0
        for b in batches:
            if not b.num_rows:
                continue
            near = 2 * matrix(b.column(1)) @ centres.T - size
            first = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            at = pa.array(np.repeat(np.arange(b.num_rows), first.shape[1]))
            place = pa.array(np.tile(np.arange(first.shape[1], dtype=np.int32), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(first.reshape(-1)), place], [key, "embedding", "list", "place"])

    return run


class VectorIndex:
    """An index at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()  # as many as lists
        self.centres = np.array([r.centre for r in rows], np.float64)

    @classmethod
    def create(cls, vectors: DataFrame, path: str, lists: int = 64, sample: int = SAMPLE, rounds: int = ROUNDS) -> VectorIndex:
        """Fit the quantiser on ``sample`` vectors (id, embedding) and add all of them.  Without vectors there is nothing to fit, an error."""
        spark = vectors.sparkSession
        few = vectors.where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()
        if not few.num_rows:
            raise ValueError("an index needs vectors to begin with")
        centres = _centres(matrix(few.column(0).combine_chunks()), lists, rounds)
        spark.createDataFrame(list(enumerate(centres.tolist())), "list int, centre array<double>").coalesce(1).write.parquet(f"{path.rstrip('/')}/centres")
        index = cls(spark, path)
        index.add(vectors)
        return index

    def _entries(self) -> list[tuple[int, str, str]]:
        """(number, kind, folder) of the manifest; empty before the first."""
        try:
            found = self.spark.read.parquet(f"{self.path}/manifest").orderBy("number").collect()  # a row a batch
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return [(r.number, r.kind, r.folder) for r in found]

    def _commit(self, kind: str, folder: str) -> None:
        number = max((n for n, _, _ in self._entries()), default=-1) + 1
        self.spark.createDataFrame([(number, kind, folder)], "number long, kind string, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def add(self, vectors: DataFrame) -> None:
        """Add a batch of vectors (id, embedding); those whose ids are known take their place.  Rows without id or embedding are left out; of an id repeated in one batch the greatest embedding counts."""
        own = vectors.where("id is not null and embedding is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max("embedding").alias("embedding"))
        kind = own.schema["embedding"].dataType.simpleString()
        folder = f"batch-{uuid.uuid4().hex}"
        dealt = own.mapInArrow(_nearest(self.centres, 1, "id"), f"id long, embedding {kind}, list int, place int").drop("place")
        dealt.repartition("list", F.pmod("id", F.lit(SALTS))).write.partitionBy("list").parquet(f"{self.path}/{folder}")
        self._commit("batch", folder)

    def delete(self, ids: DataFrame) -> None:
        """Delete ids (id) from all batches so far."""
        folder = f"deleted-{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("long")).where("id is not null").distinct().write.parquet(f"{self.path}/{folder}")
        self._commit("deletion", folder)

    def vectors(self) -> DataFrame:
        """(id, embedding, list): what the index holds now."""
        entries = self._entries()
        batches = [(n, f) for n, kind, f in entries if kind == "batch"]
        rows = None
        for i, (n, folder) in enumerate(batches):
            one = self.spark.read.parquet(f"{self.path}/{folder}")
            later = [f for m, kind, f in entries if m > n and kind == "deletion"]
            gone = [self.spark.read.parquet(f"{self.path}/{f}").select("id") for f in later] + [self.spark.read.parquet(f"{self.path}/{f}").select("id") for _, f in batches[i + 1 :]]
            for ids in gone:
                one = one.join(ids, "id", "left_anti")
            one = one.select("id", "embedding", "list")
            rows = one if rows is None else rows.unionByName(one)
        return rows

    def compact(self) -> None:
        """Write what the index holds as one batch; later searches read that alone."""
        folder = f"batch-{uuid.uuid4().hex}"
        self.vectors().repartition("list", F.pmod("id", F.lit(SALTS))).write.partitionBy("list").parquet(f"{self.path}/{folder}")
        number = max(n for n, _, _ in self._entries()) + 1
        self.spark.createDataFrame([(number, "batch", folder)], "number long, kind string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    def _asked(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query_id, embedding, list, place): the lists of each query in the order in which they are probed."""
        kind, lists = queries.schema["embedding"].dataType.simpleString(), len(self.centres)
        return queries.mapInArrow(_nearest(self.centres, min(probes or lists, lists), "query_id"), f"query_id long, embedding {kind}, list int, place int")

    def probes_for(self, recall: float = 0.95, k: int = 10, queries: int = 256) -> int:
        """The least number of probes that finds a share ``recall`` of the true k first, of stored vectors as queries.

        The queries are those with the smallest hashes of their ids, a documented sample;
        their true neighbours are searched among all vectors.
        """
        held = self.vectors()
        q = held.orderBy(F.xxhash64("id"), "id").limit(queries).select(F.col("id").alias("query_id"), "embedding")
        true = vector_topk(held, q, k).select("query_id", "id").join(held.select("id", "list"), "id")
        needed = true.join(self._asked(q, None).select("query_id", "list", "place"), ["query_id", "list"])
        share = dict(needed.groupBy("place").count().collect())  # a row a list at most
        total, found = sum(share.values()), 0
        for place in range(len(self.centres)):
            found += share.get(place, 0)
            if found >= recall * total:
                return place + 1
        return len(self.centres)

    def search(self, queries: DataFrame, k: int, probes: int | None = 8, dp: int = 4) -> DataFrame:
        """(query_id, id, raw_score, rank): the k largest products in the ``probes`` lists nearest to each query; None reads all lists.

        queries has query_id and embedding.  A query goes to each of its lists in blocks
        and meets that list's vectors there, so no row for every pair is made; a list is
        spread over SALTS tasks.
        """
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("query_id is not null and embedding is not null")
        if probes is None:  # every query meets every list, so none is sent to each list by itself
            return vector_topk(self.vectors(), q, k, dp)
        asked = self._asked(q, probes).drop("place")
        rows = self.vectors()
        # the lists that any query asks for prune the partitions that are read
        rows = rows.where(F.col("list").isin([r.list for r in asked.select("list").distinct().collect()]))
        w = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
        found = packed_topk(rows, asked, k, dp, ["list"])
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

