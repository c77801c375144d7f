"""Nearest neighbours by randomly rotated one-bit codes.

Indexing subtracts the mean of all vectors, scales to unit length, applies a seeded random
rotation and keeps the signs, packed to bits, with two correction scalars: the length, and the
inner product of the unit vector with its code. The inner product with a query is
estimated from the packed bits alone (one table look-up per byte), divided by the second
scalar. The estimate's error is below ``error / sqrt(dim - 1) x sqrt(1 / c^2 - 1)`` but for a
chance that falls fast with ``error``, where c is that scalar. Only vectors whose bound reaches
below the k-th smallest distance found so far are compared on the original vectors.

A search is a stated query set against all rows. Queries go in blocks of a fixed size,
which bounds what is broadcast; each block is one pass over the codes in which no row moves. A task
hands on its k nearest per query, so the last step reads k rows a task and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteloom.llm import common

#: Queries of one pass. With 1,000 dimensions a block has 32 MB.
QUERY_BLOCK = 4096
#: Queries whose estimates are held at once, and rows they are held for.
QUERY_STEP, ROW_STEP = 64, 4096
ERROR = 3.0
SEED = 11


def takes_part(vector: Column) -> Column:
    """No null, no component that is null or not finite, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total += _matrix(batch["vector"], dim).sum(0)
            n += batch.num_rows
        yield pa.record_batch(
            {
                "place": pa.array(range(dim), pa.int32()),
                "total": pa.array(total, pa.float64()),
                "n": pa.array([n] * dim, pa.int64()),
            }
        )

    return run


def _codes(dim: int, mean: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            rest = _matrix(batch["vector"], dim) - mean
            length = np.linalg.norm(rest, axis=1)
            turned = rest / np.where(length > 0, length, 1)[:, None] @ turn
            match = np.where(length > 0, np.abs(turned).sum(1) / np.sqrt(dim), 1)
            bits = np.packbits(turned > 0, axis=1)
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "vector": batch["vector"],
                    "code": pa.array([x.tobytes() for x in bits], pa.binary()),
                    "length": pa.array(length, pa.float64()),
                    "match": pa.array(match, pa.float64()),
                }
            )

    return run


class Index:
    """Codes of every vector that takes part, in the shared folder."""

    def __init__(self, rows: DataFrame, dim: int, mean: np.ndarray, seed: int):
        self.rows, self.dim, self.mean, self.seed = rows, dim, mean, seed


def build_index(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", seed: int = SEED) -> Index:
    """Index every row with an id whose vector takes part.

    Vectors need one length: the most frequent one, the larger of equally frequent ones; rows
    of other lengths take no part. An empty table gives an empty index.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).filter(
        F.col("id").isNotNull() & takes_part(F.col("vector"))
    )
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 1
    rows = rows.filter(F.size("vector") == dim)
    sums = rows.mapInArrow(_sums(dim), "place int, total double, n long").groupBy("place")
    # One row a dimension.
    totals = sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("place").collect()
    mean = np.array([x["total"] / x["n"] if x["n"] else 0.0 for x in totals]) if totals else np.zeros(dim)
    kind = dict(rows.dtypes)["vector"]
    coded = rows.mapInArrow(
        _codes(dim, mean, seed), f"id long, vector {kind}, code binary, length double, match double"
    )
    return Index(common.materialize(coded, "vector-codes"), dim, mean, seed)


def _tables(turned: np.ndarray) -> np.ndarray:
    """For each query and byte of a code, the signed sum of the query's components by byte value."""
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    parts = np.zeros((len(turned), -(-turned.shape[1] // 8) * 8), np.float32)
    parts[:, : turned.shape[1]] = turned
    return np.einsum("qbi,vi->qbv", parts.reshape(len(turned), -1, 8), signs)


class _Nearest:
    """The k nearest so far of each query: distance and id, in order."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.distance, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.limit = np.full(queries, np.inf)

    def add(self, query: np.ndarray, distance: np.ndarray, id: np.ndarray) -> None:
        query, distance, id = (np.concatenate(x) for x in ((self.query, query), (self.distance, distance), (self.id, id)))
        order = np.lexsort((id, distance, query))
        query, distance, id = query[order], distance[order], id[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        kept = rank < self.k
        last = rank == self.k - 1
        self.limit[query[last]] = distance[last]
        self.query, self.distance, self.id = query[kept], distance[kept], id[kept]


def _search(shared, index: tuple, k: int, error: float):
    dim, mean, seed = index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        rest = queries - mean
        reach = np.linalg.norm(rest, axis=1)
        turned = rest / np.where(reach > 0, reach, 1)[:, None] @ rotation(dim, seed)
        steps = [(a, a + QUERY_STEP) for a in range(0, len(queries), QUERY_STEP)]
        found = [_Nearest(len(queries[a:b]), k) for a, b in steps]
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_STEP):
                batch = whole.slice(at, ROW_STEP)
                ids, vectors = batch["id"].to_numpy(), _matrix(batch["vector"], dim)
                codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
                length, match = batch["length"].to_numpy(), batch["match"].to_numpy()
                slack = error * np.sqrt(np.maximum(1 / match**2 - 1, 0)) / np.sqrt(max(1, dim - 1))
                for (a, b), near in zip(steps, found, strict=True):
                    tables = _tables(turned[a:b])
                    dots = np.zeros((b - a if b <= len(queries) else len(queries) - a, len(ids)), np.float32)
                    for byte in range(codes.shape[1]):
                        dots += tables[:, byte][:, codes[:, byte]]
                    # Bits past the last dimension are zero in every code and query.
                    cosine = dots / np.sqrt(dim) / match
                    scale = 2 * reach[a:b, None] * length
                    base = reach[a:b, None] ** 2 + length**2
                    own = query_ids[a:b, None] == ids

                    def compare(q, v, a=a, near=near, vectors=vectors, ids=ids):
                        far = np.sqrt(((vectors[v] - queries[a + q]) ** 2).sum(1))
                        near.add(q, far, ids[v])

                    done = own
                    if np.isinf(near.limit).any():
                        likely = np.argsort(np.where(own, np.inf, base - scale * cosine), axis=1)[:, : 2 * k]
                        q = np.repeat(np.arange(len(dots)), likely.shape[1])
                        v = likely.ravel()
                        q, v = q[~own[q, v]], v[~own[q, v]]
                        compare(q, v)
                        done = own.copy()
                        done[q, v] = True
                    # A little room for rounding, so that equal distances are not lost.
                    bound = base - scale * np.minimum(cosine + slack, 1)
                    q, v = np.nonzero((bound <= near.limit[:, None] ** 2 + 1e-6 * (1 + base)) & ~done)
                    compare(q, v)
        for (a, _), near in zip(steps, found, strict=True):
            yield pa.record_batch(
                {
                    "query_id": pa.array(query_ids[a + near.query], pa.int64()),
                    "id": pa.array(near.id, pa.int64()),
                    "score": pa.array(near.distance, pa.float64()),
                }
            )

    return run


def search(
    index: Index,
    queries: DataFrame,
    *,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
    error: float = ERROR,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest indexed rows, nearest first.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id. Rows
    with the query's own id are left out; with fewer than k others, all are returned. Queries
    that take no part have no result, a query id that occurs twice is asked once (with the
    smaller vector). Rows of the index that share an id count as rows of their own.
    """
    spark = queries.sparkSession
    rows = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & takes_part(F.col("vector")) & (F.size("vector") == index.dim))
    asked = common.materialize(rows.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    blocks = max(1, -(-asked.count() // (block // 2)))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    found = None
    for at in range(blocks):
        # Half full on average; a fuller one is passed over in parts of the block's size.
        part = dealt.filter(F.col("block") == at).select("id", "vector").toArrow()
        for first in range(0, max(1, part.num_rows), block):
            own = part.slice(first, block)
            vectors = _matrix(own["vector"].combine_chunks(), index.dim)
            shared = spark.sparkContext.broadcast((own["id"].to_numpy(), vectors))
            run = _search(shared, (index.dim, index.mean, index.seed), k, error)
            near = index.rows.mapInArrow(run, "query_id long, id long, score double")
            if blocks > 1 or part.num_rows > block:
                near = common.materialize(near, "nearest")
            found = near if found is None else found.unionByName(near)
    order = W.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
