"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers floor(scale * x). For a segment of L components, q.x is at most L * (mean_q * mean_x +
dev_q * dev_x); the same statement bounds the squared distance from below by L * ((mean_q - mean_x)^2 + (dev_q -
dev_x)^2). Summed over 1, 4 and 16 segments this gives bounds from coarse to fine. A pair whose bound is below the
query's k-th best score so far is dropped, the rest get their exact score.

Queries are taken in blocks of bounded size, found by counting. A block's queries travel to every partition of the
rows; each partition keeps k rows a query, and only those that reach the score which a first bounded set of rows
already guarantees. The merge ranks what the partitions kept.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part. Every row whose id
is asked for is a query of its own, also where ids or whole rows repeat; every row but the query's own is its candidate.
Rows with a null id are candidates that lose ties, never queries. Vectors of another length than the query's aren't
compared with it. Other columns of the input are ignored. Scores are exact: in doubles while length * component**2 stays
below 2**53, in whole numbers beyond; components of 2**62 or more, and scores that don't fit a long, are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import written

SCALE = 64
LEVELS = (1, 4, 16)
#: Components in a block of queries (8 bytes each in a task), rows taken to guarantee a score, rows compared at once.
BLOCK_COMPONENTS = 1 << 20
FIRST_ROWS = 4096
CHUNK_ROWS = 1024
RESULT = "query_uid long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, v array<double>) of integer values, for rows that take part; uid tells rows apart once they are written."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~bad
    return vectors.where(usable).select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def segment_statistics(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, each weighted by the root of the segment's length."""
    cuts = np.linspace(0, m.shape[1], min(segments, m.shape[1]) + 1).astype(int)
    means, deviations = np.empty((len(m), len(cuts) - 1)), np.empty((len(m), len(cuts) - 1))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = m[:, a:b]
        means[:, i] = part.mean(1) * np.sqrt(b - a)
        deviations[:, i] = part.std(1) * np.sqrt(b - a)
    return means, deviations


def exact_type(length: int, largest: float) -> type:
    """What inner products of such vectors are exact in."""
    bound = length * int(largest) ** 2
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class _Rows:
    """Vectors of one length with their row numbers and ids; a null id is kept as a flag."""

    def __init__(self, uid: np.ndarray, none: np.ndarray, ids: np.ndarray, m: np.ndarray):
        self.uid, self.none, self.ids, self.m = uid, none, ids, m

    @classmethod
    def by_length(cls, part: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, _Rows]]:
        uid, ids, v = part["uid"].to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else part["uid"].to_numpy(), part["vec_id"], part["v"]
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        none = np.asarray(pa.compute.is_null(ids))
        ids = np.asarray(pa.compute.fill_null(ids, 0))
        lengths = np.asarray(pa.compute.list_value_length(v))
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            yield n, cls(uid[at], none[at], ids[at], np.asarray(v.take(pa.array(at)).flatten()).reshape(len(at), n))


class _Block:
    """Queries of one length, with their statistics and the score that each is sure to reach."""

    def __init__(self, queries: _Rows, floor: np.ndarray, k: int, kind: type):
        self.q, self.floor, self.k, self.kind = queries, floor.astype(float), k, kind
        self.exact = queries.m.astype(kind) if kind is not object else queries.m.astype(np.int64).astype(object)
        self.stats = [np.hstack(segment_statistics(queries.m, s)) for s in LEVELS]
        self.norm = np.linalg.norm(queries.m, axis=1)
        self.rows: list[list[tuple]] = [[] for _ in queries.uid]

    def _scores(self, m: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        m = m.astype(self.kind) if self.kind is not object else m.astype(np.int64).astype(object)
        if len(q) * 4 > len(self.exact) * len(m):
            return (self.exact @ m.T)[q, x]
        parts = [(self.exact[q[i : i + 65536]] * m[x[i : i + 65536]]).sum(1) if self.kind is object else np.einsum("ij,ij->i", self.exact[q[i : i + 65536]], m[x[i : i + 65536]]) for i in range(0, len(q), 65536)]
        return np.concatenate(parts)

    def take(self, rows: _Rows) -> None:
        alive = np.ones((len(self.q.uid), len(rows.uid)), bool)
        norm = np.linalg.norm(rows.m, axis=1)
        for level, segments in enumerate(LEVELS):
            own = np.hstack(segment_statistics(rows.m, segments))
            # one matrix product bounds all pairs; where few are left only those are bounded. Rounding is far below the slack
            if alive.mean() > 0.05:
                alive &= self.stats[level] @ own.T + 1e-9 * np.outer(self.norm, norm) + 1e-6 >= self.floor[:, None]
            else:
                q, x = np.nonzero(alive)
                alive[q, x] = np.einsum("ij,ij->i", self.stats[level][q], own[x]) + 1e-9 * self.norm[q] * norm[x] + 1e-6 >= self.floor[q]
        alive &= self.q.uid[:, None] != rows.uid[None, :]
        q, x = np.nonzero(alive)
        if not len(q):
            return
        scores = self._scores(rows.m, q, x)
        good = scores >= self.floor[q]
        q, x = q[good], x[good]
        scores = scores[good].astype(np.int64) if self.kind is not object else scores[good]
        for i in np.unique(q):
            mine = q == i if len(q) < 64 else slice(*np.searchsorted(q, [i, i + 1]))
            at = x[mine]
            kept = self.rows[i] + list(zip((-scores[mine]).tolist(), rows.none[at].tolist(), rows.ids[at].tolist(), strict=True))
            if len(kept) >= self.k:
                kept = sorted(kept)[: self.k]
                # a double below the k-th score, however large that is
                self.floor[i] = max(self.floor[i], np.nextafter(float(-kept[-1][0]), -np.inf) if self.kind is not np.float64 else -kept[-1][0])
            self.rows[i] = kept

    def result(self) -> dict[str, list]:
        out: dict[str, list] = {"query_uid": [], "query_id": [], "vec_id": [], "score": []}
        for uid, i, rows in zip(self.q.uid.tolist(), self.q.ids.tolist(), self.rows, strict=True):
            for s, none, v in sorted(rows)[: self.k]:
                out["query_uid"].append(uid)
                out["query_id"].append(i)
                out["vec_id"].append(None if none else v)
                out["score"].append(-s)
        return out


def _search(queries: list[tuple[int, _Rows, np.ndarray]], k: int, largest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        blocks = {n: _Block(q, floor, k, exact_type(n, largest)) for n, q, floor in queries}
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                for n, rows in _Rows.by_length(batch.slice(start, CHUNK_ROWS)):
                    if n in blocks:
                        blocks[n].take(rows)
        for b in blocks.values():
            yield pa.RecordBatch.from_pydict(b.result(), schema=pa.schema([(x.split()[0], pa.int64()) for x in RESULT.split(", ")]))

    return run


def _query_blocks(queries: DataFrame, total: int) -> Iterator[list[tuple[int, _Rows]]]:
    """The queries in blocks of about half of BLOCK_COMPONENTS components, by hash of the row; each is read for itself."""
    n = max(1, -(-2 * total // BLOCK_COMPONENTS)) if total > BLOCK_COMPONENTS else 1
    for b in range(n if total else 0):
        yield list(_Rows.by_length(queries.where(F.pmod(F.xxhash64("uid"), F.lit(n)) == b).toArrow()))


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The k rows with the largest inner product for each query: query_id, rank from 1, vec_id, score; ties to smaller ids."""
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, id_column, vector_column, scale), "topk-rows")
    queries = rows.where(F.col("vec_id").isNotNull() & is_query(F.col("vec_id")))
    size = rows.agg(F.max(F.size("v")).alias("longest"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    largest = size["largest"] or 0.0
    if largest >= 1 << 62:
        raise ValueError("components of 2**62 or more aren't exact")
    first = rows.limit(min(FIRST_ROWS, max(1, BLOCK_COMPONENTS // max(1, size["longest"] or 1)))).toArrow().to_batches(max_chunksize=CHUNK_ROWS)
    kept = None
    for block in _query_blocks(queries, int(queries.agg(F.sum(F.size("v"))).first()[0] or 0)):
        sent = []
        for n, q in block:
            start = _Block(q, np.full(len(q.uid), -np.inf), k, exact_type(n, largest))
            for batch in first:
                for m, own in _Rows.by_length(batch):
                    if m == n:
                        start.take(own)
            sent.append((n, q, start.floor))
        sent = spark.sparkContext.broadcast(sent)
        found = written(rows.mapInArrow(lambda batches, sent=sent: _search(sent.value, k, largest)(batches), RESULT), "topk-part")
        kept = found if kept is None else kept.union(found)
    if kept is None:
        kept = spark.createDataFrame([], RESULT)
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
