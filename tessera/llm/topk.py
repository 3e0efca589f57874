"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, partitions, release, table

#: Vectors of a block of queries and of a shard of candidates. A tile is one product of these.
BLOCK, SHARD = 512, 2048
#: Lanes of candidates at most; each gets all blocks of queries.
LANES = 128
TOP = 5
#: Factor that components are scaled with before the floor.
SCALE = 256


def whole(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v array<long>): components floor(SCALE * x). Null vectors, and those with a null or non-finite component, are left out."""
    x = lambda v: v.cast("double")
    bad = lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~F.exists("v", bad))
    return rows.select("id", F.transform("v", lambda v: F.floor(x(v) * SCALE).cast("long")).alias("v"))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one dimension packed into matrices of at most `most` rows: dim, ids, data in the least integers that hold it."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            rows = held.pop(dim)
            ids, data = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            ends = data.min(), data.max()
            data = data.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= ends[0] and ends[1] <= np.iinfo(t).max))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["dim", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                if not dim:
                    continue
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), most):
                    part = rows[at : at + most]
                    data = values[(offsets[part][:, None] + np.arange(dim)[None, :])]
                    held.setdefault(dim, []).append((ids[part], data.reshape(-1)))
                    if sum(len(r[0]) for r in held[dim]) >= most:
                        yield out(dim)
        for dim in sorted(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in single or double precision where every partial sum is an exact one, else in integers.

    No sum of some of a pair's terms exceeds the product of their norms.
    """
    norm = lambda x: float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) ** 0.5
    top = 1.001 * norm(a) * norm(b)
    for kind, exact in ((np.float32, 2**24), (np.float64, 2**53)):
        if top < exact:
            return a.astype(kind) @ b.astype(kind).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: score descending, then the smaller id."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
    return q[rank < k], c[rank < k], s[rank < k]


def _through(qid: np.ndarray, q: np.ndarray, shards: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query of a block over shards (ids, rows), one tile after another.

    Of a tile there are taken the scores that reach the query's k-th so far, so that ties are settled by id.
    Candidates of the query's own id are passed over.
    """
    low = np.iinfo(np.int64).min
    order = np.argsort(qid)
    sorted_ids = qid[order]
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    bound = np.full(len(qid), low)
    for cid, c in shards:
        score = product(q, c)
        at = np.minimum(np.searchsorted(sorted_ids, cid), len(qid) - 1)
        own = np.flatnonzero(sorted_ids[at] == cid)
        score[order[at[own]], own] = low
        if len(cid) > 4 * k and (bound == low).any():
            bound = np.maximum(bound, np.partition(score, len(cid) - k, axis=1)[:, len(cid) - k].astype(np.int64))
        rows, cols = np.divmod(np.flatnonzero(score >= bound.astype(score.dtype)[:, None]), len(cid))
        other = qid[rows] != cid[cols]
        rows, cols = rows[other], cols[other]
        if not len(rows):
            continue
        found = (rows, cid[cols], score[rows, cols].astype(np.int64))
        kept = _best(*(np.concatenate(x) for x in zip(kept, found)), k)
        last = np.cumsum(counts := np.bincount(kept[0], minlength=len(qid))) - 1
        full = counts == k
        bound[full] = kept[2][last[full]]
    return qid[kept[0]], kept[1], kept[2]


def lanes_of(spark: SparkSession) -> int:
    return min(LANES, max(8, partitions(spark)))


def dealt(queries: DataFrame, candidates: DataFrame, lanes: int) -> DataFrame:
    """lane, dim, kind, ids, data: each shard of candidates (kind 0) in a lane, each block of queries (kind 1) in all lanes."""
    shards = _packed(candidates, SHARD).select(F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), "dim", F.lit(0).alias("kind"), "ids", "data")
    blocks = _packed(queries.dropDuplicates(["id"]).repartition(max(1, lanes // 4)), BLOCK)
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "dim", F.lit(1).alias("kind"), "ids", "data")
    return shards.unionByName(blocks)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, ties to the smaller id.

    Takes (id, v array<long>). Candidates are packed into shards, each of which stays in its lane; every
    block of queries is sent to every lane, so tiles cover all pairs and no candidate moves twice. A lane
    holds its shards and lets the blocks through one at a time; it keeps k rows a query, and lanes merge in
    a tree. There are LANES lanes at most whatever the input, so that what is sent and the number of tasks
    don't grow with its square. Vectors of another dimension than the query's don't compete. Rows with the
    query's own id count as the query itself; repeated query rows give one list, repeated candidate rows
    compete each.
    """
    spark = queries.sparkSession
    lanes = lanes_of(spark)
    bound_batches(spark)
    tiles = dealt(queries, candidates, lanes).repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "dim", "kind")

    def run(batches):
        at, shards = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                lane, dim, kind = (batch.column(j)[i].as_py() for j in range(3))
                ids, data = (batch.column(j)[i].as_buffer() for j in (3, 4))
                ids = np.frombuffer(ids, np.int64)
                rows = np.frombuffer(data, f"i{data.size // (len(ids) * dim)}").reshape(-1, dim)
                if at != (lane, dim):
                    at, shards = (lane, dim), []
                if not kind:
                    shards.append((ids.copy(), rows.copy()))
                    continue
                found = _through(ids, rows, shards, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), lane, np.int32)), *(pa.array(x) for x in found)], ["lane", "query_id", "vec_id", "score"])
        shards.clear()
        release()

    part = tiles.mapInArrow(run, "lane int, query_id long, vec_id long, score long")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("c")))), 1, k)
    forks = part.withColumn("fork", F.col("lane") % 8).groupBy("query_id", "fork").agg(best.alias("top"))
    part = forks.select("query_id", F.explode("top").alias("t")).select("query_id", F.col("t.c").alias("vec_id"), (-F.col("t.s")).alias("score"))
    merged = part.groupBy("query_id").agg(best.alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.c").alias("vec_id"), (-F.col("t.s")).alias("score"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.filter(F.col("id") % 50 == 0), vectors)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
