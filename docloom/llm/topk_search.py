"""Exact top-k inner products with bounds from segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table

K = 5
QUERY_EVERY = 50
#: Rows of a block of candidates and of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096
#: Segments per vector, coarse to fine.
LEVELS = (1, 4, 16)
_CHUNK = 256


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of each row, times the root of the segment's length.

    For two rows q and c, sum(l * ((mq - mc)^2 + (sq - sc)^2)) over segments is
    a lower bound of the squared distance.  With the norms known, that is
    the same as the upper bound f(q) . f(c) of the inner product, where f is
    what this returns.
    """
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int))
    if x.shape[1] == 0:
        return np.zeros((len(x), 1))
    length = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / length
    off = x - np.repeat(mean, length, axis=1)
    dev = np.sqrt(np.add.reduceat(off * off, edges[:-1], axis=1) / length)
    return np.concatenate([mean, dev], axis=1) * np.sqrt(np.concatenate([length, length]))


def inner(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as int64; beyond its range they saturate."""
    d = q.shape[1]
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(d, 1) < 2.0**53:
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 1 << 16):
            out[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[rows[a : a + (1 << 16)]], c[cols[a : a + (1 << 16)]])
        return out
    top = (1 << 63) - 1
    big_q, big_c = [[int(v) for v in r] for r in q], [[int(v) for v in r] for r in c]
    return np.array([max(-top - 1, min(top, sum(a * b for a, b in zip(big_q[i], big_c[j])))) for i, j in zip(rows, cols)], np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of this block for each query.

    Both sets hold integers as doubles.  Ties go to the smaller id; a query's
    own id is no candidate.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    stats = [(segment_statistics(q, s), segment_statistics(c, s)) for s in LEVELS]
    with np.errstate(over="ignore", invalid="ignore"):
        q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    found = []
    for a in range(0, len(q), _CHUNK):
        part = slice(a, a + _CHUNK)
        n = len(q[part])
        slack = 1e-9 * q_norm[part, None] * c_norm[None, :].max(initial=0) + 1e-6
        floor = np.full(n, -np.inf)
        cols = np.arange(len(c))
        alive = c_ids[None, :] != q_ids[part, None]
        for of_q, of_c in stats:
            upper = np.where(alive, of_q[part] @ of_c[cols].T, -np.inf)
            #: the candidates with the best bounds raise the score that the others must reach
            m = min(2 * k, len(cols))
            if m:
                best = np.argpartition(-upper, m - 1, axis=1)[:, :m]
                rows = np.repeat(np.arange(n), m)
                real = np.take_along_axis(alive, best, axis=1).reshape(-1)
                score = np.full(n * m, -np.inf)
                score[real] = inner(q[part], c, rows[real], cols[best.reshape(-1)[real]])
                if m >= k:
                    floor = np.maximum(floor, -np.partition(-score.reshape(n, m), k - 1, axis=1)[:, k - 1])
            alive &= upper + slack >= floor[:, None]
            keep = alive.any(0)
            cols, alive = cols[keep], alive[:, keep]
        rows, at = np.nonzero(alive)
        score = inner(q[part], c, rows, cols[at])
        order = np.lexsort((cols[at], -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score, rows))
        rows, at, score = rows[order], at[order], score[order]
        first = np.searchsorted(rows, rows)
        top = np.arange(len(rows)) - first < k
        found.append((q_ids[part][rows[top]], c_ids[cols[at[top]]], score[top]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows of this length, an id once."""
    t = t.filter(pa.compute.equal(pa.compute.list_value_length(t["vector"]), dim)).sort_by("vec_id")
    ids = t["vec_id"].to_numpy()
    x = np.asarray(t["vector"].combine_chunks().flatten(), np.float64).reshape(len(ids), dim)
    first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    return ids[first], x[first]


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(256 x) for each query.

    Queries are compared with all rows, block by block: a cell holds a block
    of queries and a block of candidates, and hands on k rows a query.  Within
    a cell, bounds from 1, 4 and 16 segments strike out candidates before the
    exact products of those left.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part.  Vectors are compared with those of the same
    length.  Rows of one id count once.  Fewer candidates than k: all of
    them; an empty table gives none.
    """
    x = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("vector"), is_query.alias("is_query"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    spread = lambda width: F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    candidates = rows.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("query_block", spread(query_blocks))
    queries = rows.where("is_query").select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block")).withColumn("block", spread(blocks))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        for dim in sorted(set(pa.compute.list_value_length(q["vector"]).to_pylist())):
            out.append(search_block(*_matrix(q, dim), *_matrix(c, dim), k))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    by = ["block", "query_block"]
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % {QUERY_EVERY} = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
