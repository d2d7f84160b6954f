"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into 1, 4, 16, then half as many segments as it has components, each described by its
mean and deviation. For segments of length L, ``q.x <= sum L (mean_q mean_x + dev_q dev_x)``
(Cauchy-Schwarz on what deviates from the means), which is an upper bound of the inner product and, with
the norms, a lower bound of the distance ``|q|^2 + |x|^2 - 2 q.x``. Bounds are themselves inner products
of short vectors. A query's floor, its k-th best score so far, is seeded by exact scores of the few
candidates whose segment means come nearest. Then, coarse to fine, each pair whose bound falls below
the query's floor drops out, and exact scores are computed for the surviving pairs alone.

The queries are a stated share of the rows. Queries and candidates are dealt to blocks of bounded size
by hash, every pair of blocks is one task's work, and each returns k rows a query, merged by a window
whose input Spark limits to k rows a query and task before the shuffle.

Components become ``floor(256 x)``; scores are exact whole numbers.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part, nor do null
ids; rows with one id are rows of their own, of which none is the other's candidate, and their finds
are ranked together under that id; shorter vectors count as filled with zeros, empty
ones score 0; ties go to the smaller id; a query without other candidates has no rows; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import prepare

#: Vectors of ``WIDE`` components in a block of candidates and in one of queries, about; fewer if they
#: are longer. Each vector is copied to every block of the other kind, which is least where both are alike.
CANDIDATES, QUERIES, WIDE = 32_768, 32_768, 64
#: Segments of each resolution, coarse to fine; the finest has segments of two components.
SEGMENTS = (1, 4, 16)
#: Candidates and queries that are bounded at a time.
TILE, GROUP = 4096, 64
#: Candidates a result that seed a query's floor.
SEEDS = 4
#: Pairs whose exact scores are computed at a time.
PAIRS = 1 << 16


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the inner product of two rows is the bound."""
    n, d = vectors.shape
    edges = np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(int)
    parts = []
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            part = vectors[:, a:b]
            mean = part.mean(axis=1)
            parts += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1) if parts else np.zeros((n, 0))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, all a with all b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    large = np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1)
    return large.astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def exact_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows a[i] and b[j] of whole numbers, given as float64 where these are exact."""
    made = np.zeros(len(i), dtype=np.int64)
    for s in range(0, len(i), PAIRS):
        part = slice(s, s + PAIRS)
        if a.dtype == np.float64:
            made[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
        else:
            made[part] = [exact(a[[x]], b[[y]])[0, 0] for x, y in zip(i[part], j[part], strict=True)]
    return made


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the scores and ids of its k best among the vectors, without its own id, and the
    number of pairs of which an exact score was computed."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    computed = 0
    segments = [*SEGMENTS, *([vectors.shape[1] // 2] if vectors.shape[1] // 2 > SEGMENTS[-1] else [])]
    real, asked = vectors.astype(np.float64), queries.astype(np.float64)
    sizes, q_sizes = np.linalg.norm(real, axis=1), np.linalg.norm(asked, axis=1)
    levels, q_levels = [[statistics(m, s) for s in segments] for m in (real, asked)]
    few = min(SEEDS * k, len(ids))
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    left, right = (asked, real) if most < 1 << 53 else (queries, vectors)
    for a in range(0, len(query_ids), GROUP):
        own = slice(a, a + GROUP)
        seen = np.zeros((len(queries[own]), len(ids)), dtype=bool)
        foreign = ids != query_ids[own][:, None]
        # means are every other number of a level's statistics
        near = q_levels[len(SEGMENTS) - 1][own][:, ::2] @ levels[len(SEGMENTS) - 1][:, ::2].T
        near[~foreign] = -np.inf
        np.put_along_axis(seen, np.argpartition(-near, few - 1, axis=1)[:, :few], True, axis=1)
        seen &= foreign
        i, j = np.nonzero(seen)
        scores = exact_pairs(left[own], right, i, j)
        computed += len(i)
        best = [best_of(scores[i == x], ids[j[i == x]], k) for x in range(len(seen))]
        floor = np.array([s[-1] if len(s) == k else -np.inf for s, _ in best])
        for t in range(0, len(ids), TILE):
            at = np.arange(t, min(t + TILE, len(ids)))
            open_rows = foreign[:, at] & ~seen[:, at]
            for q_level, level in zip(q_levels, levels, strict=True):
                slack = 1e-9 * q_sizes[own][:, None] * sizes[at] + 1e-6
                open_rows &= q_level[own] @ level[at].T + slack >= floor[:, None]
                some = open_rows.any(axis=0)
                at, open_rows = at[some], open_rows[:, some]
            i, j = np.nonzero(open_rows)
            if not len(i):
                continue
            scores = exact_pairs(left[own], right, i, at[j])
            computed += len(i)
            edges = np.searchsorted(i, np.arange(len(seen) + 1))
            for x in np.unique(i):
                part = slice(edges[x], edges[x + 1])
                s, v = best[x]
                best[x] = best_of(np.concatenate([s, scores[part]]), np.concatenate([v, ids[at[j[part]]]]), k)
                if len(best[x][0]) == k:
                    floor[x] = best[x][0][-1]
        found += best
    return found, computed


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, filled with zeros to one length."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    counts = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    wide = int(counts.max()) if len(counts) else 0
    made = np.zeros((len(counts), wide), dtype=np.int64)
    made[np.arange(wide) < counts[:, None]] = flat
    return made


def exact_top_k(embeddings: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score for each row whose key is divisible by ``every``."""
    prepare(embeddings.sparkSession)
    x = F.col("vector")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter(F.col("id").isNotNull() & x.isNotNull() & usable)
    rows = rows.select("id", F.transform("vector", lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("whole"))
    is_query = F.col("id") % every == 0
    counts = embeddings.agg(F.count("*").alias("n"), F.count_if(F.col(key) % every == 0).alias("q"), F.max(F.size(vector)).alias("wide")).first()
    longer = max(1, -(-(counts["wide"] or 0) // WIDE))
    blocks, query_blocks = (max(1, -(-counts[k] * longer // most)) for k, most in (("n", CANDIDATES), ("q", QUERIES)))

    def dealt(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = rows.select("id", "whole", dealt(blocks).alias("block"), all_of(query_blocks).alias("query_block"))
    queries = rows.filter(is_query).select("id", "whole", dealt(query_blocks).alias("query_block"), all_of(blocks).alias("block"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        xs, qs = _matrix(left["whole"]), _matrix(right["whole"])
        wide = max(xs.shape[1], qs.shape[1])
        xs, qs = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (xs, qs))
        query_ids = right["id"].to_numpy()
        found, _ = search(query_ids, qs, left["id"].to_numpy(), xs, k)
        return pa.table([np.repeat(query_ids, [len(s) for s, _ in found]), np.concatenate([v for _, v in found]), np.concatenate([s for s, _ in found])], schema=schema)

    by = ("query_block", "block")
    near = candidates.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias("vec_id"), "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
