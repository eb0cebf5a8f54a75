"""Operator 5, exact top-k search: norm-sorted inner products.

Candidates and queries are dealt into blocks of bounded size, and every
query block meets every candidate block in a task of its own. In a task the
candidates are taken by descending length. The vectors are rotated by the
singular vectors of all candidates, so that the first coordinates hold most
of every product; a candidate whose partial product plus the Cauchy-Schwarz
bound of the remainder (length of both residuals) is below the k-th best
score so far can't enter the result and its product is not finished. Once
the product of lengths is below it for all queries, no later candidate is
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 32_768
#: Candidates and queries of one step of a task.
TILE, QUERY_TILE = 1024, 2048
SCALE = 256


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), dtype=np.int64)
    out[np.arange(dim) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _gram(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())],
                                         names=["cell", "value"])
    return run


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value. The driver gets dim x dim sums."""
    cells = (vectors.select("vec").mapInArrow(_gram(dim), "cell long, value double")
             .groupBy("cell").agg(F.sum("value").alias("value")).collect())
    gram = np.zeros(dim * dim)
    for r in cells:
        gram[r["cell"]] = r["value"]
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of all rows; through doubles where these hold them exactly."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2 ** 53:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


class _Best:
    """The k best (score, smaller id first) candidates of each query of a tile."""

    def __init__(self, n: int, k: int):
        self.k, self.none = k, np.iinfo(np.int64).min
        self.score = np.full((n, k), self.none)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.score)
        rows = np.concatenate([np.repeat(np.arange(n), self.k), row])
        scores = np.concatenate([self.score.ravel(), score])
        names = np.concatenate([self.id.ravel(), ids])
        order = np.lexsort((names, -scores.astype(float), rows)) if np.abs(score).max(initial=0) < 2 ** 53 else \
            np.lexsort((names, np.invert(scores), rows))
        rows, first = rows[order], np.searchsorted(rows[order], np.arange(n))
        at = order[first[:, None] + np.arange(self.k)]
        self.score, self.id = scores[at], names[at]


def block_top_k(q_id, q, c_id, c, turn, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the k best candidates of each query. ``turn`` is the rotation."""
    out = []
    c_len = np.sqrt((c.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((c_id, -c_len))
    c_id, c, c_len = c_id[order], c[order], c_len[order]
    head = max(1, q.shape[1] // 4)
    ct, qt = c @ turn, q @ turn
    c_rest = np.sqrt((ct[:, head:] ** 2).sum(axis=1))
    for lo in range(0, len(q), QUERY_TILE):
        own, own_id, rot = q[lo:lo + QUERY_TILE], q_id[lo:lo + QUERY_TILE], qt[lo:lo + QUERY_TILE]
        q_len = np.sqrt((own.astype(float) ** 2).sum(axis=1))
        q_rest = np.sqrt((rot[:, head:] ** 2).sum(axis=1))
        best = _Best(len(own), k)
        for at in range(0, len(c), TILE):
            part = slice(at, at + TILE)
            slack = 1e-6 * (1 + q_len * c_len[at])  # rounding of the rotated products
            least = np.where(best.least == best.none, -np.inf, best.least.astype(float)) - slack
            if (q_len * c_len[at] < least).all():
                break  # all later candidates are shorter still
            bound = rot[:, :head] @ ct[part, :head].T + q_rest[:, None] * c_rest[part][None, :]
            row, col = np.nonzero((bound >= least[:, None]) & (own_id[:, None] != c_id[part][None, :]))
            if not len(row):
                continue
            if len(row) * 4 > bound.size:
                score = _exact(own, c[part])[row, col]
            else:
                score = np.einsum("ij,ij->i", own[row], c[at + col])
            reach = score >= best.least[row]
            row, col, score = row[reach], col[reach], score[reach]
            if len(row) > 4 * k * len(own):  # only what can be among a query's k best of this tile
                full = np.full(bound.shape, best.none)
                full[row, col] = score
                cut = np.partition(full, -k, axis=1)[:, -k] if full.shape[1] > k else np.full(len(own), best.none)
                reach = score >= cut[row]
                row, col, score = row[reach], col[reach], score[reach]
            best.add(row, score, c_id[at + col])
        row, rank = np.nonzero(best.score != best.none)
        out.append((row + lo, best.id[row, rank], best.score[row, rank]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))


def _search(turn: np.ndarray, dim: int, k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not candidates.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], type=pa.int64()) for n in names})
        q_id, key = (queries[c].to_numpy() for c in ("vec_id", "query_key"))
        row, ids, score = block_top_k(q_id, _matrix(queries["vec"], dim), candidates["vec_id"].to_numpy(),
                                      _matrix(candidates["vec"], dim), turn, k)
        return pa.table({n: pa.array(v) for n, v in zip(names, (q_id[row], key[row], ids, score))})
    return run


def top_k_search(vectors: DataFrame, is_query: F.Column, k: int = 5, candidate_block: int = CANDIDATE_BLOCK,
                 query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest integer inner product with each query row.

    ``is_query`` is a condition on the column vec_id, by name. Components become floor(256 * x). Rows of ``vectors`` (vec_id,
    embedding; other columns are ignored) with a null id, a null vector or a
    null or non-finite component take no part. Shorter vectors are filled up
    with zeros. A query isn't matched with rows of its own id; other rows
    with equal ids are candidates of their own, and equal query rows are
    answered once. Ties go to the smaller vec_id. Fewer than k candidates:
    all of them. An empty table gives an empty result. |256 x| must stay
    below 2^24 for exact scores up to 2^15 components.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double"))).alias("vec")))
    n, n_queries, dim = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(F.size("vec"))).first()
    dim = max(1, dim or 0)
    parts, query_parts = -(-n // candidate_block) or 1, -(-n_queries // query_block) or 1
    key = F.xxhash64("vec")
    candidates = (rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(parts)))
                  .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))))
    queries = (rows.where(is_query).withColumn("query_key", key).dropDuplicates(["vec_id", "query_key"])
               .withColumn("query_part", F.pmod(F.xxhash64("query_key", "vec_id"), F.lit(query_parts)).cast("int"))
               .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))))
    both = candidates.groupBy("part", "query_part").cogroup(queries.groupBy("part", "query_part"))
    found = both.applyInArrow(_search(rotation(rows, dim), dim, k),
                              "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
