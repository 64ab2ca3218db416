"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is centred, rotated at random and kept as one bit per dimension with a
few scalars: its distance from the centre, the inner product of its code with
its own direction, and its product with the centre.  From these an inner
product with any query is estimated, and an error bound tells how far the
estimate may be off.  In each block a query first takes the exact products of the
vectors with the best estimates; the k-th largest of these is a threshold, and
every vector whose upper bound reaches it is ranked by its exact product.  Bounds
are taken on vectors and queries scaled to length one at most, so they hold at any scale.

The index holds every row.  Only the centre is fitted, on at most ``SAMPLE``
rows.  Rows and queries are dealt over blocks by a hash; a block of rows meets
each block of queries, and what a query found in the blocks is ranked once more.
The numbers of blocks follow from ``ROWS`` and ``QUERIES``, so a task never holds more
than that, and no vector is dropped however many are equal.

Cases: vectors that are null, zero or hold a null or non-finite component take
no part, nor do rows without an id; ties go to the smaller id; with fewer rows than
k all are returned; queries and rows of another dimension than most do not meet;
rows that repeat an id are separate candidates, none of a query of that id, and
different vectors of one id are separate queries (equal ones are one); products
beyond double precision are infinite, those that are no number come last; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.session import store

SAMPLE = 10_000
ROWS = 16_384
QUERIES = 2_048
# Standard deviations of the estimate that the bounds allow for.
WIDTH = 2.0
# Vectors whose exact products set the threshold, at least, and for each result.
FIRST = 200
FIRST_PER_RESULT = 5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, dim, v) that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        rows.select(F.col(key).alias("id"), v.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0.0))
        .select("id", F.size("v").alias("dim"), "v")
    )


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """Packed codes and the scalars that correct an estimate."""
    apart = vectors - centre
    norm = np.linalg.norm(apart, axis=1)
    unit = np.divide(apart, norm[:, None], out=np.zeros_like(apart), where=norm[:, None] > 0) @ turn.T
    dim = vectors.shape[1]
    return {
        "code": np.packbits(unit > 0, axis=1),
        "norm": norm,
        "align": np.maximum(np.abs(unit).sum(1) / np.sqrt(dim), 1e-12),
        "base": vectors @ centre,
    }


def bounds(index: dict[str, np.ndarray], queries: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Estimates of all inner products (queries x rows) and how far they may be off."""
    dim = queries.shape[1]
    signs = np.unpackbits(index["code"], axis=1, count=dim).astype(np.float32) * 2 - 1
    rotated = (queries @ turn.T).astype(np.float32)
    raw = rotated @ signs.T / np.sqrt(dim)
    # <q, v> = <q, c> + |v - c| <q, u>, and <q, u> is about <q, code> / <code, u>.
    scale = (index["norm"] / index["align"]).astype(np.float32)
    estimate = raw * scale + (queries @ centre).astype(np.float32)[:, None]
    spread = np.sqrt(np.maximum(1 - index["align"] ** 2, 0) / max(dim - 1, 1)) * index["norm"] / index["align"]
    reach = np.linalg.norm(queries, axis=1).astype(np.float32)
    slack = WIDTH * reach[:, None] * spread.astype(np.float32) + 1e-5 * (1 + np.abs(estimate))
    return estimate, slack


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by its largest component, so that its squares stay in range."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.where(most > 0, most, 1.0)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; what is no number counts as the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (vectors * query).sum(1)
    return np.where(np.isnan(score), -np.inf, score)


def hopeful_rows(estimate, slack, own, products, k):
    """Of one query the rows whose upper bound reaches the k-th exact product among the best estimates."""
    upper = np.where(own, -np.inf, estimate + slack)
    n = min(max(FIRST, FIRST_PER_RESULT * k), len(upper))
    best = np.argpartition(-np.where(own, -np.inf, estimate), n - 1)[:n]
    best = best[~own[best]]
    if len(best) < k:
        return np.flatnonzero(~own)
    scores = products(best)
    threshold = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero((upper >= threshold) & ~own)


def search_block(ids, vectors, query_ids, queries, centre, turn, k):
    """The k nearest rows of a block for each query: (place of the query, id, score), by codes, then exactly."""
    # One scale for all rows leaves the order of products as it is, and so does one for each query.
    size = np.abs(vectors).max()
    rows = vectors / size
    length = np.sqrt((rows**2).sum(1)).max()
    rows, centre, asked = rows / length, centre / size / length, _scaled(queries)
    asked = asked / np.sqrt((asked**2).sum(1, keepdims=True))
    index = encode(rows, centre, turn)
    out = []
    for at in range(0, len(queries), 256):
        some = slice(at, at + 256)
        estimate, slack = bounds(index, asked[some], centre, turn)
        own = query_ids[some][:, None] == ids[None, :]
        for row in range(len(estimate)):
            def products(chosen, query=asked[at + row]):
                return (rows[chosen] * query).sum(1)

            chosen = hopeful_rows(estimate[row], slack[row], own[row], products, k)
            score = exact(vectors[chosen], queries[at + row])
            best = np.lexsort((ids[chosen], -score))[:k]
            out.append((np.full(len(best), at + row), ids[chosen][best], score[best]))
    return out


def nearest(
    rows: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row whose key is divisible by ``every``: query_id, rank, key, score of its k nearest."""
    fit = store(usable(rows, key, vector), "ann-rows")
    counted = fit.agg(F.count(F.lit(1)).alias("n"), F.mode("dim").alias("dim")).first()
    n, dim = counted["n"], counted["dim"]
    schema = "query_id long, query long, id long, score double"
    if not n:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        rate = min(1.0, SAMPLE / n)
        chosen = fit.filter(F.col("dim") == dim).filter(
            F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(rate * (1 << 30))
        )
        means = chosen.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).collect()
        centre = np.zeros(dim)
        for row in means:
            centre[row["pos"]] = row["m"]
        queries = fit.filter(F.col("id") % every == 0).distinct()
        found = _by_blocks(fit, queries, n, queries.count(), dim, centre, k, schema)
    # ``query``, a hash of its vector, tells queries of one id apart.
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _by_blocks(fit, queries, n, n_queries, dim, centre, k, schema) -> DataFrame:
    row_blocks, query_blocks = -(-n // ROWS), max(1, -(-n_queries // QUERIES))
    own_rows = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks)).alias("rb")
    own_queries = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).alias("qb")
    # Every block of rows meets every block of queries: each side is sent to
    # the blocks of the other, whose sizes are fixed.
    left = fit.filter(F.col("dim") == dim).select(
        own_rows, F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")).alias("qb"), "id", "v"
    )
    right = queries.filter(F.col("dim") == dim).select(
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<long>")).alias("rb"), own_queries, "id", "v",
        F.xxhash64("v").alias("query"),
    )

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        turn = rotation(dim)

        def parts(table):
            ids = np.asarray(table["id"].combine_chunks())
            flat = np.asarray(table["v"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), dim)
            order = np.argsort(ids, kind="stable")
            return ids[order], flat[order]

        schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if not len(rows) or not len(asked):
            return schema.empty_table()
        names, vectors = parts(asked)
        hashes = np.asarray(asked["query"].combine_chunks())[np.argsort(np.asarray(asked["id"].combine_chunks()), kind="stable")]
        place, found, score = [np.concatenate(c) for c in zip(*search_block(*parts(rows), names, vectors, centre, turn, k))]
        return pa.table([pa.array(c) for c in (names[place], hashes[place], found, score)], schema=schema)

    return (
        left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, schema)
    )
