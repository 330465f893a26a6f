"""Nearest neighbours by inner product: probed lists scanned in blocks of rotated columns, with early abandonment.

Vectors fall into lists around centroids (k-means on at most FIT_ROWS vectors chosen by a hash of vec_id; every vector is
indexed).  A query probes the lists whose centroids have the largest inner product with it.  How many follows from the
data: so many that they hold SHARE of the k nearest neighbours within the sample of TRIALS of its vectors, found by brute force;
and more until they hold at least NEED vectors.  Within a list the vectors are rotated by a fixed random orthogonal matrix and
scanned in blocks of BLOCK columns.  A product q.x is (|q|^2 + |x|^2 - |q - x|^2) / 2, so to reach the k-th best product
found so far, |q - x| must not exceed some t.  After d of D columns the test is on the partial distance: in a random
rotation it is near sqrt(d/D) |q - x|, and beyond sqrt(d/D) (1 + EPSILON / sqrt(d)) t the candidate is abandoned: its
distance exceeds t with the confidence that EPSILON sets. What survives is scored exactly, in double precision on the original vectors.

Lists are split by a hash of their rows into parts of about PART vectors, and the queries of a list by another into parts of about
QUERY_PART, so that a list with a third of all vectors is many parts and a task holds one part of each.  Each pair of
parts gives the k best for each query; a window over these takes the k best of all.  There are about sqrt(n) / 2 lists, but no
more than a sixteenth of the sample: beyond 4 million vectors lists grow longer, and FIT_ROWS should grow with them.

Defined results: vectors that are null, zero, of another length than most of the sample, or with null or non-finite components
take no part, nor do rows with a null vec_id; a query has all candidates if there are no more than k; ties go to the smaller
vec_id; rows that repeat a vec_id are candidates each, save for queries with that vec_id; query rows that are equal in vec_id and
vector are one query, those with one vec_id and several vectors are ranked each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash_sample, table

FIT_ROWS, FIT_STEPS = 16_384, 8
#: Share of the neighbours within the sample that the probed lists must hold, and the sample's queries for that.
SHARE, TRIALS, NEED = 0.98, 512, 400
PART, QUERY_PART = 4096, 4096
#: Columns in a block, confidence of the test, and the share of candidates above which a block is one matrix product.
BLOCK, EPSILON, DENSE = 16, 2.6, 0.02
QUERIES_AT_ONCE = 128


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding")).where("vec_id is not null").where(fine)


def kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(FIT_STEPS):
        own = nearest_list(x, c)
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        full = n > 0
        c[full] = s[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def nearest_list(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def probes_for(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """Lists to probe so that SHARE of the k nearest of TRIALS sampled vectors, within the sample, lie in them."""
    own, n = nearest_list(x, c), len(x)
    at = np.linspace(0, n - 1, min(n, TRIALS)).astype(int)
    s = x[at] @ x.T
    s[np.arange(len(at)), at] = -np.inf
    k = min(k, n - 1)
    if k < 1:
        return 1
    near = np.argpartition(s, n - k, axis=1)[:, n - k :]
    order = np.argsort(-(x[at] @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), SHARE, method="higher")) + 1


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one part for each query: rows of the queries, vector ids, scores.  All queries of a slice go through a block at once."""
    d, n = x.shape[1], len(x)
    rx, rq = x @ turn, q @ turn
    cuts = list(range(0, d, BLOCK)) + [d]
    upto_x = np.stack([(rx[:, :c] ** 2).sum(1) for c in cuts])
    upto_q = np.stack([(rq[:, :c] ** 2).sum(1) for c in cuts])
    reach = [(c / d) * (1 + (EPSILON / np.sqrt(c) if 0 < c < d else 0)) ** 2 for c in cuts]
    first = np.ascontiguousarray(rx[:, : cuts[1]])
    found = []
    for begin in range(0, len(q), QUERIES_AT_ONCE):
        some = slice(begin, begin + QUERIES_AT_ONCE)
        own = ids[None, :] == qids[some, None]
        if n <= k + 1:
            row, at = np.nonzero(~own)
            row += begin
        else:
            product = rq[some, : cuts[1]] @ first.T
            norms = upto_q[-1, some, None] + upto_x[-1][None, :]
            far = upto_q[1, some, None] + upto_x[1][None, :] - 2 * product
            far[own] = np.inf
            # Exact scores of the most promising set the mark to reach.
            seed = np.argpartition(far * (d / cuts[1]) - norms, k - 1, axis=1)[:, :k]
            score = (x[seed] * q[some, None, :]).sum(2)
            score[np.take_along_axis(own, seed, axis=1)] = -np.inf
            most = np.maximum(norms - 2 * score.min(1)[:, None], 0) + 1e-11 * norms
            stay = far <= most * reach[1] + 1e-12 * norms
            b = 2
            # While many stay, a block of columns is one matrix product; then the few that are left go on alone.
            while b < len(cuts) and np.count_nonzero(stay) > DENSE * stay.size:
                product += rq[some, cuts[b - 1] : cuts[b]] @ rx[:, cuts[b - 1] : cuts[b]].T
                far = upto_q[b, some, None] + upto_x[b][None, :] - 2 * product
                stay &= far <= most * reach[b] + 1e-12 * norms
                b += 1
            if b == len(cuts):
                # All columns are in: what is below the k-th best product, by more than rounding, is out.
                full = np.where(stay, product, -np.inf)
                stay &= full >= np.partition(full, n - k, axis=1)[:, n - k, None] - 1e-9 * (1 + norms)
            row, at = np.nonzero(stay)
            product, most, norms = product[row, at], most[row, at], norms[row, at]
            row += begin
            for b in range(b, len(cuts)):
                product = product + np.einsum("ij,ij->i", rx[at, cuts[b - 1] : cuts[b]], rq[row, cuts[b - 1] : cuts[b]])
                far = upto_q[b, row] + upto_x[b, at] - 2 * product
                keep = far <= most * reach[b] + 1e-12 * norms
                row, at, product, most, norms = row[keep], at[keep], product[keep], most[keep], norms[keep]
        exact = (x[at] * q[row]).sum(1)
        order = np.lexsort((ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        head = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(head, np.arange(len(row)), 0)) if len(row) else row
        best = rank < k
        found.append((row[best], ids[at[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*found))


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def scan_part(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_key": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x = matrix(left["embedding"])
        qids = right["vec_id"].to_numpy()
        row, i, s = scan(left["vec_id"].to_numpy(), x, qids, matrix(right["embedding"]), k, rotation(x.shape[1]))
        return pd.DataFrame({"query_id": qids[row], "query_key": right["query_key"].to_numpy()[row], "vec_id": i, "score": s})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that are found for each query."""
    spark = vectors.sparkSession
    good = usable(vectors)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = hash_sample(good, FIT_ROWS, "vec_id").toPandas()
    if len(sample) == 0:
        return empty
    d = int(sample["embedding"].map(len).mode().iloc[0])
    good = good.where(F.size("embedding") == d)
    # Equal vectors count once, so that a common one does not decide where lists lie and how many are probed.
    fitted = np.unique(matrix(sample["embedding"][sample["embedding"].map(len) == d]), axis=0)
    fitted = fitted[np.random.default_rng(1).permutation(len(fitted))]
    n = good.count()
    # About sqrt(n) lists, bounded by the sample; a sixteenth of it at most.
    lists = int(max(1, min(n**0.5 / 2, len(fitted) / 16)))
    found_centroids = kmeans(fitted, lists)
    centroids = spark.sparkContext.broadcast(found_centroids)  # at most FIT_ROWS / 16 rows
    probes = probes_for(fitted, found_centroids, k) if probes is None else probes

    @F.pandas_udf("int")
    def list_of(e: pd.Series) -> pd.Series:
        return pd.Series(nearest_list(matrix(e), centroids.value) if len(e) else [], dtype="int32")

    # The checkpoint holds the numbers of rows, which deal out rows that repeat a vec_id.
    placed = cut(good.withColumn("list", list_of("embedding")).withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    sent = spark.sparkContext.broadcast(counts)

    @F.pandas_udf("array<int>")
    def probed(e: pd.Series) -> pd.Series:
        size = sent.value
        out = []
        for row in matrix(e) @ centroids.value.T if len(e) else []:
            order = np.argsort(-row, kind="stable")
            held = np.cumsum(size[order])
            upto = max(probes, int(np.searchsorted(held, NEED + k + 1)) + 1)
            out.append([int(c) for c in order[:upto] if size[c]])
        return pd.Series(out)

    queries = placed.where(is_query).select("vec_id", "embedding").distinct()
    asked = cut(queries.withColumn("query_key", F.xxhash64("embedding")).withColumn("lists", probed("embedding")))
    queried = np.zeros(lists, np.int64)
    for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a row for each list
        queried[r["list"]] = r["count"]
    of = lambda n: F.element_at(F.array(*(F.lit(int(p)) for p in n)), F.col("list") + 1)
    n_parts, n_slices = of(np.maximum(1, -(-counts // PART))), of(np.maximum(1, -(-queried // QUERY_PART)))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = placed.select("list", F.pmod(F.xxhash64("row"), n_parts).cast("int").alias("part"), every(n_slices).alias("slice"), "vec_id", "embedding")
    slice_of = F.pmod(F.xxhash64("vec_id", "query_key"), n_slices).cast("int")
    dealt = asked.withColumn("list", F.explode("lists")).select("list", every(n_parts).alias("part"), slice_of.alias("slice"), "vec_id", "query_key", "embedding")
    keys = ["list", "part", "slice"]
    found = base.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(scan_part(k), "query_id bigint, query_key bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
