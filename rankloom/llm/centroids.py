"""Operator 11: centroid clustering by annulus search, in whole numbers.

Vectors of one length become integers floor(SCALE * x).  The first centroids are the
vectors whose ids have the least SHA-256 under a salt.  A centroid nearer to a vector
than a distance u must have a norm within u of the vector's norm.  So centroids are
sorted by norm; the best of the few centroids around the vector's own norm gives the
upper bound u; a binary search gives the centroids in the annulus; and only those are
compared, in exact integers, with all ties at the boundary inside.  Of equal distances
the smallest number wins.  Vectors with the same annulus are compared as one block.

A round is one pass over the vectors.  Tasks give sums by centroid, Spark adds them, and
the driver holds no more than the centroids (`k` of them, a parameter).

Defined cases: vectors that are null, of another length, or hold nulls or values that are
not finite are left out; components beyond 2 ** 27 are drawn to it, so that a distance
fits 64 bits; repeated vectors and ids count each; of equal hashes the vector that is
smaller component by component comes first; a null id is never a first centroid; with
fewer vectors than `k` there are as many centroids as vectors with an id; without any,
the result is empty; an empty centroid stays where it is; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.store import written

LENGTH, K, ROUNDS, SALT, SCALE = 64, 40, 5, "2", 256
MOST = 1 << 27  # a component, without its sign
AROUND = 2  # centroids on either side of a vector's norm that give its upper bound
SLICE_ROWS = 4_096
FLOAT_SAFE = 1 << 22  # below it, sums of products of LENGTH components are exact in doubles


def whole_vectors(table: DataFrame, length: int = LENGTH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that count, as integers."""
    x = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    inside = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c))
    kept = table.select(F.col(id_col).cast("long").alias(id_col), x.alias("_x")).where((F.size("_x") == length) & ~F.exists("_x", bad))
    return kept.select(id_col, F.transform("_x", lambda c: F.floor(inside(F.floor(inside(c * scale)).cast("double"))).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, salt: str = SALT, id_col: str = "vec_id") -> list[list[int]]:
    """The k vectors with the least hash of their id: k rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.where(F.col(id_col).isNotNull()).select("v", digest.alias("_h")).orderBy("_h", "v").limit(k).collect()]


class Annulus:
    """Centroids in order of norm, and the search for the nearest one."""

    def __init__(self, centroids: np.ndarray):
        exact = centroids.astype(np.int64)
        square = (exact * exact).sum(1)
        self.order = np.argsort(square, kind="stable")
        self.centroids, self.square = exact[self.order], square[self.order]
        self.norms = np.sqrt(self.square.astype(np.float64))
        self.safe = not len(exact) or np.abs(exact).max() < FLOAT_SAFE

    def distances(self, x: np.ndarray, square: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Squared distances of the rows of x to the centroids lo..hi in norm order, exact."""
        own = self.centroids[lo:hi]
        if self.safe and np.abs(x).max(initial=0) < FLOAT_SAFE:
            products = (x.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
        else:
            products = x @ own.T
        return square[:, None] - 2 * products + self.square[None, lo:hi]

    def bounds(self, x: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first and the end of the centroids in its annulus."""
        n, k = np.sqrt(square.astype(np.float64)), len(self.norms)
        at = np.searchsorted(self.norms, n)
        least = np.full(len(x), np.iinfo(np.int64).max)
        for step in range(-AROUND, AROUND):
            near = np.clip(at + step, 0, k - 1)
            gap = x - self.centroids[near]
            least = np.minimum(least, (gap * gap).sum(1))
        reach = np.sqrt(least.astype(np.float64))
        slack = 1e-6 + 1e-9 * (n + reach)  # square roots are rounded; what lies on the boundary stays in
        return np.searchsorted(self.norms, n - reach - slack, "left"), np.searchsorted(self.norms, n + reach + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row, and how many distances were taken."""
        x = x.astype(np.int64)
        square = (x * x).sum(1)
        number, distance, compared = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        if not len(x):
            return number, distance, 0
        lo, hi = self.bounds(x, square)
        key = lo * (len(self.norms) + 1) + hi
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for rows in np.split(order, cuts):
            a, b = int(lo[rows[0]]), int(hi[rows[0]])
            d = self.distances(x[rows], square[rows], a, b)
            least = d.min(1)
            number[rows] = np.where(d == least[:, None], self.order[a:b][None, :], len(self.norms)).min(1)
            distance[rows] = least
            compared += d.size
        return number, distance, compared


def _rows(batches, n_columns: int):
    """(columns, vectors as a matrix) of small slices of Arrow batches whose last column is the vector."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(lo, SLICE_ROWS)
            flat = part.column(n_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of what is nearest to each."""
    k, length = centroids.shape

    def sums(batches):
        search, total, count = Annulus(centroids), np.zeros((k, length), np.int64), np.zeros(k, np.int64)
        for _, x in _rows(batches, 1):
            number, _, _ = search.nearest(x)
            np.add.at(total, number, x.astype(np.int64))
            count += np.bincount(number, minlength=k)
        met = np.flatnonzero(count)
        at = np.repeat(met, length)
        place = np.tile(np.arange(length), len(met))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place.astype(np.int32)), pa.array(total[met].ravel()), pa.array(np.repeat(count[met], length))], ["cluster", "place", "total", "n"])

    parts = vectors.select("v").mapInArrow(sums, "cluster int, place int, total long, n long")
    means = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in means.collect():  # k * length rows at most
        out[r.cluster, r.place] = int(r.total) // int(r.n)
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches):
        search = Annulus(centroids)
        for part, x in _rows(batches, 2):
            number, distance, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], [id_col, "cluster", "distance"])

    return vectors.select(id_col, "v").mapInArrow(run, f"{id_col} long, cluster int, distance long")


def clustered(table: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector that counts, the final centroids)."""
    vectors = written(whole_vectors(table, length, SCALE, id_col, vector_col), "vectors")
    centroids = np.array(first_centroids(vectors, k, salt, id_col), np.int64).reshape(-1, length)
    if not len(centroids):
        return assigned(vectors.limit(0), np.zeros((1, length), np.int64), id_col), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return written(assigned(vectors, centroids, id_col), "assigned"), centroids


def summed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with what a cluster and the whole sum up to, and the digest of the cluster's centroid."""
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = rows.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    told = each.join(digests, "cluster").crossJoin(F.broadcast(whole))  # k rows at most, with one row
    return rows.join(F.broadcast(told), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    part = "list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = "(SELECT v.id, v.vec_id, v.v, c.number, {d} AS distance FROM v CROSS JOIN {c} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY distance, c.number) = 1)"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED {nearest.format(d=part, c=f'c{r}')}")
        steps.append(
            f"m{r} AS (SELECT number, list(m ORDER BY i) AS c FROM (SELECT number, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT number, unnest(v) AS x, unnest(range({LENGTH})) AS i FROM a{r}) GROUP BY number, i) GROUP BY number)"
        )
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT number, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (number))")
    steps.append(f"z AS MATERIALIZED {nearest.format(d=part, c=f'c{ROUNDS}')}")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{SALT}:', vec_id)), v) - 1 AS number, v AS c FROM v ORDER BY sha256(concat('{SALT}:', vec_id)), v LIMIT {K}),
{", ".join(steps)}
SELECT z.vec_id, CAST(z.number AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY z.number) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c ON c.number = z.number
"""


SQL = _sql()
