"""K-means over integer vectors, with Hamerly's bounds kept for each vector.

A vector's components are floor(scale * x), so all distances, sums and means are integers and each result is exact, whatever the
partitions. A round is one pass over a staged table of rows (vector, cluster, upper, lower): upper is no less than the distance to the vector's own
centroid, lower no more than that to any other. When centroids move, upper grows by the own centroid's drift and lower shrinks by the largest drift
of another. A vector whose upper is still below lower, or below half the way from its centroid to the next one, keeps its cluster unseen. Of the others upper is
made exact, and those that are ambiguous still are scanned against all centroids in integers. Bounds are doubles, rounded away from the exact value,
and compared strictly, so a tie always leads to a scan, where the smaller number wins.

Sums follow the vectors that moved: a pass marks them, and only they are added to and taken from the sums, in partial sums of a task. The driver sees
the first centroids and, in each round, a count and a sum of components for each cluster. No row is shuffled but those partial sums; the table of the round before is
deleted. Centroids (CLUSTERS x DIMENSIONS integers) go to the tasks with their code.

Defined results: vectors that are null, have another number of components, or one that is null or not finite are left out; equal vectors get equal
rows, and rows with one vec_id are vectors of their own; ties of hashes among the first centroids (repeated or null vec_ids, these hash as "1:") go by components; fewer vectors than
CLUSTERS give so many centroids; an empty table gives no rows; other columns are ignored. A component beyond MOST has squared distances that a long cannot hold: an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLUSTERS = 16
DIMENSIONS = 64
ROUNDS = 3
SCALE = 64
SEED = 1
#: Components of size up to this have exact squared distances in a long; up to EXACT, also exact as products of doubles.
MOST, EXACT = 1 << 27, 1 << 22
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50
_STATE = "vec_id long, v array<long>, cluster int, moved_from int, upper double, lower double, distance long"


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the vectors that are kept."""
    rows = common.pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.raise_error(F.lit("a component is too large for squared distances that fit a long")).cast("long")
    v = F.transform("e", lambda x: F.when(F.abs(x * scale) <= MOST, F.floor(x * scale)).otherwise(large))
    return rows.filter((F.size("e") == dimensions) & good).select("vec_id", v.alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r["v"] for r in kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()]


def squared_distances(v, centroids):
    """Exact squared distances of integer vectors to all centroids."""
    import numpy as np

    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most <= EXACT:  # integers below 2 ** 53 all the way
        a, b = v.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def _nearest(v, centroids):
    """cluster, its squared distance, upper and lower bound of each vector, from a scan of all centroids."""
    import numpy as np

    d = squared_distances(v, centroids)
    cluster = d.argmin(1)  # the first of equals
    own = d[np.arange(len(v)), cluster]
    d[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
    return cluster, own, np.sqrt(own) * _UP, np.sqrt(d.min(1)) * _DOWN


class Moves:
    """What a pass needs to know of the centroids: where they are, how far each came, and half the way to the next one."""

    def __init__(self, now, before=None):
        import numpy as np

        self.now = np.array(now, np.int64)
        k = len(self.now)
        self.drift = np.zeros(k) if before is None else np.sqrt(((self.now - np.array(before, np.int64)) ** 2).sum(1)) * _UP
        others = np.where(np.eye(k, dtype=bool), 0.0, self.drift[None, :])
        self.largest_other = others.max(1)
        apart = squared_distances(self.now, self.now).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1)) / 2 * _DOWN

    def first(self, v):
        import numpy as np

        cluster, own, upper, lower = _nearest(v, self.now)
        return cluster, np.full(len(v), -1), upper, lower, own, len(v)

    def again(self, v, cluster, upper, lower):
        """cluster, the cluster left (or the same), upper, lower, squared distance of each vector, and how many were scanned."""
        import numpy as np

        was, cluster = cluster, cluster.copy()
        upper = (upper + self.drift[cluster]) * _UP
        lower = np.maximum(lower - self.largest_other[cluster], 0) * _DOWN
        own = np.full(len(v), -1, np.int64)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[cluster]))
        own[open_] = ((v[open_] - self.now[cluster[open_]]) ** 2).sum(1)
        upper[open_] = np.sqrt(own[open_]) * _UP
        open_ = open_[upper[open_] >= np.maximum(lower[open_], self.half[cluster[open_]])]
        cluster[open_], own[open_], upper[open_], lower[open_] = _nearest(v[open_], self.now)
        return cluster, was, upper, lower, own, len(open_)


def assigned(rows: DataFrame, moves: Moves, last: bool = False, scans=None) -> DataFrame:
    """A pass over vectors (first round) or states: states with clusters for the centroids as they are now. The last pass has each distance. scans: an accumulator that counts scanned vectors."""
    import pyarrow as pa

    first = "cluster" not in rows.columns
    common.batches(rows.sparkSession, 10_000)

    def run(batches):
        import numpy as np

        for b in batches:
            if not len(b):
                continue
            flat = b.column("v").flatten()
            v = flat.to_numpy(zero_copy_only=False).reshape(len(b), -1)
            known = [] if first else [b.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower")]
            cluster, was, upper, lower, own, n = moves.first(v) if first else moves.again(v, *known)
            if scans is not None:
                scans.add(n)
            if last:
                open_ = np.flatnonzero(own < 0)
                own[open_] = ((v[open_] - moves.now[cluster[open_]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), *(pa.array(x, t) for x, t in zip((cluster, was, upper, lower, own), (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())))], ["vec_id", "v", "cluster", "moved_from", "upper", "lower", "distance"]
            )

    return rows.mapInArrow(run, _STATE)


def moved_sums(states: DataFrame, clusters: int) -> list:
    """By cluster, the count and the sums of components that the vectors that moved bring, less those that they take away."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        total, size = None, np.zeros(clusters, np.int64)
        for b in batches:
            if len(b):
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                total = np.zeros((clusters, v.shape[1]), np.int64) if total is None else total
                to, out = (b.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "moved_from"))
                left = out >= 0
                np.add.at(total, to, v)
                np.subtract.at(total, out[left], v[left])
                size += np.bincount(to, minlength=clusters) - np.bincount(out[left], minlength=clusters)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters, dtype=np.int32)), pa.array(size), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = states.filter("cluster <> moved_from").select("v", "cluster", "moved_from").mapInArrow(run, "cluster int, n long, s array<long>")
    each = parts.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return each.collect()


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, scans: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """The states after the last pass (vec_id, v, cluster, distance and bounds), and the final centroids. scans: gets the number of vectors that each pass scanned."""
    spark = vectors.sparkSession
    kept = common.staged(integer_vectors(vectors, dimensions, scale), "vectors")
    centroids = first_centroids(kept, clusters, seed)
    if not centroids:
        return kept.select("vec_id", "v", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("upper", "double"), ("lower", "double"), ("distance", "long"))]), []
    sizes, sums = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    table, moves, states = common.Rounds(spark, "clusters"), Moves(centroids), kept
    for k in range(rounds + 1):
        count = spark.sparkContext.accumulator(0) if scans is not None else None
        states = table(assigned(states, moves, k == rounds, count))
        if scans is not None:
            scans.append(count.value)
        if k == rounds:
            return states.drop("moved_from"), centroids
        for r in moved_sums(states, len(centroids)):
            sums[r["cluster"]][r["i"]] += int(r["x"])
            if r["i"] == 0:
                sizes[r["cluster"]] += r["n"]
        before, centroids = centroids, [[x // n for x in s] if n else c for c, n, s in zip(centroids, sizes, sums)]
        moves = Moves(centroids, before)


def centroid_hash(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    states, centroids = clustered(common.table(spark, sf_dir, "embeddings"))
    # A row for each cluster.
    sums = {r["cluster"]: int(r["s"]) for r in states.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, sums.get(c, 0), sum(sums.values()), centroid_hash(x)) for c, x in enumerate(centroids)]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return states.select("vec_id", "cluster", "distance").join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}
), c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}))"""]
    for k in range(rounds + 1):
        parts.append(f"""
, d{k} AS (SELECT r, c, list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{k}
), a{k} AS (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            parts.append(f"""
, s{k} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN a{k} USING (r)) GROUP BY c, i
), m{k} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY c
), c{k + 1} AS (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (c))""")
    return "".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)
"""


ORACLE_SQL = oracle_sql()
