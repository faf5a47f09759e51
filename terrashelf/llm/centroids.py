"""Centroid clustering with a LAESA pivot table.

Vectors become integers, and their exact squared distances to fixed pivots (the starting centroids' vectors) are computed once
and written beside them. In every round a centroid's distances to the pivots are computed, too; by the triangle
inequality the largest difference of two rows of the table bounds the distance of a vector and a centroid from below. The
centroid with the least bound is measured exactly, every centroid whose bound is above that distance is discarded, and the
survivors get exact integer distances. Bounds are taken with a margin for rounding, so none is ever too large.

Each task sums its vectors by centroid, so a round shuffles one row a task and centroid, and a centroid that attracts most
vectors is no larger than any other. The driver holds the centroids alone.

Cases: a vector counts if it has exactly ``SIZE`` components, none null, NaN or infinite, and if no component's integer is
beyond ``LARGEST``, so that distances fit a long; others are left out. Rows that repeat an identifier are vectors of their own;
of equal hashes the smaller vector starts first. A vector without identifier starts only if too few have one. With
fewer vectors than centroids every vector starts one. An inertia beyond a long is null. Further columns are not
carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import small_batches, table
from terrashelf.session import cut

SIZE = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: The largest integer of a component: with it a squared distance stays below 2 to the power of 57.
LARGEST = 1 << 24
#: What a float bound is made smaller by, relative and absolute.
MARGIN = 1e-9


def integers(embedding: Column) -> Column:
    """``floor(64 * x)`` of every component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def usable(embedding: Column) -> Column:
    inside = lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST / SCALE, F.lit(False)) & ~F.isnan(x)
    return (F.size(embedding) == SIZE) & F.forall(embedding, inside)


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the integers, of the vectors that count."""
    good = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).where(F.coalesce(usable(F.col("e")), F.lit(False)))
    return good.select("vec_id", integers(F.col("e")).alias("v"))


def first_centroids(kept: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The ``n`` vectors with the smallest hash of their identifier."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = kept.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(n).collect()
    return np.array([r.v for r in found], dtype=np.int64).reshape(-1, SIZE)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``a`` to every row of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _tabled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            found = squared(_vectors(batch, "v", SIZE), pivots)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(pivots)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], names=["vec_id", "v", "p"])

    return run


def nearest(v: np.ndarray, p: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equals the first) and its squared distance.

    ``p`` holds the squared distances of the vectors to the pivots.
    """
    to_pivots, of_centroids = np.sqrt(p.astype(np.float64)), np.sqrt(squared(centroids, pivots).astype(np.float64))
    bound = np.stack([np.abs(to_pivots - row).max(axis=1) for row in of_centroids], axis=1)
    bound = np.maximum(bound * (1 - MARGIN) - MARGIN * (1 + to_pivots.max(axis=1, initial=0))[:, None], 0) ** 2
    cluster = bound.argmin(axis=1)
    best = ((v - centroids[cluster]) ** 2).sum(axis=1)
    guess = cluster.copy()
    for number, centroid in enumerate(centroids):
        left = np.flatnonzero((bound[:, number] <= best) & (guess != number))
        distance = ((v[left] - centroid) ** 2).sum(axis=1)
        closer = (distance < best[left]) | ((distance == best[left]) & (number < cluster[left]))
        best[left[closer]], cluster[left[closer]] = distance[closer], number
    return cluster, best


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = _vectors(batch, "v", SIZE)
    return v, *nearest(v, _vectors(batch, "p", len(pivots)), centroids, pivots)


def _summed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pivots = shared.value
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            v, cluster, _ = _assigned(batch, centroids, pivots)
            counts += np.bincount(cluster, minlength=len(centroids))
            for number in np.unique(cluster):
                sums[number] += v[cluster == number].sum(axis=0)
        met = np.flatnonzero(counts)
        columns = [pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    return run


def _labelled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, pivots = shared.value
        for batch in batches:
            _, cluster, distance = _assigned(batch, centroids, pivots)
            columns = [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


def moved(points: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored mean of their vectors, or where they were without any."""
    share = points.sparkSession.sparkContext.broadcast((centroids, pivots))
    parts = points.mapInArrow(_summed(share), "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(SIZE)]).alias("sums"))
    new = centroids.copy()
    for r in totals.collect():
        new[r.cluster] = np.array(r.sums, dtype=np.int64) // r.n
    return new


def clustered(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", n: int = CENTROIDS,
              rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that counts, and the final centroids."""
    spark = vectors.sparkSession
    small_batches(spark)
    kept = kept_vectors(vectors, vec_id, embedding)
    pivots = centroids = first_centroids(kept, n)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), centroids
    share = spark.sparkContext.broadcast
    points = cut(kept.mapInArrow(_tabled(share(pivots)), f"vec_id {id_type}, v array<int>, p array<long>"))
    for _ in range(rounds):
        centroids = moved(points, centroids, pivots)
    labels = points.mapInArrow(_labelled(share((centroids, pivots))), f"vec_id {id_type}, cluster int, distance long")
    return labels, centroids


def op12_laesa(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, centroids = clustered(table(spark, sf_dir, "embeddings"))
    labels = cut(labels)
    sums = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    whole = sum(r.d for r in sums)
    fits = lambda total: int(total) if total < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(r.cluster, fits(r.d), fits(whole), digest(centroids[r.cluster])) for r in sums]
    # A row a centroid, so its broadcast is bounded.
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [f"""kept AS (
    SELECT row_number() OVER () AS r, vec_id, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE len(embedding) = {SIZE} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x) OR abs(x) >= {LARGEST / SCALE}]) = 0),
c0 AS (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c
    FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS (
    SELECT r, vec_id, v, cluster, list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, {SIZE + 1})]) AS d FROM kept, c{i}),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {SIZE + 1}) AS t(i) GROUP BY cluster, i)
    GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    last = ROUNDS
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (cluster)"""


QUERIES = {"op12_laesa": op12_laesa}
ORACLE = {"op12_laesa": _sql()}
