"""Operator 13: exact centroid clustering with an incremental distance matrix.

Components are integers, so every product and distance is exact. Each vector keeps its dot products with all centroids in a
written table. In a round they change by x[c] * (new - old centroid)[c] over the components c in which a centroid has
changed, and only over those; the first centroids count as a change from zero. Then |x|^2 - 2 x.c + |c|^2 is compared
for all centroids, ties to the smaller number. A centroid becomes the exact floor of its vectors' mean; empty ones stay.

Scale: each pass is a map over vectors of a fixed width: nothing is shuffled but one row of partial sums for each task and
cluster, so a cluster of any size is no hot group. What the driver holds is k rows of `dims` integers. Every round is a
written table, so a lost executor costs a reread; a table is deleted once its successor is there.

Defined cases: vectors that are null, have another number of components, or a component that is null or not finite are
left out; with fewer than k vectors left there are as many centroids; rows that repeat a vec_id are vectors of their own,
ties of their hashes ordered by components; a null vec_id has no hash and comes last; an empty table gives no rows; extra
columns are ignored. An integer component beyond 2^27 raises: distances would no longer fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, table

#: Largest absolute value of a component.
BOUND = 1 << 27


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and x (array of int, floor(scale * component)) of the vectors (vec_id, embedding) that are whole."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite)
    scaled = F.transform("embedding", lambda v: F.lit(float(scale)) * v.cast("double"))
    fits = F.forall("scaled", lambda v: (v >= -BOUND) & (v < BOUND + 1))
    x = F.when(fits, F.transform("scaled", lambda v: F.floor(v).cast("int"))).otherwise(F.raise_error(F.lit(f"a component of more than {BOUND} in absolute value")).cast("array<int>"))
    return whole.select("vec_id", scaled.alias("scaled")).select("vec_id", x.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The vectors of the k least hashes of `seed:vec_id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "x").select("x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def assigned(vectors: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """vectors (vec_id, x, dots) with dots for the new centroids, and the nearest one: cluster, distance."""
    change = new - old
    norms = (new * new).sum(axis=1)
    touched = [np.flatnonzero(row) for row in change]
    k, dims = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dots = _matrix(batch.column(1), dims), _matrix(batch.column(2), k)
            for j, places in enumerate(touched):
                if len(places):
                    dots[:, j] += x[:, places] @ change[j, places]
            distances = (x * x).sum(axis=1)[:, None] - 2 * dots + norms
            cluster = distances.argmin(axis=1)
            ends = pa.array(np.arange(0, len(x) * k + 1, k), pa.int32())
            columns = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(dots.reshape(-1))), pa.array(cluster.astype(np.int32)), pa.array(distances[np.arange(len(x)), cluster])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "dots", "cluster", "distance"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.select("vec_id", "x", "dots").mapInArrow(run, f"vec_id {kind}, x array<int>, dots array<long>, cluster int, distance long")


def moved(vectors: DataFrame, old: np.ndarray) -> np.ndarray:
    """Centroids of assigned vectors (cluster, x): exact floor of the mean, the old centroid where there are none."""
    k, dims = old.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                sums[j] += x[cluster == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = vectors.select("cluster", "x").mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("c", "s")).groupBy("cluster", "c").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = old.copy()
    for r in totals.collect():  # k * dims rows
        new[r.cluster, r.c] = int(r.s) // r.n
    return new


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """A row for each whole vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    scratch = Scratch(spark, "centroids")
    now = scratch.table(integer_vectors(vectors, dims, scale), "vectors")
    new = first_centroids(now, k, seed)
    if not len(new):
        return now.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    last, now = now, now.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(new)))
    old = np.zeros_like(new)
    for r in range(rounds + 1):
        now = scratch.table(assigned(now, old, new), f"round{r}")
        scratch.drop(last)
        last = now
        if r < rounds:
            old, new = new, moved(now, new)
    sums = dict(now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows
    inertia = int(sum(sums.values()))
    facts = [(j, int(sums.get(j, 0)), inertia, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(new)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """The same rounds in SQL: each round's distances from scratch."""
    parts = [
        """v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        "e as (select vec_id, unnest(range(1, 65)) as i, unnest(x) as x from v)",
        f"firsts as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, x from v order by sha256('1:' || vec_id) limit {k})",
        "c0 as (select c, unnest(range(1, 65)) as i, unnest(x) as x from firsts)",
    ]
    for r in range(rounds + 1):
        parts += [
            f"d{r} as (select vec_id, c, sum((e.x - m.x) * (e.x - m.x))::bigint as d from e join c{r} m using (i) group by vec_id, c)",
            f"a{r} as (select vec_id, c, d from d{r} qualify row_number() over (partition by vec_id order by d, c) = 1)",
        ]
        if r < rounds:
            parts += [
                f"s{r} as (select a.c, e.i, sum(e.x)::bigint as s, count(*) as n from e join a{r} a using (vec_id) group by a.c, e.i)",
                f"c{r + 1} as (select o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, o.x) as x from c{r} o left join s{r} s on o.c = s.c and o.i = s.i)",
            ]
    parts.append(f"h as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)")
    body = ",\n".join(parts)
    return f"""with {body}
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from a{rounds} join h using (c)"""


ORACLE = _oracle()
