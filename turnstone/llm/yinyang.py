"""Exact k-means on integer vectors with Yinyang bounds: one lower bound for each group of centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read

DIMENSION, CLUSTERS, ROUNDS, GROUPS, SCALE = 64, 16, 3, 4, 64
#: Components up to this are compared in doubles, where every squared distance of 64 of them is exact; others as integers.
NARROW = 1 << 22
#: Sums travel as limbs of so many bits.
LIMB = 40
#: Room for the rounding of a square root and of sums of drifts, relative to the bound.
SLACK = 1e-9

STATS = "array<struct<cluster: int, level: int, n: long, sums: array<long>>>"
_STATS = pa.list_(pa.struct([("cluster", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _integers(column: pa.Array, dimension: int) -> np.ndarray:
    """floor(SCALE * x) of each vector, as doubles where they are narrow, else as whole numbers of any size."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    if not len(x) or np.abs(x).max() * SCALE <= NARROW:
        return np.floor(x * SCALE)
    return np.array([[int(np.floor(v * SCALE)) if abs(v) < 2.0**900 else int(v) * SCALE for v in row] for row in x.tolist()], object).reshape(-1, dimension)


def _squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = vectors - centroid
    return (d * d).sum(axis=1)


def _wide(vectors: np.ndarray, centroids: np.ndarray) -> bool:
    return vectors.dtype == object or centroids.dtype == object


def _array(centroids: list[list[int]]) -> np.ndarray:
    wide = any(abs(x) > NARROW for c in centroids for x in c)
    return np.array(centroids, object if wide else np.float64).reshape(len(centroids), -1)


def group_centroids(centroids: list[list[int]], groups: int) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means among the centroids themselves (they are few)."""
    groups = min(groups, len(centroids))
    top = max([1, *(abs(x) for c in centroids for x in c)])
    x = np.array([[v / top for v in c] for c in centroids], np.float64)
    seeds = [0]
    while len(seeds) < groups:  # the one that is farthest from all before it
        seeds.append(int(np.argmax(np.min([((x - x[s]) ** 2).sum(axis=1) for s in seeds], axis=0))))
    means = x[seeds]
    for _ in range(5):
        of = np.argmin(((x[:, None, :] - means[None]) ** 2).sum(axis=2), axis=1)
        means = np.array([x[of == g].mean(axis=0) if (of == g).any() else means[g] for g in range(groups)])
    return of


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squares, np.float64))


def _scan_all(v: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, squared distance, upper bound, lower bound for each group) by looking at every centroid."""
    d = np.stack([_squared(v, x) for x in c], axis=1)
    best = np.argmin(d, axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
    least = d[np.arange(len(v)), best]
    if _wide(v, c):  # no bounds: every round looks at every centroid
        return best, least, np.full(len(v), np.inf), np.full((len(v), int(group.max()) + 1), -np.inf)
    lower = np.full((len(v), int(group.max()) + 1), np.inf)
    others = _root(d)
    others[np.arange(len(v)), best] = np.inf
    for k, g in enumerate(group):
        lower[:, g] = np.minimum(lower[:, g], others[:, k])
    return best, least, _root(least), lower


def assign(
    v: np.ndarray, c: np.ndarray, drift: np.ndarray, group: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), new upper and lower bounds, and distances computed.

    cluster, upper and lower are those of the centroids before they moved by drift. First the vectors go whose upper
    bound is under all their lower ones, then groups whose lower bound is over the upper one, then centroids that the
    group's bound and their own drift rule out; the rest is compared exactly.
    """
    if _wide(v, c) or not np.isfinite(upper).all():
        best, _, upper, lower = _scan_all(v, c, group)
        return best, upper, lower, len(v) * len(c)
    groups = int(group.max()) + 1
    furthest = np.array([drift[group == g].max() if (group == g).any() else 0.0 for g in range(groups)])
    best, before = cluster.copy(), lower
    upper = (upper + drift[cluster]) * (1 + SLACK) + SLACK
    lower = (lower - furthest) * (1 - SLACK) - SLACK
    n = 0
    open_ = np.flatnonzero(upper >= lower.min(axis=1))
    if not len(open_):
        return best, upper, lower, n
    # exact distance to the present centroid, then the same test again
    exact = ((v[open_] - c[cluster[open_]]) ** 2).sum(axis=1)
    n += len(open_)
    upper[open_] = _root(exact)
    still = upper[open_] * (1 + SLACK) >= lower[open_].min(axis=1)
    open_, exact = open_[still], exact[still]
    found, nearest = exact.copy(), cluster[open_].copy()
    own = group[cluster[open_]]
    touched = np.zeros((len(open_), groups), bool)
    new_lower = np.full((len(open_), groups), np.inf)
    for g in range(groups):
        rows = np.flatnonzero(lower[open_, g] <= _root(found) * (1 + SLACK))
        touched[rows, g] = True
        for k in np.flatnonzero(group == g):
            at = rows[cluster[open_[rows]] != k]
            bound = (before[open_[at], g] - drift[k]) * (1 - SLACK) - SLACK
            near = bound <= _root(found[at]) * (1 + SLACK)
            out, at = at[~near], at[near]
            new_lower[out, g] = np.minimum(new_lower[out, g], bound[~near])
            if not len(at):
                continue
            d = _squared(v[open_[at]], c[k])
            n += len(at)
            closer = (d < found[at]) | ((d == found[at]) & (k < nearest[at]))
            # the one that is not the nearest is one of the others of its group
            lost, loser = np.where(closer, found[at], d), np.where(closer, nearest[at], k)
            np.minimum.at(new_lower, (at, group[loser]), _root(lost))
            found[at] = np.where(closer, d, found[at])
            nearest[at] = np.where(closer, k, nearest[at])
    kept = lower[open_]
    lower[open_] = np.where(touched, new_lower, np.minimum(kept, new_lower))
    # a group that was not looked at keeps its bound; it now has the former centroid among its others, too
    moved = np.flatnonzero((nearest != cluster[open_]) & ~touched[np.arange(len(open_)), own])
    lower[open_[moved], own[moved]] = np.minimum(lower[open_[moved], own[moved]], _root(exact[moved]))
    best[open_], upper[open_] = nearest, _root(found)
    return best, upper, lower, n


def _limbs(total: list[int]) -> list[list[int]]:
    """The sums as limbs, the last one with the sign."""
    out = []
    while any(not -(1 << LIMB) < x < 1 << LIMB for x in total):
        out.append([x & ((1 << LIMB) - 1) for x in total])
        total = [x >> LIMB for x in total]
    return [*out, total]


def _stats(v: np.ndarray, best: np.ndarray) -> list[tuple[int, int, int, list[int]]]:
    """(cluster, level, n, sums): of each cluster the count and the limbs of the sums."""
    out = []
    for k in np.unique(best).tolist():
        mine = v[best == k]
        for level, limbs in enumerate(_limbs([int(x) for x in mine.sum(axis=0)])):
            out.append((k, level, len(mine) if not level else 0, limbs))
    return out


def _round(centroids: list[list[int]], drift: list[float], group: list[int], dimension: int, first: bool):
    """(id, vec, cluster, upper, lower, stats): the vectors with their bounds; a batch's first row has its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, groups = _array(centroids), np.array(group)
        for batch in batches:
            v = _integers(batch.column(1), dimension)
            if not len(v):
                continue
            if first:
                best, _, upper, lower = _scan_all(v, c, groups)
            else:
                state = [batch.column(k) for k in (2, 3, 4)]
                cluster, upper = (s.to_numpy(zero_copy_only=False) for s in state[:2])
                lower = state[2].flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                best, upper, lower, _ = assign(v, c, np.array(drift), groups, cluster.astype(np.int64), upper.copy(), lower.copy())
            told = [{"cluster": a, "level": b, "n": m, "sums": s} for a, b, m, s in _stats(v, best)]
            held = pa.array([told] + [None] * (len(v) - 1), _STATS)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(upper), pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), lower.shape[1]).cast(pa.list_(pa.float64())), held],
                ["id", "vec", "cluster", "upper", "lower", "stats"],
            )

    return run


def _distances(centroids: list[list[int]], dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _array(centroids)
        for batch in batches:
            v, best = _integers(batch.column(1), dimension), batch.column(2).to_numpy()
            d = ((v - c[best]) ** 2).sum(axis=1) if len(v) else []
            if _wide(v, c):
                d = [int(x) if x < 1 << 63 else None for x in d]
            else:
                d = np.asarray(d).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    return run


def start(kept: DataFrame, clusters: int, dimension: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, as integers; they are few."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "vec").orderBy("key", "vec").limit(clusters).toArrow()
    if not rows.num_rows:
        return []
    order = rows.column("vec").combine_chunks()
    return [[int(x) for x in row] for row in _integers(order, dimension).tolist()]


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    groups: int = GROUPS,
    dimension: int = DIMENSION,
) -> DataFrame:
    """k-means over the vectors' components as integers floor(64 x), with the results of the plain algorithm.

    Vectors without exactly ``dimension`` components, or with a null or non-finite one, are left out. The ``clusters`` vectors
    with the smallest SHA-256 of ``1:<id>`` are the first centroids (fewer if there are fewer; equal hashes by components;
    a null id counts as empty). Each round assigns every vector to the nearest centroid (ties: the smaller number) and
    moves every centroid that has vectors to floor(sum / count) of each component; then vectors are assigned once more.
    Returns id_col, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, one row for each vector kept;
    repeated rows count each, other columns are not read; an empty table gives an empty result. A squared distance
    or sum beyond a long is null.

    Centroids are grouped once. Each vector keeps an upper bound for its centroid and a lower one for each group; most
    vectors, groups and centroids are ruled out by them and the centroids' drifts, the rest is compared exactly in
    integers. A round reads the vectors with their bounds, writes them with new ones to the shared folder and sends
    nothing but sums of each batch, so a cluster that holds a third of all rows needs no task of its own.
    """
    kind = dict(vectors.dtypes)[id_col]
    inner = dict(vectors.dtypes)[vec_col]
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = kept.where((F.size("vec") == dimension) & ~F.coalesce(bad, F.lit(True)))
    c = start(kept, clusters, dimension)
    none = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    of = [0] * len(c)
    if c:
        of = group_centroids(c, groups).tolist()
    state, drift = kept, [0.0] * len(c)
    schema = f"id {kind}, vec {inner}, cluster int, upper double, lower array<double>, stats {STATS}"
    for r in range(rounds + 1 if c else 0):
        after = state.mapInArrow(_round(c, drift, of, dimension, r == 0), schema)
        after = materialize(after, "clusters")
        discard(state)
        state = after.drop("stats")
        state._turnstone_path = after._turnstone_path
        if r < rounds:
            c, drift = _moved(after, c, dimension)
    if not c:
        found = none.limit(0)
    else:
        found = state.select("id", "vec", "cluster").mapInArrow(_distances(c, dimension), f"id {kind}, cluster int, distance long")
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("known"), F.count("*").alias("n")).collect()
    whole = {row["cluster"]: int(row["s"]) if row["known"] == row["n"] and row["s"] is not None else None for row in sums}
    total = None if None in whole.values() else sum(whole.values())
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    table = [(k, fits(whole.get(k)), fits(total), digest[k]) for k in whole]
    table = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(state: DataFrame, c: list[list[int]], dimension: int) -> tuple[list[list[int]], list[float]]:
    """The centroids' new places and how far they moved, from sums of clusters x levels rows."""
    stats = state.select(F.explode("stats").alias("s")).select("s.*")
    parts = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimension)]
    rows = stats.groupBy("cluster", "level").agg(F.sum("n").alias("n"), *parts).collect()
    total, n = [[0] * dimension for _ in c], [0] * len(c)
    for row in rows:
        n[row["cluster"]] += row["n"]
        for i in range(dimension):
            total[row["cluster"]][i] += row[f"s{i}"] << (LIMB * row["level"])
    new = [[x // m for x in t] if m else old for t, m, old in zip(total, n, c, strict=True)]
    moved = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(new, c, strict=True)]
    return new, [float(m) ** 0.5 if m < 1 << 500 else float("inf") for m in moved]


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    def near(n: int) -> str:
        d = "list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v)"
        return f"a{n} AS (SELECT v.rid, c.k, ({d})::BIGINT AS d FROM v, c{n} c QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY d, c.k) = 1)"

    def move(n: int) -> str:
        return (
            f"e{n} AS (SELECT a.k, i, sum(v.v[i]::BIGINT)::BIGINT AS s, count(*) AS m FROM a{n} a JOIN v USING (rid), range(1, 65) t(i) GROUP BY a.k, i),\n"
            f"m{n} AS (SELECT k, list(((s - ((s % m) + m) % m) // m)::DOUBLE ORDER BY i) AS v FROM e{n} GROUP BY k),\n"
            f"c{n + 1} AS (SELECT c.k, coalesce(m{n}.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} USING (k))"
        )

    steps = ",\n".join(f"{near(n)},\n{move(n)}" for n in range(ROUNDS))
    return f"""
WITH u AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT * FROM u),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM v QUALIFY k < {CLUSTERS}),
{steps},
{near(ROUNDS)},
h AS (SELECT k, sha256(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (rid) JOIN h USING (k)
"""


OP13_SQL = _op13_sql()
