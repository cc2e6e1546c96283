"""Near-duplicate vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix, read, signed, spread
from .components import connected_components

THRESHOLD = 0.98
TREES, LEAF = 6, 256
#: Levels that one round adds to a tree, and vectors of a node that a round's thresholds are fitted to, about.
LEVELS, SAMPLE = 5, 2048
#: Half-width of the overlap, in standard deviations of the projected difference of a pair at the threshold. So a level
#: parts such a pair in about 1.3 of 100 cases (vectors in all directions), and all trees of 20 levels in 1 of 3000.
SPILL = 0.5
#: A leaf beyond this is compared in blocks of BLOCK vectors. A node that a round shrinks less than STUCK is a leaf.
LEAF_MOST, BLOCK, STUCK = 512, 1024, 0.9
#: A cut must leave each side at most this share of its node, overlap included; else the node is a leaf.
MOST_SIDE = 0.85
RUNS = 64
#: A node of at most WHOLE vectors is split by one task, down to its leaves.
WHOLE = 8192
#: Bytes of vectors that a step shuffles at once, or all vectors once if these are more: what is beyond goes in waves.
WAVE_BYTES = 1 << 27
#: Nodes whose cuts are broadcast.
FEW = 1000


def _valid(dtype: str):
    """Rows that can link as (id, label, digest, vec): a label, finite components, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _checked(batch, dtype)

    return run


def _checked(batch: pa.RecordBatch, dtype: str) -> pa.RecordBatch:
    ids, labels, vecs = batch.columns
    ends = np.cumsum(pc.list_value_length(vecs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.r_[0, ends[:-1]]
    # a null component is NaN; + 0.0 makes -0.0 equal to 0.0
    x = vecs.flatten().to_numpy(zero_copy_only=False).astype(dtype) + np.dtype(dtype).type(0)
    finite, some = (np.r_[0, np.cumsum(y)] for y in (np.isfinite(x), x != 0))
    good = (finite[ends] - finite[starts] == ends - starts) & (some[ends] > some[starts])
    good &= np.asarray(ids.is_valid()) & np.asarray(labels.is_valid())
    data, size = x.tobytes(), x.itemsize
    raws = [data[a * size : b * size] for a, b in zip(starts[good].tolist(), ends[good].tolist(), strict=True)]
    mask = pa.array(good)
    digests = pa.array([xxhash.xxh3_128_digest(raw) for raw in raws], pa.binary())
    return pa.record_batch([ids.filter(mask).cast(pa.int64()), labels.filter(mask).cast(pa.string()), digests, pa.array(raws, pa.binary())], ["id", "label", "digest", "vec"])


def _units(vecs, dtype: str) -> np.ndarray:
    """The vectors, in the type they came in, as unit vectors in double precision."""
    x = np.frombuffer(b"".join(vecs), dtype).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_DIRECTIONS: OrderedDict = OrderedDict()


def _directions(leaf: int, nodes: int, dim: int) -> np.ndarray:
    """Unit directions of a subtree's nodes, from the leaf's number."""
    key = (leaf, nodes, dim)
    if key not in _DIRECTIONS:
        d = np.random.default_rng(leaf & (1 << 64) - 1).standard_normal((dim, nodes))
        _DIRECTIONS[key] = d / np.sqrt((d * d).sum(axis=0))
        if len(_DIRECTIONS) > 64:
            _DIRECTIONS.popitem(last=False)
    return _DIRECTIONS[key]


def _margin(dim: int, threshold: float) -> float:
    return SPILL * float(np.sqrt(2 - 2 * threshold)) / np.sqrt(dim)


def _split(p: np.ndarray, cuts: np.ndarray, margin: float) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of a subtree. p: each row's projection on each node's direction, heap order; overlap goes both ways.

    A node without a cut (NaN) is a leaf.
    """
    out, stack = [], [(0, np.arange(len(p)))]
    while stack:
        node, rows = stack.pop()
        if node >= len(cuts) or np.isnan(cuts[node]):
            out.append((node, rows))
            continue
        at = p[rows, node]
        stack.append((2 * node + 1, rows[at <= cuts[node] + margin]))
        stack.append((2 * node + 2, rows[at >= cuts[node] - margin]))
    return out


def fit_cuts(x: np.ndarray, leaf: int, levels: int, margin: float, least: float) -> np.ndarray:
    """The cut of each node, heap order, from the vectors that reach it; NaN for a leaf.

    Of the quantiles from 10 to 90 % that one is taken whose larger side, overlap included, is smallest: it goes round
    a cluster of vectors that are alike. A node of least vectors or fewer, or that no cut makes smaller, is a leaf.
    """
    nodes = 2**levels - 1
    p, cuts = x @ _directions(leaf, nodes, x.shape[1]), np.full(nodes, np.nan)
    reach = {0: np.arange(len(x))}
    for node in range(nodes):
        rows = reach.pop(node, None)
        if rows is None or len(rows) <= least or len(rows) < 8:
            continue
        at = np.sort(p[rows, node])
        tried = np.quantile(at, np.linspace(0.1, 0.9, 17))
        left = np.searchsorted(at, tried + margin, side="right")
        right = len(at) - np.searchsorted(at, tried - margin, side="left")
        side = np.maximum(left, right)
        k = int(np.argmin(side + np.abs(np.arange(17) - 8) * 1e-3))
        if side[k] > MOST_SIDE * len(at):
            continue
        cuts[node] = tried[k]
        at = p[rows, node]
        reach[2 * node + 1], reach[2 * node + 2] = rows[at <= cuts[node] + margin], rows[at >= cuts[node] - margin]
    return cuts


def _levels(n: float, leaf_size: int) -> int:
    return int(min(LEVELS, max(1, np.ceil(np.log2(n / leaf_size)) + 1)))


def _child(leaf: int, child: int) -> int:
    return int(signed(mix(np.array([leaf], np.int64).view(np.uint64) + np.uint64(child + 1)))[0])


def split_whole(leaf: int, x: np.ndarray, leaf_size: int, leaf_most: int, margin: float) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows) of a node whose vectors are all there: the rule of the rounds, until no part is to be split."""
    out, stack = [], [(leaf, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        n, own = len(rows), x[rows]
        some = own[:: -(-n // SAMPLE)]
        cuts = fit_cuts(some, node, _levels(n, leaf_size), margin, leaf_size * len(some) / n)
        for child, members in _split(own @ _directions(node, len(cuts), x.shape[1]), cuts, margin):
            part = (_child(node, child), rows[members])
            (stack if leaf_most < len(members) < STUCK * n else out).append(part)
    return out


def _route(threshold: float, dtype: str):
    """Rows (leaf, n, cuts, id, vec) to their new leaves, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            take, to = [], []
            for one in np.unique(leaf):
                rows = np.flatnonzero(leaf == one)
                cuts = np.array(batch.column(2)[int(rows[0])].as_py(), dtype=np.float64)
                x = _units(batch.column(4).take(pa.array(rows)).to_pylist(), dtype)
                p = x @ _directions(int(one), len(cuts), x.shape[1])
                for child, members in _split(p, cuts, _margin(x.shape[1], threshold)):
                    take.append(rows[members])
                    to.append(np.full(len(members), _child(int(one), child)))
            if take:
                take = np.concatenate(take)
                yield pa.record_batch([pa.array(np.concatenate(to)), pa.array(n[take]), batch.column(3).take(pa.array(take))], ["leaf", "above", "id"])

    return run


def _waves(rows: int, vectors: int, width: int) -> int:
    return max(1, -(-rows * width // max(WAVE_BYTES, vectors * width)))


def _in_wave(c: str, wave: int, waves: int):
    return F.pmod(F.col(c), F.lit(waves)) == wave


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def grow_forest(vectors: DataFrame, dtype: str, trees: int, leaf_size: int, threshold: float, leaf_most: int = LEAF_MOST, whole: int = WHOLE, max_rounds: int = 12) -> list[DataFrame]:
    """vectors (id, root, vec) -> tables (leaf, id) in the shared folder: each vector's leaves in every tree.

    A round splits the nodes with more than whole vectors by up to LEVELS levels: directions are drawn from the
    node's number, cuts are fitted to a sample of the node of about SAMPLE vectors (taken by hash), and every vector
    is routed, to both sides where it is near a cut. Smaller nodes with more than leaf_most vectors are split by one
    task each. Only nodes and identifiers are written; a round reads the vectors of the nodes that it splits from the
    one table of them, in waves of nodes, so that no shuffle holds much more than every vector once. A node that hardly
    shrinks, as of vectors that are all alike, becomes a leaf as it is.
    """
    # the first nodes, one for each root and tree, need no table: each vector is in all its root's
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64("root", t))).alias("leaf")
    total, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(1))).first()
    sizes = vectors.groupBy("root").agg(F.count("*").alias("n")).select(roots, "n")
    sizes = materialize(sizes.withColumn("large", F.col("n") > leaf_most), "sizes", tidy=True)
    now, parts, done = vectors.select("id", "root", roots).select("leaf", "id"), None, []

    def finish(key, table):
        table = table.sort_by("id")
        x = _units(table.column("vec").to_pylist(), dtype)
        found = split_whole(key[0].as_py(), x, leaf_size, leaf_most, _margin(x.shape[1], threshold))
        leaf = np.concatenate([np.full(len(rows), to, np.int64) for to, rows in found])
        return pa.table({"leaf": leaf, "id": table.column("id").take(pa.array(np.concatenate([rows for _, rows in found])))})

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(list(pdf["vec"]), dtype)
        n = float(pdf["n"].iloc[0])
        fitted = fit_cuts(x, int(key[0]), _levels(n, leaf_size), _margin(x.shape[1], threshold), leaf_size * len(x) / n)
        return pd.DataFrame({"leaf": [key[0]], "cuts": [fitted.tolist()]})

    def of(nodes: DataFrame) -> DataFrame:
        if parts is None:
            rows = vectors.select("id", "vec", roots).join(nodes, "leaf")
        else:
            rows = now.join(nodes, "leaf").join(vectors.select("id", "vec"), "id")
        return rows.select("leaf", "n", "id", "vec")

    for _ in range(max_rounds):
        done.append(materialize(now.join(sizes.where("NOT large").select("leaf"), "leaf").select("leaf", "id"), "leaves", tidy=True))
        fits = F.col("n") <= whole
        count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        inner, outer, nodes = sizes.where("large").agg(count(fits), count(~fits), F.count_if(~fits)).first()
        for w in range(waves := _waves(inner, total, width)) if inner else ():
            rows = of(sizes.where(F.col("large") & fits & _in_wave("leaf", w, waves)).select("leaf", "n"))
            done.append(materialize(rows.groupBy("leaf").applyInArrow(finish, "leaf long, id long"), "leaves", tidy=True))
        if not nodes:
            discard(*(parts or ()))
            return done
        large = sizes.where(F.col("large") & ~fits).select("leaf", "n")
        share = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < F.lit(float(SAMPLE) * (1 << 30)) / F.col("n")
        cuts = of(large).where(share).select("leaf", "n", "vec").groupBy("leaf").applyInPandas(fit, "leaf long, cuts array<double>")
        cuts, after = materialize(cuts, "cuts", tidy=True), []
        for w in range(waves := 1 if nodes <= FEW else _waves(outer, total, width)):
            rows = of(large.where(_in_wave("leaf", w, waves))).join(F.broadcast(cuts) if nodes <= FEW else cuts, "leaf")
            routed = rows.select("leaf", "n", "cuts", "id", "vec").mapInArrow(_route(threshold, dtype), "leaf long, above long, id long")
            after.append(materialize(routed, "forest", tidy=True))
        discard(*(parts or ()))
        now, parts = _all(after), after
        sizes = now.groupBy("leaf").agg(F.count("*").alias("n"), F.max("above").alias("above"))
        sizes = materialize(sizes.select("leaf", "n", ((F.col("n") > leaf_most) & (F.col("n") < STUCK * F.col("above"))).alias("large")), "sizes", tidy=True)
    return [*done, now.select("leaf", "id")]


def _compare(threshold: float, dtype: str):
    """Rows sorted by (leaf, i, j): links of each block pair as (id, n, to).

    n counts the partners, by their weight, whose first common leaf this is; to is the smallest id of the links'
    component within the block pair, so that the rows stay as many as the vectors.
    """

    def links(rows: pa.Table) -> list[tuple[int, int, int]]:
        leaf, i, j = key(rows)
        x = _units(rows.column("vec").to_pylist(), dtype)
        block = rows.column("block").to_numpy()
        # in single precision only rows are left out that are surely near none
        y = x.astype(np.float32)
        near = y @ y.T >= np.float32(threshold - (x.shape[1] + 8) * 2.0**-22)
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return []
        x, block, rows = x[some], block[some], rows.take(pa.array(some))
        ids, weight = rows.column("id").to_numpy(), rows.column("weight").to_numpy()
        cosines = x @ x.T
        near = cosines >= threshold
        close = np.argwhere(np.abs(cosines - threshold) < 1e-12)
        for a, b in close:
            near[a, b] = float(np.dot(x[a], x[b])) >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        if not near.any():
            return []
        earlier = [{y for y in o if y < leaf} for o in rows.column("leaves").to_pylist()]
        a, b = np.nonzero(np.triu(near))
        first = np.fromiter((earlier[p].isdisjoint(earlier[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a[first], weight[b[first]])
        np.add.at(n, b[first], weight[a[first]])
        low = ids.copy()
        while True:
            best = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (best == low).all():
                break
            low = best
        return [(int(a), int(b), int(c)) for a, b, c in zip(ids, n, low, strict=True) if b or a != c]

    def key(rows: pa.RecordBatch | pa.Table) -> tuple:
        return tuple(rows.column(c)[0].as_py() for c in ("leaf", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> list[tuple[int, int, int]]:
            rows = pa.Table.from_batches(held).combine_chunks() if held else ()
            held.clear()
            return links(rows) if len(rows) > 1 else []

        def told(out: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["id", "n", "to"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "i", "j")])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out, begin = [], 0
            for end in ends:
                part = batch.slice(begin, end - begin)
                if held and key(held[0]) != key(part):
                    out += flush()
                held.append(part)
                begin = end
            if out:
                yield told(out)
        yield told(flush())

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, trees: int = TREES, leaf_size: int = LEAF, leaf_most: int = LEAF_MOST, block: int = BLOCK, whole: int = WHOLE,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: vectors linked by a cosine of threshold or more.

    Only rows with equal labels and as many components are compared. A vector that is null, empty or zero, holds null
    or non-finite components or has a null label or id links with nothing: 0 links, its own component, kept. Equal
    vectors of a label become one class with a weight, so rows that repeat are links of each other. Other columns are
    not read. An empty table gives an empty result.

    Each label's vectors grow ``trees`` random-projection trees with overlap; vectors that share a leaf are compared
    exactly, in blocks where a leaf is large, and pairs found are verified by their cosine in double precision. A pair
    that several leaves hold is counted in the first one. Whole pairs are never written, only a count and a
    component for each vector and leaf.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    dtype = "float32" if dict(vectors.dtypes)[vec_col] == "array<float>" else "float64"
    good = rows.mapInArrow(_valid(dtype), "id long, label string, digest binary, vec binary")
    full = materialize(good.withColumn("run", spread("id", RUNS)), "vectors", tidy=True)
    first = full.groupBy("run", "label", "digest").agg(F.min("id").alias("low"), F.count("*").alias("m"))
    classes = materialize(first.groupBy("label", "digest").agg(F.min("low").alias("rep"), F.sum("m").alias("weight")), "classes", tidy=True)
    reps = full.join(classes.select("label", "digest", F.col("rep").alias("id"), "weight"), ["label", "digest", "id"]).dropDuplicates(["label", "digest", "id"])
    # a class is known by its place among labels and digests; its smallest id may be that of another class, too
    reps = materialize(reps.select(F.xxhash64("label", "digest").alias("id"), F.xxhash64("label", F.octet_length("vec")).alias("root"), "vec", "weight"), "reps", tidy=True)
    slim = materialize(full.select("id", "run", "label", "digest"), "rows", tidy=True)
    discard(full)
    first = slim.groupBy("run", "label", "digest").agg(F.count("*").alias("m"))
    grown = grow_forest(reps.select("id", "root", "vec"), dtype, trees, leaf_size, threshold, leaf_most, whole)
    forest = _all(grown)
    crowded = forest.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_most).select("leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    crowded = materialize(crowded, "crowded", tidy=True)
    crowded = F.broadcast(crowded) if crowded.limit(FEW + 1).count() <= FEW else crowded
    members = forest.count()
    total, width = reps.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(1))).first()
    parts = []
    for w in range(waves := min(4, max(1, -(-total * width // WAVE_BYTES)))):
        leaves = forest.where(_in_wave("id", w, waves)).groupBy("id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
        parts.append(materialize(reps.where(_in_wave("id", w, waves)).select("id", "weight", "vec").join(leaves, "id"), "placed", tidy=True))
    discard(reps, *grown)
    placed, found = _all(parts), []
    for w in range(waves := _waves(members, total, width)):
        mine = F.explode(F.filter("leaves", lambda y: F.pmod(y, F.lit(waves)) == w)).alias("leaf")  # noqa: B023
        dealt = placed.select("id", "weight", "leaves", "vec", mine).join(crowded, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
        dealt = dealt.withColumn("pair", pair).select("leaf", "pair.i", "pair.j", "id", "weight", "leaves", "vec", "block")
        links = dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(_compare(threshold, dtype), "id long, n long, to long")
        found.append(materialize(links, "found", tidy=True))
    discard(*parts)
    found = _all(found)
    n_links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    names = classes.select(F.xxhash64("label", "digest").alias("class"), "label", "digest", "rep", "weight")
    of_class = names.join(parts.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    low = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(low, "component").join(n_links.withColumnRenamed("id", "class"), "class", "left")
    of_class = of_class.select("label", "digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    back = first.select("run", "label", "digest").join(of_class, ["label", "digest"])
    linked = slim.select("id", "run", "label", "digest").join(back, ["run", "label", "digest"]).select("id", "n_links", "component_id")
    # rows that cannot link, found by the same test
    rest = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    zero = F.forall("v", lambda x: x == 0)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    none = F.col("id").isNull() | F.col("label").isNull() | F.col("v").isNull() | (F.size("v") == 0) | F.coalesce(bad, F.lit(True)) | F.coalesce(zero, F.lit(True))
    rest = rest.where(none).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
