"""Set-similarity self-join of word shingles by PartEnum signatures.

The feature domain is dealt by hash into first-level partitions, each of them into second-level ones. Two sets of one
size band that differ in at most k features differ in at most one feature in some first-level partition, and so agree
on some subset of its second-level partitions. A signature is the hash of a set's features in one such subset, so every
pair with enough similarity shares a signature; exact checks follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, discard, hidden, in_ids, materialize, mix, not_in_ids, one_of_each, quoted, read, shingles, signed, spread, text_slices
from .components import anew, connected_components

#: In groups of more than GROUP_SETS sets, larger buckets are checked by a star and then by blocks, not pair by pair.
SMALL_BUCKET = 32
#: Sets, and features of sets, on one side of a block.
BLOCK_SETS, BLOCK_FEATURES = 512, 1_000_000
#: Sets that shared signatures connect are one group if they are no more than this, else each bucket is on its own.
GROUP_SETS = 8192
RUNS = 64
#: A feature that so many sets of a task's window of FREQUENT_WINDOW features share is counted; of those counted so
#: often in all, at most FREQUENT_MOST, the commonest, are left out of the signatures.
FREQUENT_LOCAL, FREQUENT_TOTAL, FREQUENT_WINDOW, FREQUENT_MOST = 2, 3, 4_000_000, 2_000_000
#: A signature that so many sets of a slice share is common: the task tells of it twice and deals the other rows by set.
COMMON_LOCAL, COMMON_MOST = 16, 1 << 20
#: Rows with an equal set of a smaller identifier that are broadcast to leave them out, at most.
COPIES = 1_000_000


@dataclass(frozen=True)
class Plan:
    """Signature parameters of one size band: sets whose larger one has low to high features."""

    band: int
    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int
    slack: int


@lru_cache(maxsize=64)
def bands(num: int, den: int, most: int) -> tuple[Plan, ...]:
    """Plans for the similarity num/den up to sets of most features."""
    out, low = [], 1
    while low <= most:
        after = max(low + 1, -(-low * den * den // (num * num)))
        high = after - 1
        k = 2 * high * (den - num) // (den + num)
        # a signature covers about (den+num)/(den-num)/2 features with one of two second-level partitions; where
        # that is few, and where one partition is enough, two of four are taken
        n2, k2 = (2, 1) if 2 * 11 * (den - num) < 2 * (den + num) and k != 2 else (4, 2)
        n1 = k // (k2 + 1) + 1
        # spare first-level partitions: so many with an empty projection can be left out without losing a pair
        slack = -(-n1 // 5) if n1 >= 5 else 0
        out.append(Plan(len(out), low, high, k, n1 + slack, n2, k2, slack))
        low = after
    return tuple(out)


_TAG = np.uint64(0xD1B54A32D192ED03)


_NONE = np.zeros(0, np.uint64)
_BITS = np.uint64((1 << 48) - 1)
#: Not a signature: from here on, rows that tell a set's number of partitions with an empty projection.
_WEAK = np.uint64(1 << 50)
#: Above these bits is a hash of the set, not 0, in rows that need not meet the others of their signature.
_OWN_BITS = 51
_OWN = np.uint64((1 << _OWN_BITS) - 1)


def signatures(features: np.ndarray, num: int, den: int, frequent: np.ndarray = _NONE) -> np.ndarray:
    return _signatures(features, num, den, frequent)[0]


def _signatures(features: np.ndarray, num: int, den: int, frequent: np.ndarray = _NONE) -> tuple[np.ndarray, int]:
    """All signatures of one set (sorted distinct 64-bit hashes), and its first-level partitions with an empty projection.

    Two different sets with a similarity of num/den or more share one. Features in frequent (sorted) are left out of
    the partitions, for every set alike: what is left of two sets differs in no more features than the sets do. An
    empty projection gives no signature; a set with more empty ones than its band's slack adds the signatures of a
    prefix filter, which two such sets share. Its order takes the frequent features last.
    """
    n = len(features)
    out, poor, weak, whole = [], False, 0, features
    if len(frequent):
        at = np.searchsorted(frequent, features)
        at[at == len(frequent)] = 0
        common = frequent[at] == features
        features = features[~common]
        whole = np.concatenate([features, whole[common]])
    values = mix(features + _TAG)
    for p in bands(num, den, max(64, 2 * n)):
        if p.high < n or not p.k:
            continue
        if num * p.low > den * n:
            break
        if not len(features):
            poor, weak = True, max(weak, p.n1)
            continue
        tag = mix(np.array([p.band + 1], np.uint64) * _TAG)
        cell = ((features >> np.uint64(20)) % np.uint64(p.n1)).astype(np.int64) * p.n2 + ((features >> np.uint64(4)) % np.uint64(p.n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        at = cell[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sums, at = np.add.reduceat(values[order], first), at[first]
        cells, present = np.zeros(p.n1 * p.n2, np.uint64), np.zeros(p.n1 * p.n2, bool)
        cells[at], present[at] = sums, True
        cells, present = cells.reshape(p.n1, p.n2), present.reshape(p.n1, p.n2)
        for number, chosen in enumerate(combinations(range(p.n2), p.n2 - p.k2)):
            have = np.flatnonzero(present[:, chosen].any(axis=1))
            total = cells[have][:, chosen].sum(axis=1, dtype=np.uint64)
            out.append(mix(total + mix((have.astype(np.uint64) * np.uint64(64) + np.uint64(number + 1)) * _TAG + tag)))
        empty = int(((~present).sum(axis=1) >= p.n2 - p.k2).sum())
        poor, weak = poor or empty > p.slack, max(weak, empty)
    if poor:
        out.append(mix(whole[: n - (-(-num * n // den)) + 1] ^ _TAG))
    # 48 bits are enough to tell buckets apart, and shorter to shuffle; what meets by chance is compared anyway
    return (np.concatenate(out) & _BITS if out else _NONE), weak


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in text_slices(batch.column(1)):
                sets = shingles(data, offsets, width)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.record_batch([ids.slice(row, len(sets)), pa.array(n), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], ["id", "n", "d1", "d2"])

    return run


def _count_features(width: int):
    """(feature, n) of the features that many sets of a window of the task's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            f, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= FREQUENT_LOCAL
            held.clear()
            return pa.record_batch([pa.array(signed(f[keep])), pa.array(n[keep].astype(np.int64))], ["feature", "n"])

        for batch in batches:
            for _, data, offsets in text_slices(batch.column(1)):
                held += shingles(data, offsets, width)
                size += sum(map(len, held[len(held) - (len(offsets) - 1) :]))
                if size >= FREQUENT_WINDOW:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def frequent_features(texts: DataFrame, width: int) -> np.ndarray:
    """The commonest features, sorted; a bounded list that only speeds the search up, whatever it holds."""
    counted = texts.mapInArrow(_count_features(width), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT_TOTAL).orderBy(F.desc("n"), "feature").limit(FREQUENT_MOST).select("feature").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64)) if top.num_rows else _NONE


def _deal(sigs: np.ndarray, owners: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, dealt by set where they are known to be shared, and the longer list of common ones.

    Of each signature that a slice has often the first two rows stay as they are, once a task, so that rows of other
    tasks meet them; the rest, and all rows that tell of empty projections, get a hash of their set in the upper bits.
    So no task takes all rows of a signature that many sets have.
    """
    found, first, number, n = np.unique(sigs, return_index=True, return_inverse=True, return_counts=True)
    known = np.isin(found, common, assume_unique=True) | (found >= _WEAK)
    new = ~known & (n >= COMMON_LOCAL)
    apart = (known | new)[number]
    if new.any():
        again = np.setdiff1d(np.arange(len(sigs)), first, assume_unique=True)  # first rows but one of each
        second = again[np.unique(number[again], return_index=True)[1]]
        for stays in (first[new], second[new[number[second]]]):
            apart[stays] = False
        if len(common) < COMMON_MOST:
            common = np.union1d(common, found[new])
    own = (mix(owners.view(np.uint64)) % np.uint64(4095) + np.uint64(1)) << np.uint64(_OWN_BITS)
    return np.where(apart, sigs | own, sigs), common


def _sign(width: int, num: int, den: int, frequent, remember: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        common = _NONE
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_slices(batch.column(1)):
                sigs, owners = [], []
                for k, s in enumerate(shingles(data, offsets, width)):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if digest in seen:  # this task has sent an equal set's signatures
                        continue
                    if len(seen) < remember:
                        seen.add(digest)
                    x, weak = _signatures(s, num, den, frequent.value)
                    x = np.append(x, _WEAK + np.uint64(weak)) if weak else x
                    sigs.append(x)
                    owners.append(np.full(len(x), ids[row + k], np.int64))
                if sigs and sum(map(len, sigs)):
                    owners = np.concatenate(owners)
                    dealt, common = _deal(np.concatenate(sigs), owners, common)
                    yield pa.record_batch([pa.array(signed(dealt)), pa.array(owners)], ["sig", "id"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig those whose sig another row has, or is known to have."""
    before, held = None, None

    def rows(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(sig & int(_OWN)), pa.array(ids)], ["sig", "id"])

    for batch in batches:
        sig, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        if held is not None:
            sig, ids = np.r_[held[0], sig], np.r_[held[1], ids]
        same = sig[1:] == sig[:-1]
        keep = np.r_[before is not None and sig[0] == before, same] | np.r_[same, False]
        keep |= sig >= int(_WEAK)
        keep, last_before = keep[:-1], sig[-2] if len(sig) > 1 else before
        if keep.any():
            yield rows(sig[:-1][keep], ids[:-1][keep])
        before, held = last_before, (sig[-1:], ids[-1:])
    if held is not None and (held[0][0] >= int(_WEAK) or before is not None and held[0][0] == before):
        yield rows(*held)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                sets = shingles(data, offsets, width)
                yield pa.record_batch([batch.column(0).slice(row, len(sets)), binary_column(sets)], ["id", "features"])

    return run


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if num * len(large) > den * len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _low_bits(features: np.ndarray, bits: int) -> np.ndarray:
    """The distinct values of the features' low bits, sorted."""
    return np.unique(features.astype(np.uint16 if bits == 16 else np.uint32))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as the low bits of their features, 16 of them for small sets and 32 for others, after the size."""
    for batch in batches:
        out = []
        for raw in batch.column(1).to_pylist():
            x = np.frombuffer(raw, np.uint64)
            low = _low_bits(x, 16 if len(x) < 2048 else 32)
            out.append(len(x).to_bytes(4, "little") + low.tobytes())
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["id", "features"])


def _may_be_similar(a: bytes, b: bytes, num: int, den: int) -> bool:
    """Of two reduced sets: False only if the sets are not similar, as equal features have equal low bits."""
    (na, x), (nb, y) = ((int.from_bytes(r[:4], "little"), r[4:]) for r in (a, b))
    if num * max(na, nb) > den * min(na, nb):
        return False
    x, y = (np.frombuffer(r, np.uint16 if n < 2048 else np.uint32) for n, r in ((na, x), (nb, y)))
    if x.dtype != y.dtype:
        x, y = _low_bits(x, 16), _low_bits(y, 16)
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    most = int((large[at] == small).sum()) + min(na - len(x), nb - len(y))
    return den * most >= num * (na + nb - most)


def _are_similar(a: bytes, b: bytes, num: int, den: int) -> bool:
    return _similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), num, den)


def _check_stars(test, num: int, den: int):
    """Rows sorted by (a, block, role): the set of a comes before those it is held against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            out = []
            for a, i, role, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "id", "role", "features")), strict=True):
                if role == 0:
                    hub, hub_set = a, raw
                elif hub == a and test(hub_set, raw, num, den):
                    out.append((a, i))
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _block_links(items: list[tuple[int, int, np.ndarray]], same: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among items (id, side, features): all of them, or those between the sides."""
    sides, sets = np.array([x[1] for x in items]), [x[2] for x in items]
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    all_features = np.concatenate(sets)
    order = np.argsort(all_features, kind="stable")
    f, owner = all_features[order], owner[order]
    number = np.cumsum(np.r_[True, f[1:] != f[:-1]]) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], number[shared]
    number = np.unique(number, return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, [start, start + 4096])
        m = np.zeros((len(sets), min(4096, int(number.max()) + 1 - start)), np.float32)
        m[owner[a:b], number[a:b] - start] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    link = np.triu(den * both >= num * (sizes[:, None] + sizes[None, :] - both), 1)
    if not same:
        link &= sides[:, None] != sides[None, :]
    ids = [x[0] for x in items]
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for p, q in zip(*np.nonzero(link), strict=True):
        x, y = find(int(p)), find(int(q))
        if x != y:
            parent[y] = x
            if ids[p] != ids[q]:
                out.append((ids[p], ids[q]))
    return out


def _check_blocks(num: int, den: int, sided: bool):
    """Rows sorted by (sig, i, j); sided: between roles 0 and 1 only, else between blocks, or all of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = None, []

        def flush() -> pa.RecordBatch:
            out = _block_links(items, not sided and key[1] == key[2], num, den) if len(items) > 1 else []
            return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *at, side, i, raw in zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j", "role", "id", "features")), strict=True):
                if at != key:
                    if key is not None:
                        yield flush()
                    key, items = at, []
                if raw:
                    items.append((i, side, np.frombuffer(raw, np.uint64)))
        if key is not None:
            yield flush()

    return run


def _sets_of(width: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(len(columns))):
                sets = shingles(data, offsets, width)
                yield pa.record_batch([*(batch.column(k).slice(row, len(sets)) for k in range(len(columns))), binary_column(sets)], [*columns, "features"])

    return run


def _blocks(m, f):
    return F.greatest(F.ceil(m / BLOCK_SETS), F.ceil(f / BLOCK_FEATURES)).cast("int")


def _verify_groups(groups: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links within groups (group, rep, n), each block of a group against each. A set goes once to each pair of blocks.

    The texts are joined with where they are needed, by broadcast up to COPIES places (counted first), and their
    sets worked out again; so only sets of candidates are shuffled, once.
    """
    shape = groups.groupBy("group").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")).select(anew("group"), "blocks")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("role")).alias("i"), F.greatest(k, F.col("role")).alias("j"))))
    dealt = groups.join(shape, "group").select("group", "rep", "blocks", block.alias("role")).withColumn("pair", pair)
    dealt = materialize(dealt.select(F.col("group").alias("sig"), "pair.i", "pair.j", "role", F.col("rep").alias("id")), "dealt")
    rows = texts.join(F.broadcast(dealt) if dealt.count() <= COPIES else dealt, "id").select(*dealt.columns, "text")
    return (
        rows.mapInArrow(_sets_of(width, dealt.columns), "sig long, i int, j int, role int, id long, features binary")
        .repartition("sig", "i", "j")
        .sortWithinPartitions("sig", "i", "j", "id")
        .mapInArrow(_check_blocks(num, den, False), "a long, b long")
    )


def _least_shared(n, num: int, den: int, most: int):
    """Signatures that two similar sets share at least, by the size of either without empty projections."""
    out, before = F.lit(1), 0
    for p in bands(num, den, most):
        if p.slack != before and p.k:
            out = out + F.when(n >= p.low, p.slack - before).otherwise(0)
            before = p.slack
    return out


def _shared_enough(buckets: DataFrame, num: int, den: int, rounds: int = 2) -> DataFrame:
    """Of (sig, rep, n) the rows of sets that share as many signatures as a similar pair must; then sig's m and lead.

    A set that shares fewer can have no similar one, however its signatures met; dropping it may leave others with
    fewer. So texts that have a passage in common, but not more, don't connect.
    """
    weak = buckets.where(F.col("sig") >= int(_WEAK)).groupBy("rep").agg((F.max("sig") - int(_WEAK)).alias("weak"))
    now = buckets.where(F.col("sig") < int(_WEAK))
    most = buckets.agg(F.max("n")).first()[0] or 1
    for _ in range(rounds):
        meet = now.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").select(anew("sig"))
        now = materialize(now.join(meet, "sig"), "meet")
        own = now.groupBy("rep", "n").agg(F.count("*").alias("c")).join(weak, "rep", "left")
        enough = own.where(F.col("c") >= _least_shared(F.col("n"), num, den, most) - F.coalesce("weak", F.lit(0))).select("rep")
        now = now.join(enough, "rep").select("sig", "rep", "n")
    now = materialize(now, "enough")
    return now.join(now.groupBy("sig").agg(F.count("*").alias("m"), F.min("rep").alias("lead")).where("m > 1").select(anew("sig"), "m", "lead"), "sig")


def _fetch_sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    return materialize(in_ids(texts, ids, "id").mapInArrow(_sets(width), "id long, features binary"), "sets")


def _hold_against(pairs: DataFrame, sets: DataFrame, test, num: int, den: int, block: int = 256) -> DataFrame:
    """The pairs (a, b) that pass test. A hub's partners are dealt into blocks; each block gets the hub's set once."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    rows = dealt.select("a", "block", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(
        dealt.select("a", "block", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
    )
    return (
        rows.join(sets, "id")
        .repartition("a", "block")
        .sortWithinPartitions("a", "block", "role")
        .mapInArrow(_check_stars(test, num, den), "a long, b long")
    )


def _verify_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar: reduced sets rule most others out, whole sets decide."""
    reduced = sets.mapInArrow(_reduce, "id long, features binary")
    maybe = materialize(_hold_against(pairs, reduced, _may_be_similar, num, den), "maybe")
    return _hold_against(maybe, sets, _are_similar, num, den)


def _verify_large(large: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components inside the large buckets (sig, rep, n), blocks against blocks.

    After the stars most members of a bucket are in one component; only the others are held against all its members.
    """
    parts = connected_components(links)
    rows = large.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "sig", "rep", "n", F.coalesce("component", "rep").alias("part")
    )
    rows = materialize(rows, "large")
    per_part = rows.groupBy("sig", "part").agg(F.count("*").alias("m"), F.sum("n").alias("f"))
    shape = (
        per_part.groupBy("sig")
        .agg(F.max_by("part", F.struct("m", "part")).alias("major"), F.max(F.struct("m", "part", "f")).alias("top"), F.sum("m").alias("m"), F.sum("f").alias("f"), F.count("*").alias("parts"))
        .where("parts > 1")
    )
    shape = shape.select(
        "sig", "major", _blocks(F.col("m"), F.col("f")).alias("nj"),
        _blocks(F.col("m") - F.col("top.m"), F.col("f") - F.col("top.f")).alias("ni"),
    )
    rows = rows.join(shape, "sig")
    dealt = rows.where("part <> major").select(
        "sig", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ni")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("role"), F.col("rep").alias("id"),
    ).unionByName(
        rows.select(
            "sig", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"),
            F.pmod(F.xxhash64("rep", F.lit(2)), F.col("nj")).cast("int").alias("j"), F.lit(1).alias("role"), F.col("rep").alias("id"),
        )
    )
    return (
        dealt.join(sets, "id")
        .repartition("sig", "i", "j")
        .sortWithinPartitions("sig", "i", "j")
        .mapInArrow(_check_blocks(num, den, True), "a long, b long")
    )


def _verify_buckets(sized: DataFrame, texts: DataFrame, width: int, num: int, den: int, small_bucket: int) -> DataFrame:
    """Links within buckets (sig, rep, n, m, lead) whose group is too large to be taken as a whole.

    Pairs of small buckets are checked one by one; in a larger bucket all members are held against its smallest one,
    and then those outside its largest component against all, in blocks.
    """
    little, large = sized.where(F.col("m") <= small_bucket), sized.where(F.col("m") > small_bucket)
    x = little.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"))
    y = little.select("sig", F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.greatest("na", "nb") * num <= F.least("na", "nb") * den) & (F.col("a") < F.col("b"))
    pairs = x.join(y, "sig").where(fits).select("a", "b")
    stars = large.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(large.select(F.col("rep").alias("id"))).distinct()
    sets = _fetch_sets(texts, materialize(wanted, "wanted"), width)
    links = materialize(_verify_pairs(pairs, sets, num, den), "links")
    if large.limit(1).count():
        links = links.unionByName(materialize(_verify_large(large.select("sig", "rep", "n"), links, sets, num, den), "links"))
    return links


def ngram_jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    num: int = 85,
    den: int = 100,
    small_bucket: int = SMALL_BUCKET,
    group_sets: int = GROUP_SETS,
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: documents linked by a Jaccard similarity of num/den or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, a set is the distinct width-word shingles (the whole
    sequence as one where there are fewer words). Rows without words, null texts included, link with nothing and are
    their own component. Identifiers are integers and name a document; repeated rows are returned each and share
    their component; a null identifier links with nothing and has a null component. Other columns are not read. An
    empty table gives an empty result.

    Equal sets become one class first. The commonest features, from counts over all texts, are left out of the
    signatures (not of the comparison), so that passages which many texts share don't connect them. Signatures that one class alone has are dropped where they meet. Classes that
    a chain of shared signatures connects are a group; a group of up to group_sets sets is compared as a whole, in
    blocks, a larger one bucket by bucket. So no pair is lost and no group meets in one task.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slim = materialize(texts.mapInArrow(_describe(width), "id long, n long, d1 long, d2 long").withColumn("run", spread("id", RUNS)), "shingles")
    real = slim.where("n > 0 AND id IS NOT NULL")
    first = real.groupBy("run", "d1", "d2").agg(F.min("id").alias("low"))
    reps = first.groupBy("d1", "d2").agg(F.min("low").alias("rep"))
    back = first.select("run", "d1", "d2").join(reps, ["d1", "d2"])
    members = materialize(
        slim.join(back, ["run", "d1", "d2"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "members"
    )
    # an equal set's signatures say nothing new; where such rows are too many to broadcast, later steps drop theirs
    copies = materialize(members.where("rep <> id").select("id").distinct(), "same")
    alone = not_in_ids(texts, copies, "id") if copies.limit(COPIES + 1).count() <= COPIES else texts
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_features(alone, width))
    shared = (
        alone.where("id IS NOT NULL")
        .mapInArrow(_sign(width, num, den, frequent), "sig long, id long")
        .repartition("sig")
        .sortWithinPartitions("sig", "id")
        .mapInArrow(_shared, "sig long, id long")
    )
    buckets = shared.join(members.where("rep IS NOT NULL"), "id").select("sig", "rep", "n").distinct()
    buckets = materialize(buckets, "buckets")
    sized = materialize(_shared_enough(buckets, num, den), "sized")
    discard(buckets)
    groups = connected_components(sized.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    groups = materialize(groups.select(F.col("id").alias("rep"), F.col("component").alias("group")), "groups")
    large = groups.groupBy("group").count().where(F.col("count") > group_sets).select("group")
    large = materialize(large, "large")
    small = groups.join(large, "group", "left_anti").join(members.where("id = rep").select("rep", "n").distinct(), "rep")
    links = materialize(_verify_groups(small.select("group", "rep", "n"), texts, width, num, den), "links")
    if large.limit(1).count():
        rest = sized.join(groups.join(large, "group").select("rep"), "rep", "left_semi")
        links = links.unionByName(_verify_buckets(rest, texts, width, num, den, small_bucket))
    parts = connected_components(links)
    discard(sized, slim)
    return members.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")
    )


def _apart(docs: DataFrame, id_col: str, text_col: str, again: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs with a key that names an identifier and text together, and (key, id) of the keys that are not identifiers.

    Identifiers in again (id) have several rows, or are null. Each of their texts gets a number that is no identifier.
    """
    digest, other, mine = hidden(docs.withColumn(key, F.lit(0)), "digest", "other", "mine")
    marked = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    many = again.select(F.col("id").alias(mine))
    own = marked.join(many, F.col(id_col).eqNullSafe(F.col(mine)), "left_semi").select(F.col(id_col).cast("long").alias(mine), F.col(digest).alias(other))
    own = materialize(own.distinct().withColumn("n", F.monotonically_increasing_id()), "own")
    low, high = docs.agg(F.coalesce(F.min(id_col), F.lit(0)).cast("long"), F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()
    most = own.agg(F.max("n")).first()[0]
    if low - 1 - most >= -(1 << 63):
        number = F.lit(low - 1) - F.col("n")
    elif high + 1 + most < 1 << 63:
        number = F.lit(high + 1) + F.col("n")
    else:
        raise ValueError("identifiers leave no room for those of repeated ones")
    own = own.select(mine, other, number.alias(key))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(mine)) & (F.col(digest) == F.col(other))
    keyed = marked.join(own, same, "left").withColumn(key, F.coalesce(F.col(key), F.col(id_col).cast("long")))
    return keyed.select(*quoted(*docs.columns, key)), own.select(key, F.col(mine).alias("id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one document, that of the smallest identifier, of each component; all columns stay, whatever their names.

    Where several rows have one identifier, or it is null, each of their texts is a document of its own; a null
    identifier comes last. Of rows with one identifier and one text one stays (by a hash of all columns). Rows without
    words stay, one for each identifier and text. An empty table stays empty.
    """
    (key,) = hidden(docs, "key")
    again = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    again = materialize(again.select("id"), "again")
    if not again.limit(1).count():
        parts = ngram_jaccard_components(docs, id_col, text_col, width, num, den)
        gone = materialize(parts.where(f"`{id_col}` <> component_id").select(id_col).distinct(), "near")
        return not_in_ids(docs, gone, id_col)
    keyed, own = _apart(docs, id_col, text_col, again, key)
    keyed = materialize(keyed, "keyed")
    parts = ngram_jaccard_components(keyed, key, text_col, width, num, den).select(F.col(key).alias("k"), "component_id").distinct()
    parts = parts.join(own.select(F.col(key).alias("k"), "id", F.lit(True).alias("own")), "k", "left")
    place = F.struct(((F.col("own").isNotNull()) & F.col("id").isNull()).alias("none"), F.coalesce("id", "k").alias("id"), "k")
    parts = materialize(parts.select("k", "component_id", place.alias("place")), "parts")
    best = parts.groupBy("component_id").agg(F.min("place").alias("best"))
    gone = parts.join(best, "component_id").where("place.k <> best.k").select(F.col("k").alias(key))
    rows = not_in_ids(keyed, materialize(gone, "near"), key)
    mine = materialize(own.select(key), "mine")
    alone = not_in_ids(rows, mine, key).select(*quoted(*docs.columns))
    return alone.unionByName(one_of_each(in_ids(rows, mine, key), [key], F.lit(0), docs.columns))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END)) AS sh
  FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN c a ON a.rep = x JOIN c b ON b.rep = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM r JOIN u ON r.seen = u.x),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.component, c.rep, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.node = c.rep
"""
