"""Joins: tag overlap, anti and semi joins, link traversal, alias chains, hash alignment, similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.overlap import longest_run
from turnstone.functions.vectors import cosine
from turnstone.sources.shared import materialize


def by_tags(segments: DataFrame, tags: list[str], least: int, limit: int) -> DataFrame:
    """(ref, overlap): segments that share at least ``least`` tags, most first, then newest."""
    n = F.size(F.array_intersect(F.array_distinct("tags"), F.array(*map(F.lit, tags)))).cast("long")
    return segments.select("ref", "created_at", n.alias("overlap")).where(F.col("overlap") >= least).orderBy(F.desc("overlap"), F.desc("created_at"), "ref").limit(limit)


def exploded(segments: DataFrame) -> DataFrame:
    return segments.select("ref", "conversation_id", F.explode("tags").alias("tag"))


def both_ways(links: DataFrame) -> DataFrame:
    """Each link as an edge from both ends."""
    return links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation_type", "confidence").unionByName(
        links.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "relation_type", "confidence")
    )


def linked_facts(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops): facts within depth links of a seed (id), seeds left out, at the fewest hops; depth is 1 to 5.

    Each hop joins the frontier with the links and leaves out what was seen, so a hop's rows are those it adds; they are
    written to the shared folder, so that a later hop doesn't work out the earlier ones again.
    """
    depth = max(1, min(5, depth))
    edges = both_ways(links).select("a", "b")
    seen = seeds.select("id", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(edges, frontier["id"] == edges["a"]).select(F.col("b").alias("id")).distinct()
        frontier = materialize(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops")), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def alias_terminals(aliases: DataFrame, most: int = 8) -> DataFrame:
    """(alias, target) -> (alias, terminal, hops, state): ok, cycle, or too_long beyond ``most`` hops."""
    walk = aliases.select("alias", F.col("target").alias("at"), F.array("alias", "target").alias("path"), F.lit(1).alias("hops"))
    step = aliases.select(F.col("alias").alias("from"), F.col("target").alias("to"))
    done = None
    for _ in range(most):
        joined = walk.join(step, walk["at"] == step["from"], "left")
        ended = joined.where("to IS NULL").select("alias", F.col("at").alias("terminal"), "hops", F.lit("ok").alias("state"))
        cycle = joined.where("to IS NOT NULL AND array_contains(path, to)").select("alias", F.lit(None).cast("long").alias("terminal"), "hops", F.lit("cycle").alias("state"))
        done = ended.unionByName(cycle) if done is None else done.unionByName(ended).unionByName(cycle)
        walk = joined.where("to IS NOT NULL AND NOT array_contains(path, to)").select("alias", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), (F.col("hops") + 1).alias("hops"))
    return done.unionByName(walk.select("alias", F.lit(None).cast("long").alias("terminal"), "hops", F.lit("too_long").alias("state")))


def alignment(stored: DataFrame, incoming: DataFrame, least: int = 3) -> DataFrame:
    """Longest run of equal turn hashes of two sequences (key, pos, hash): (key, shift, start, matched).

    Positions are consecutive. shift is the incoming minus the stored position; of equally long runs the one with the
    least shift counts, then the first. A key's hashes meet in one task; the time is near to linear, however often a
    sequence repeats itself.
    """
    kind = dict(incoming.dtypes)["key"]

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias(name)).select("key", F.col(f"{name}.pos").alias(f"{name}_pos"), F.col(f"{name}.hash").alias(name))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, a_pos, a, b_pos, b in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                run = longest_run(a, b, least, by_shift=True)
                if run:
                    out.append((key, b_pos[run[1]] - a_pos[run[0]], b_pos[run[1]], run[2]))
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = (batch.schema.field("key").type, pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "shift", "start", "matched"])

    both = listed(stored, "a").join(listed(incoming, "b"), "key")
    return both.mapInArrow(longest, f"key {kind}, shift long, start long, matched long")


def similar_tags(tags: DataFrame, least: float) -> DataFrame:
    """Pairs of distinct tags whose edit distance is small: 1 - distance / longer length >= least.

    A tag of length n differs from a similar one, no longer than itself, in at most e = floor((1 - least) * n) edits. Cut
    into e + 1 pieces, one piece is whole in the other tag, at most e places off. So pieces and substrings meet in an
    equi-join on (n, piece number, text), and only what meets is measured: no pairs of all tags.
    """
    t = tags.select("tag").where(F.char_length("tag") > 0).distinct()
    edits = lambda n: F.floor((1 - least) * n + 1e-9).cast("int")
    n = F.char_length("tag")
    pieces = t.select(F.col("tag").alias("a"), n.alias("n"), F.explode(F.sequence(F.lit(0), edits(n))).alias("i"))
    parts = edits(F.col("n")) + 1
    begin, end = F.floor(F.col("i") * F.col("n") / parts).cast("int"), F.floor((F.col("i") + 1) * F.col("n") / parts).cast("int")
    pieces = pieces.select("a", "n", "i", F.substr("a", begin + 1, end - begin).alias("part"))
    longer = t.select(F.col("tag").alias("b"), n.alias("m"), F.explode(F.sequence(n, F.floor(n / least + 1e-9).cast("int"))).alias("n"))
    probes = longer.where(F.col("n") - F.col("m") <= edits(F.col("n"))).select("b", "m", "n", F.explode(F.sequence(F.lit(0), edits(F.col("n")))).alias("i"))
    probes = probes.select("b", "m", "n", "i", begin.alias("at"), (end - begin).alias("size"), edits(F.col("n")).alias("e"))
    first, last = F.greatest(F.lit(0), F.col("at") - F.col("e")), F.least(F.col("m") - F.col("size"), F.col("at") + F.col("e"))
    probes = probes.where(first <= last).select("b", "n", "i", "size", F.explode(F.sequence(first, last)).alias("s"))
    probes = probes.select("b", "n", "i", F.substr("b", F.col("s") + 1, F.col("size")).alias("part")).distinct()
    pairs = pieces.join(probes, ["n", "i", "part"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sim = 1 - F.levenshtein("a", "b") / F.greatest(F.char_length("a"), F.char_length("b"))
    return pairs.select("a", "b", F.round(sim, 6).alias("similarity")).where(sim >= least - 1e-12)


def merge_candidates(segments: DataFrame, least: int = 2, run: int = 10_000) -> DataFrame:
    """(ref, best): for each of segments (ref, primary_tag, tags), the best earlier one of any age with its primary tag.

    The score is common tags / 3 * max(0.5, 1 - age / 60), age being the distance in refs; ``least`` tags are in common at
    least, and of equal scores the latest wins. A score never grows with age, so the best is, of the latest earlier rows
    with each set of the row's tags, the best one: no pairs of a hot tag are made. Rows come in runs of refs, and a run's
    latest row with a set is handed to the next, so that no hot set is in one task. There are 2^n sets of n tags.
    """
    s = segments.select("ref", "primary_tag", F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))).alias("tags"))
    empty = F.expr("array(cast(array() as array<string>))")
    sets = F.aggregate("tags", empty, lambda done, t: F.concat(done, F.transform(done, lambda x: F.concat(x, F.array(t)))))
    keyed = s.select("ref", "primary_tag", F.explode(sets).alias("key"), F.floor(F.col("ref") / run).alias("run")).where(F.size("key") >= least)
    by = ["primary_tag", "key"]
    latest = keyed.groupBy(*by, "run").agg(F.max("ref").alias("latest"))
    latest = latest.select(*by, "run", F.lag("latest").over(Window.partitionBy(*by).orderBy("run")).alias("handed"))
    within = Window.partitionBy(*by, "run").orderBy("ref").rangeBetween(Window.unboundedPreceding, -1)
    found = keyed.select("*", F.max("ref").over(within).alias("here")).join(latest, [*by, "run"])
    found = found.select("ref", F.size("key").alias("n"), F.coalesce("here", "handed").alias("best")).where("best IS NOT NULL")
    score = F.round(F.col("n") / 3.0 * F.greatest(F.lit(0.5), 1 - (F.col("ref") - F.col("best")) / 60.0), 6)
    return found.groupBy("ref").agg(F.max(F.struct(score.alias("s"), "best")).alias("x")).select("ref", "x.best")


def nearest(rows: DataFrame, query: DataFrame, least: float, limit: int) -> DataFrame:
    """rows (id, vec) by cosine with the one query vector (vec); the best ``limit`` over least."""
    q = F.broadcast(query.select(F.col("vec").alias("q")))
    return rows.crossJoin(q).select("id", F.round(cosine("vec", "q"), 6).alias("cosine")).where(F.col("cosine") >= least).orderBy(F.desc("cosine"), "id").limit(limit)
