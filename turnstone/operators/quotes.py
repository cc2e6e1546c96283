"""Quote and summary search: what a query finds in texts, how good it is, and which finds cover the query best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import evidence
from turnstone.functions.text import STOPWORDS, value_tokens
from turnstone.operators.blocks import search_each

#: What a source of a find counts, by mode.
SOURCE_WEIGHTS = {
    "lookup": {"fts": 5, "like": 5, "turn_search": 4, "turn_semantic": 4, "tool_output": 4, "description": 3, "semantic": 2},
    "exact_value": {"fts": 6, "like": 6, "turn_search": 5, "turn_semantic": 5, "tool_output": 5, "description": 3, "semantic": 1},
    "coverage": {"fts": 5, "like": 5, "turn_search": 4, "turn_semantic": 3, "tool_output": 4, "description": 3, "semantic": 3},
    "aggregate_total": {"fts": 6, "like": 6, "turn_search": 5, "turn_semantic": 3, "tool_output": 5, "summary_scan": 5, "description": 4, "semantic": 2},
}


def source_weight(match_type: str, mode: str) -> Column:
    table = F.create_map(*(F.lit(x) for item in SOURCE_WEIGHTS[mode].items() for x in item))
    return F.coalesce(F.element_at(table, F.col(match_type)), F.lit(1))


def tokens(query: str) -> list[str]:
    return query.lower().split()


def phrases(query: str, n: int) -> list[str]:
    w = tokens(query)
    return [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]


def terms(query: str) -> list[str]:
    return list(dict.fromkeys(w for w in tokens(query) if len(w) > 1 and w.isalnum() and w not in STOPWORDS))


def matched(text: str, query: str) -> dict[str, Column]:
    """Arrays of the query's terms (whole words), and its word pairs and triples that a text has."""
    low = F.lower(text)
    words = [F.when(evidence.first_at(text, t) > 0, F.lit(t)) for t in terms(query)]
    runs = {k: [F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases(query, k)] for k in (2, 3)}
    compact = lambda parts: F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return {"terms": compact(words), "pairs": compact(runs[2]), "triples": compact(runs[3])}


def base_score(text: str, match_type: str, similarity: str, query: str, mode: str) -> list[Column]:
    """The parts of a find's score in the order in which a mode compares them; mode is a key of SOURCE_WEIGHTS."""
    m = matched(text, query)
    hits = (F.size(m["pairs"]) * 2 + F.size(m["terms"])).cast("double").alias("hits")
    exact = F.contains(F.lower(text), F.lit(query.lower())).cast("double").alias("exact")
    values = F.size(F.array_distinct(value_tokens(text))).cast("double").alias("n_values")
    amounts = F.least(F.size(evidence.quantities(text)), F.lit(4)).cast("double").alias("n_amounts")
    weight = source_weight(match_type, mode).cast("double").alias("weight")
    semantic = F.when(F.col(match_type) == "semantic", F.col(similarity)).otherwise(0.0).alias("semantic")
    if mode == "exact_value":
        return [(values > 0).cast("double").alias("has_values"), values, exact, hits, weight, semantic]
    if mode == "aggregate_total":
        return [(amounts > 0).cast("double").alias("has_amounts"), amounts, exact, hits, weight, values, semantic]
    return [exact, hits, weight, values, semantic]


def rarity(finds: DataFrame, query: str) -> DataFrame:
    """finds (id, text, ...) with the sums of 1 / finds that have it over the matched terms, pairs and triples, and their span.

    The counts are one row of as many numbers as the query has phrases.
    """
    m = matched("text", query)
    rows = finds.select("*", *(c.alias(n) for n, c in m.items()), evidence.term_span("text", terms(query)).alias("span"))
    every = {"terms": terms(query), "pairs": phrases(query, 2), "triples": phrases(query, 3)}
    counts = rows.agg(*(F.count_if(F.array_contains(n, p)).alias(f"{n}{k}") for n, ps in every.items() for k, p in enumerate(ps)))
    rows = rows.crossJoin(F.broadcast(counts))

    def weight(n: str) -> Column:
        parts = (F.when(F.array_contains(n, p), 1.0 / F.col(f"{n}{k}")).otherwise(0.0) for k, p in enumerate(every[n]))
        return sum(parts, F.lit(0.0)).alias(f"{n}_rarity")

    return rows.select(*finds.columns, *every, "span", *(weight(n) for n in every))


def ranked(finds: DataFrame, query: str, mode: str = "lookup", most: int | None = None) -> DataFrame:
    """finds (id, text, match_type, similarity) with place, from 1: rare phrases first, then the mode's score, then id.

    Finds are the bounded lists that searches return, so one window holds them. With ``most`` there may be any number: only
    the first so many are numbered, a top-k over all of them.
    """
    rows = rarity(finds, query).select("*", F.struct(*base_score("text", "match_type", "similarity", query, mode)).alias("base"))
    keys = [F.round(f"{n}_rarity", 9) for n in ("triples", "pairs", "terms")]
    sizes = [F.size(n) for n in ("triples", "pairs", "terms")]
    order = [F.desc(k) for pair in zip(keys, sizes, strict=True) for k in pair]
    order += ["span", F.desc("base"), "id"]
    rows = rows if most is None else rows.orderBy(*order).limit(most)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def covering(places: DataFrame, most: int) -> DataFrame:
    """(id, pick): of ranked finds, one after the other that with the most, rarest phrases that no earlier pick has.

    A find's phrases weigh 1 / number of finds that have them; triples come before pairs before terms, then the place.
    The bounded list is folded in the JVM.
    """
    item = F.struct("place", "id", "triples", "pairs", "terms")
    rows = places.agg(F.array_sort(F.collect_list(item)).alias("items"))
    kinds = ("triples", "pairs", "terms")
    for n in kinds:
        rows = rows.withColumn(f"n_{n}", F.flatten(F.col("items")[n]))

    def new(x: Column, covered: Column, n: str) -> Column:
        left = F.array_except(x[n], covered)
        return F.round(F.aggregate(left, F.lit(0.0), lambda s, p: s + 1.0 / F.size(F.filter(F.col(f"n_{n}"), lambda q: q == p))), 9), F.size(left)

    def step(state: Column, _: Column) -> Column:
        rest = F.filter("items", lambda x: ~F.array_contains(state["picks"], x["id"]))
        keyed = F.transform(rest, lambda x: F.struct(*(v.alias(f"{n}{k}") for n in kinds for k, v in enumerate(new(x, state["covered"], n))), (-x["place"]).alias("p"), x["id"].alias("id"), F.concat(*(x[n] for n in kinds)).alias("has")))
        best = F.array_max(keyed)
        more = F.struct(F.concat(state["picks"], F.array(best["id"])).alias("picks"), F.array_union(state["covered"], best["has"]).alias("covered"))
        return F.when(F.size(rest) > 0, more).otherwise(state)

    start = F.struct(F.array().cast("array<string>").alias("picks"), F.array().cast("array<string>").alias("covered"))
    folded = rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step).alias("s"))
    return folded.select(F.posexplode("s.picks").alias("pick", "id")).select("id", "pick")


def ordered_fill(sources: list[DataFrame], limit: int) -> DataFrame:
    """Finds (id, text, match_type, similarity, score) of several sources, earlier ones first, each id once, limit in all.

    A later source fills what earlier ones leave; each gives at most limit rows, so few rows meet.
    """
    out = None
    for k, rows in enumerate(sources):
        top = rows.orderBy(F.desc("score"), "id").limit(limit).withColumn("source", F.lit(k))
        out = top if out is None else out.unionByName(top)
    first = out.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("source"))).where("r = 1").drop("r")
    return first.orderBy("source", F.desc("score"), "id").limit(limit)


def nearest_each(rows: DataFrame, queries: DataFrame, least: float, limit: int) -> DataFrame:
    """(query, id, cosine): for each of queries (query, q) its nearest rows (id, vec) over least, the best ``limit``."""
    found = search_each(rows.select("id", F.col("id").alias("owner"), "vec"), queries, least, limit)
    return found.select("query", "id", "cosine")
