"""Ranking: IDF, BM25, reciprocal rank fusion and the adjustments around it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.text import normalize_answer
from turnstone.functions.vectors import cosine
from turnstone.sources.shared import materialize

#: Rank constant and weights of the fused signals; a missing rank counts as twice the constant.
RRF_K = 60
WEIGHTS = {"idf": 0.5, "bm25": 0.3, "embedding": 0.2}


def idf(segments: DataFrame) -> DataFrame:
    """(tag, usage, idf): ln(1 + all usages / usage)."""
    used = segments.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("usage"))
    return used.crossJoin(F.broadcast(used.agg(F.sum("usage").alias("total")))).select("tag", "usage", F.log(1 + F.col("total") / F.col("usage")).alias("idf"))


def idf_candidates(segments: DataFrame, tags: list[str], related: list[str]) -> DataFrame:
    """(tag, score): by primary tag, the best segment's summed IDF of its query tags and half of its related ones."""
    weights = F.broadcast(idf(segments).where(F.col("tag").isin(tags + related)).select("tag", "idf"))
    rows = segments.select("ref", "primary_tag", F.explode(F.array_distinct("tags")).alias("tag")).join(weights, "tag")
    share = F.when(F.col("tag").isin(tags), F.col("idf")).otherwise(0.5 * F.col("idf"))
    scored = rows.groupBy("ref", "primary_tag").agg(F.sum(share).alias("s"))
    return scored.groupBy(F.col("primary_tag").alias("tag")).agg(F.max("s").alias("score"))


def bm25(docs: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs (id, text) -> (id, score). Texts are read once: their lengths and hits are written, statistics come from those."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]{2,})"))
    base = docs.select("id", words.alias("w")).select("id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(query)).alias("hits"))
    base = materialize(base, "bm25")
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = base.select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("score"))


def embedding_candidates(tags: DataFrame, query: DataFrame, least: float = 0.25, limit: int = 20) -> DataFrame:
    """tags (tag, vec) by cosine with the query's vector (vec): (tag, score)."""
    q = F.broadcast(query.select(F.col("vec").alias("q")))
    return tags.crossJoin(q).select("tag", cosine("vec", "q").alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "tag").limit(limit)


def ranked(scores: DataFrame) -> DataFrame:
    """(tag, rank) from 0 by score; candidates are bounded, so one window holds them."""
    return scores.select("tag", (F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "tag")) - 1).alias("rank"))


def rrf(signals: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """(tag, score): weighted reciprocal ranks of all signals (tag, rank); a tag without a rank has rank 2k."""
    rows = None
    for name, df in signals.items():
        part = df.select("tag", F.lit(name).alias("signal"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy("tag").agg(*(F.max(F.when(F.col("signal") == n, F.col("rank"))).alias(n) for n in signals))
    total = sum((F.lit(weights[n]) / (k + F.coalesce(F.col(n), F.lit(2 * k)) + 1) for n in signals), F.lit(0.0))
    return wide.select("tag", total.alias("score"))


def gravity(embedding: DataFrame, lexical: DataFrame) -> DataFrame:
    """Halves an embedding score over .5 of a tag that no word matched."""
    return embedding.join(lexical.select("tag").withColumn("hit", F.lit(True)), "tag", "left").select(
        "tag", F.when((F.col("score") > 0.5) & F.col("hit").isNull(), F.col("score") * 0.5).otherwise(F.col("score")).alias("score")
    )


def hub_dampening(scores: DataFrame, usage: DataFrame, query: list[str]) -> DataFrame:
    """Lowers tags used more than the 90th percentile (the value at floor(.9 n)) that the query doesn't name."""
    # by the distinct usages, of which there are few: the first that more than .9 n tags have at most
    per = usage.groupBy("usage").agg(F.count("*").alias("tags"))
    upto = per.select("usage", F.sum("tags").over(Window.orderBy("usage")).alias("upto")).crossJoin(F.broadcast(per.agg(F.sum("tags").alias("n"))))
    stats = upto.agg(F.min(F.when(F.col("upto") > F.floor(0.9 * F.col("n")), F.col("usage"))).alias("p90"), F.max("usage").alias("top"))
    over = F.greatest(F.lit(0.2), 1 - 0.6 * (F.col("usage") - F.col("p90")) / F.greatest(F.col("top") - F.col("p90"), F.lit(1)))
    hub = (F.col("usage") > F.col("p90")) & ~F.col("tag").isin(query)
    return scores.join(usage.select("tag", "usage"), "tag", "left").crossJoin(F.broadcast(stats)).select("tag", F.when(hub, F.col("score") * over).otherwise(F.col("score")).alias("score"))


def boost(scores: DataFrame, tags: DataFrame, factor: float = 1.15) -> DataFrame:
    return scores.join(tags.select("tag").distinct().withColumn("hit", F.lit(True)), "tag", "left").select(
        "tag", F.when(F.col("hit"), F.col("score") * factor).otherwise(F.col("score")).alias("score")
    )


def tokens_f1(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs (id, a, b) -> (id, f1) of the words of normalised answers, as multisets; no row for pairs without words."""
    def bag(c: str, name: str) -> DataFrame:
        words = F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
        return pairs.select("id", F.explode(words).alias("w")).groupBy("id", "w").agg(F.count("*").alias(name))

    both = bag(a, "na").join(bag(b, "nb"), ["id", "w"], "full").groupBy("id").agg(
        F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("common"), F.sum("na").alias("na"), F.sum("nb").alias("nb")
    )
    f1 = 2.0 * F.col("common") / (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)))
    return both.select("id", F.round(f1, 6).alias("f1"))


def kendall_tau_b(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, tau) of two rankings, from counts of pairs of values: no pairs of rows.

    Rows are counted by (x, y); sums over the grid of a key's values give the pairs that agree. The grid has as many
    cells as distinct x times distinct y, whatever the number of rows. No row for a key where either is constant.
    """
    cells = rows.groupBy(key, x, y).agg(F.count("*").alias("n"))
    grid = cells.select(key, x).distinct().join(cells.select(key, y).distinct(), key).join(cells, [key, x, y], "left").fillna(0, ["n"])
    column = grid.withColumn("c", F.coalesce(F.sum("n").over(Window.partitionBy(key, x).orderBy(y).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = column.withColumn("below", F.coalesce(F.sum("c").over(Window.partitionBy(key, y).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    agree = below.groupBy(key).agg(F.sum(F.col("n") * F.col("below")).alias("con"), F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("txy"))
    ties = lambda c, name: cells.groupBy(key, c).agg(F.sum("n").alias("k")).groupBy(key).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(name))
    j = agree.join(ties(x, "tx"), key).join(ties(y, "ty"), key).withColumn("pairs", F.col("all") * (F.col("all") - 1) / 2)
    dis = F.col("pairs") - F.col("con") - F.col("tx") - F.col("ty") + F.col("txy")
    under = (F.col("pairs") - F.col("tx")) * (F.col("pairs") - F.col("ty"))
    return j.where(under > 0).select(key, F.round((F.col("con") - dis) / F.sqrt(under), 6).alias("tau"))


def prefixed_ratio(response: str, answer: str, prefix: str) -> float:
    """0 where the response lacks the prefix; else twice the characters in matching blocks over all, the prefix left out."""
    if response is None or answer is None or not response.startswith(prefix or ""):
        return 0.0
    return SequenceMatcher(None, response.removeprefix(prefix or ""), answer.removeprefix(prefix or "")).ratio()


def sequence_ratio(response: str, answer: Column, prefix: str) -> Column:
    """prefixed_ratio() of three text columns; matching blocks have no form in Spark's functions. Nulls give 0."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([prefixed_ratio(x, y, z) for x, y, z in zip(a, b, p, strict=True)], dtype="float64")

    return F.round(ratio(response, answer, prefix), 6)
