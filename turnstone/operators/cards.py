"""Cards of what is known of an actor: admission by kind, evidence that can be revoked, rebuilds of touched actors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.operators import sequences
from turnstone.sources.shared import materialize

#: Sources that an entry cites at most, and entries of one kind that an actor's card has for an audience.
MOST_CITED, PER_KIND = 16, 3

ENTRY = ["actor", "audience", "kind", "body", "confidence", "entry_id"]


def _entry_id():
    return F.substring(F.sha2(F.concat_ws("\u001f", "actor", "audience", "kind", F.lower(F.trim("body"))), 256), 1, 16)


def admitted(proposals: DataFrame, live: DataFrame, kinds: tuple[str, ...], per_kind: int = PER_KIND, most_cited: int = MOST_CITED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, evidence, rejected) of proposals (actor, audience, kind, body, confidence, sources).

    In this order: a kind that is none of kinds is an invalid_kind, a body of white space empty_body, more than most_cited
    sources too_many_sources; one of whose sources none is live (source) unproved. Of equal bodies (but for case) of an
    actor, audience and kind the most confident stays, the others are duplicates; of what is left the per_kind most confident,
    then those with most live sources, then by id; the others are over_limit. entries are ENTRY with n_sources, evidence is
    (entry_id, source), rejected (actor, audience, kind, body, reason). A hot actor's proposals are ranked in runs first.
    """
    p = proposals.withColumn("entry_id", _entry_id()).withColumn("sources", F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    p = p.withColumn("row", F.xxhash64("entry_id", "confidence", "sources", "body"))
    cited = p.select("row", F.explode("sources").alias("source")).distinct().join(live.select("source").distinct(), "source", "left_semi")
    n = cited.groupBy("row").agg(F.count("*").alias("n_sources"))
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "invalid_kind").when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty_body")
        .when(F.size("sources") > most_cited, "too_many_sources").when(F.col("n_sources").isNull(), "unproved")
    )
    judged = materialize(p.join(n, "row", "left").withColumn("reason", reason).drop("sources").dropDuplicates(["row"]), "proposals")
    good = judged.where("reason IS NULL")
    best = good.groupBy("entry_id").agg(F.max_by("row", F.struct("confidence", "n_sources", "row")).alias("row"))
    first = good.join(best, ["entry_id", "row"], "left_semi")
    keyed = first.withColumn("key", F.struct("actor", "audience", "kind"))
    top = sequences.top_per_key(keyed, "key", per_kind, F.desc("confidence"), F.desc("n_sources"), F.col("entry_id"))
    entries = materialize(top.select(*ENTRY, "n_sources", "row"), "entries")
    evidence = entries.select("entry_id", "row").join(cited, "row").select("entry_id", "source")
    duplicates = good.join(best, ["entry_id", "row"], "left_anti").withColumn("reason", F.lit("duplicate"))
    over = first.join(entries.select("entry_id"), "entry_id", "left_anti").withColumn("reason", F.lit("over_limit"))
    out = judged.where("reason IS NOT NULL").unionByName(duplicates).unionByName(over)
    return entries.drop("row"), evidence, out.select("actor", "audience", "kind", "body", "reason")


def rebuilt(entries: DataFrame, evidence: DataFrame, proposals: DataFrame, live: DataFrame, kinds: tuple[str, ...], per_kind: int = PER_KIND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, evidence, touched): cards after new proposals and after sources went.

    Touched are actors with proposals and those of whose evidence a source is no longer live (source). Their stored
    entries stand beside the proposals with the sources they have left, and are admitted with them; an entry that has lost
    all its sources goes. All other cards stay as they are, unread but for their evidence.
    """
    lost = evidence.join(live.select("source").distinct(), "source", "left_anti").select("entry_id").distinct()
    of_lost = entries.join(lost, "entry_id", "left_semi").select("actor")
    touched = materialize(proposals.select("actor").unionByName(of_lost).distinct(), "touched")
    old = entries.join(touched, "actor", "left_semi")
    left = evidence.join(old.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    again = old.join(left, "entry_id").select("actor", "audience", "kind", "body", "confidence", "sources")
    new, proof, _ = admitted(again.unionByName(proposals.select("actor", "audience", "kind", "body", "confidence", "sources")), live, kinds, per_kind, most_cited=1 << 30)
    kept = entries.join(touched, "actor", "left_anti")
    kept_proof = evidence.join(kept.select("entry_id"), "entry_id", "left_semi")
    return kept.unionByName(new), kept_proof.unionByName(proof), touched
