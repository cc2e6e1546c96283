"""Assembly of a context: parts of many kinds under reserves and caps, what is left over going on to the next part."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which they are shown.
KINDS = ("core", "hint", "card", "roster", "tag", "fact", "message")


@dataclass(frozen=True)
class Limits:
    """Tokens: of the whole, of the core text, of what is injected beside it (card, roster, tags, facts), and of each of these."""

    whole: int
    core: int
    pool: int
    card: int
    roster: int
    tags: int
    facts: int


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def assemble(parts: Iterable[dict], limits: Limits) -> list[dict]:
    """The parts (kind, id, k, score, text) that a context shows, with tokens, in the order of KINDS.

    The core text is cut to its limit, the hint is whole. Card entries, then roster lines take from the pool in order k, each
    within its own limit; what does not fit is passed over. Tags and facts share what the pool has left, by score: each
    that fits its cap and the pool is taken. Facts with kind dense follow by k, as far as facts and pool go, if they are not
    there yet. Messages get all that the whole has left, from the newest (largest k) back, without a gap. If what stands
    before the messages is more than the whole, tags go from the least score up, then roster lines and card entries from
    the end, then facts.
    """
    by: dict[str, list[dict]] = {k: [] for k in (*KINDS, "dense")}
    for p in parts:
        by[p["kind"]].append({**p, "tokens": tokens(p["text"])})
    for k in ("core", "hint", "card", "roster", "dense"):
        by[k].sort(key=lambda p: (p["k"], p["id"]))
    shown: dict[str, list[dict]] = {k: [] for k in KINDS}

    def used(*kinds: str) -> int:
        return sum(p["tokens"] for k in kinds for p in shown[k])

    for p in by["core"]:
        text = p["text"][: 4 * max(0, limits.core - used("core"))]
        if text:
            shown["core"].append({**p, "text": text, "tokens": tokens(text)})
    shown["hint"] = [p for p in by["hint"] if p["text"]]
    base = min(limits.pool, max(0, limits.whole - used("core", "hint")))
    for kind, cap in (("card", limits.card), ("roster", limits.roster)):
        for p in by[kind]:
            if used(kind) + p["tokens"] <= cap and used("card", "roster") + p["tokens"] <= base:
                shown[kind].append(p)
    pool = base - used("card", "roster")
    caps = {"tag": limits.tags, "fact": limits.facts}
    for p in sorted(by["tag"] + by["fact"], key=lambda p: (-p["score"], p["kind"], p["id"])):
        if used(p["kind"]) + p["tokens"] <= caps[p["kind"]] and used("tag", "fact") + p["tokens"] <= pool:
            shown[p["kind"]].append(p)
    have = {p["id"] for p in shown["fact"]}
    for p in by["dense"]:
        if p["id"] not in have and used("fact") + p["tokens"] <= limits.facts and used("tag", "fact") + p["tokens"] <= pool:
            shown["fact"].append({**p, "kind": "fact"})
            have.add(p["id"])
    for kind in ("tag", "roster", "card", "fact"):
        while shown[kind] and used(*KINDS[:-1]) > limits.whole:
            shown[kind].pop()
    left = limits.whole - used(*KINDS[:-1])
    for p in sorted(by["message"], key=lambda p: (-p["k"], p["id"])):
        if p["tokens"] > left:
            break
        left -= p["tokens"]
        shown["message"].insert(0, p)
    return [p for k in KINDS for p in shown[k]]


def assembled_context(parts: DataFrame, limits: Limits) -> DataFrame:
    """parts (request, kind, id, k, score, text) -> (request, place, kind, id, tokens, text) of what each context shows.

    See assemble(); place counts from 0. Parts are what searches brought for one request, so a request's are folded by one
    task. Null texts are empty and cost nothing; parts of unknown kinds are left out.
    """
    kinds = dict(parts.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = assemble(pdf.to_dict("records"), limits)
        return pd.DataFrame([(pdf["request"].iloc[0], n, p["kind"], p["id"], p["tokens"], p["text"]) for n, p in enumerate(out)], columns=["request", "place", "kind", "id", "tokens", "text"])

    known = parts.where(F.col("kind").isin(*KINDS, "dense"))
    slim = known.select("request", "kind", "id", F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.groupBy("request").applyInPandas(fold, f"request {kinds['request']}, place int, kind string, id {kinds['id']}, tokens long, text string")


def rendered(context: DataFrame) -> DataFrame:
    """(request, text): an assembled context as one text; each kind's parts follow a line with its name, messages stand last."""
    first = F.col("first") == F.col("place")
    opened = context.join(context.groupBy("request", "kind").agg(F.min("place").alias("first")), ["request", "kind"])
    line = F.when(first, F.concat(F.lit("## "), "kind", F.lit("\n"), "text")).otherwise(F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))["line"]
    return opened.groupBy("request").agg(F.array_join(listed, "\n").alias("text"))
