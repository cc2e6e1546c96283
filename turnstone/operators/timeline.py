"""Finds in windows of time: semantic neighbours merged with lexical scores, and milestones in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions.vectors import cosine
from turnstone.operators.folds import keyed, values

#: Weights of a semantic find and the similarity that it needs.
SIMILARITY_WEIGHT, TERM_WEIGHT, BONUS, LEAST_SIMILARITY = 8.0, 0.5, 0.5, 0.22
#: Weights of milestones: a base, matched terms, tokens of the theme (6 at most count); new tokens; tags of facts.
SEGMENT_SCORE, FACT_SCORE, NEW_TOKEN, FACT_TAG = (2.8, 0.95, 0.35), (3.2, 0.85, 0.4), 0.8, 0.12


def windowed_neighbours(rows: DataFrame, queries: DataFrame, width: int, least: float = LEAST_SIMILARITY, limit: int = 60) -> DataFrame:
    """(query, id, similarity): of the rows (id, at, vec) in each query's window (query, q, start, end) the nearest over least.

    Times are whole numbers, both ends count. Rows and windows meet by slots of ``width``, so a query reads only the slots of
    its window; a slot's best of a query go on, and then the best ``limit`` of all.
    """
    slots = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    asked = queries.where("start <= end").withColumn("slot", F.explode(slots))
    held = rows.select("id", "at", "vec", F.floor(F.col("at") / width).alias("slot"))
    found = held.join(asked, "slot").where("at BETWEEN start AND end").select("query", "slot", "id", F.round(cosine("vec", "q"), 6).alias("similarity"))
    order = (F.desc("similarity"), F.col("id"))
    found = found.where(F.col("similarity") >= least)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query", "slot").orderBy(*order))).where(F.col("r") <= limit)
    return best.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= limit).select("query", "id", "similarity")


def merged_window_scores(lexical: DataFrame, semantic: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, id, score): lexical scores (query, id, score), and what semantic finds (query, id, similarity) add to them.

    A semantic find adds similarity * 8 + terms * 0.5 + 0.5, terms (query, id, n) being the query's words in its text; what
    only one side found has that side's score.
    """
    s = semantic.join(terms, ["query", "id"], "left")
    gain = F.col("similarity") * SIMILARITY_WEIGHT + F.coalesce("n", F.lit(0)) * TERM_WEIGHT + BONUS
    both = lexical.select("query", "id", "score").unionByName(s.select("query", "id", gain.alias("score")))
    return both.groupBy("query", "id").agg(F.round(F.sum("score"), 6).alias("score"))


@lru_cache(1 << 16)
def _worth(segment: bool, matched: int, tokens: int, tags: int) -> float:
    first, term, token = SEGMENT_SCORE if segment else FACT_SCORE
    extra = (0.5 if tags else 0.0) if segment else FACT_TAG * min(10, tags)
    return first + term * matched + token * min(6, tokens) + extra


@lru_cache(1 << 16)
def _rank(base: float, new: int) -> tuple[float, int, float]:
    return -round(base + NEW_TOKEN * new, 6), -new, -round(base, 6)


class _Tale:
    """Milestones of one query's finds, which come by dates; what is held of a date are its best segment and its best fact."""

    __slots__ = ("told", "seen", "date", "best")

    def __init__(self):
        self.told, self.seen, self.date, self.best = [], set(), None, [None, None]

    def add(self, date: str, id: object, source: str, point: str, theme: str, tokens: set[str], matched: int, tags: int) -> None:
        if date != self.date:
            self.close()
            self.date = date
        k = source != "segment"
        if k and source != "fact":
            return
        rank = (*_rank(_worth(not k, matched, len(tokens), tags), len(tokens - self.seen)), id)
        if self.best[k] is None or rank < self.best[k][0]:
            self.best[k] = (rank, id, source, theme, point, tokens)

    def close(self) -> None:
        segment, fact = self.best
        if segment or fact:
            _, id, source, theme, point, tokens = segment or fact
            support = fact[4] if segment and fact else None
            self.told.append((self.date, id, source, theme, point, support if support != point else None))
            self.seen |= tokens
            self.best = [None, None]

    def end(self, most: int) -> list[tuple]:
        self.close()
        n = len(self.told)
        return self.told if n <= most else [self.told[i] for i in sorted({k * (n - 1) // (most - 1) if most > 1 else 0 for k in range(most)})]


def choose_milestones(finds: list[dict], most: int) -> list[dict]:
    """Milestones of one query's finds (source, date, point, theme, tokens, matched, tags), see milestones()."""
    tale = _Tale()
    for f in sorted(finds, key=lambda f: f["date"]):
        tale.add(*(f[c] for c in ("date", "id", "source", "point", "theme", "tokens", "matched", "tags")))
    return [dict(zip(("date", "id", "source", "theme", "point", "support"), x, strict=True)) for x in tale.end(most)]


def milestones(finds: DataFrame, most: int) -> DataFrame:
    """finds (query, id, source, date, point, theme, tokens, matched, tags) -> (query, date, id, source, theme, point, support).

    One milestone for each date of a query's finds, in order: a segment rather than a fact, that with the best score, new
    tokens counting 0.8 each; new is what no milestone before has told. A fact of the same day supports a segment unless it
    says the same. Of more than ``most`` dates evenly spaced ones stay, the first and the last among them. matched counts the
    query's terms in a find, tags its tags; empty points are left out. A query's finds pass through one task by dates, a task's
    queries one after the other.
    """
    kinds = dict(finds.dtypes)
    names = ("query", "date", "id", "source", "theme", "point", "support")
    schema = f"query {kinds['query']}, date string, id {kinds['id']}, source string, theme string, point string, support string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tale, types = None, None, None

        def told(out: list) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, types.get(c, pa.string())) for c, x in zip(names, columns, strict=True)], names)

        for batch in batches:
            types, out = {c: batch.schema.field(c).type for c in ("query", "id")}, []
            columns = ("date", "id", "source", "point", "theme", "tokens", "matched", "tags")
            for query, date, id, source, point, theme, tokens, matched, tags in zip(*(values(batch.column(c)) for c in ("query", *columns)), strict=True):
                if tale is None or query != at:
                    out += ((at, *x) for x in tale.end(most)) if tale else ()
                    at, tale = query, _Tale()
                tale.add(date, id, source, point, theme, set(tokens or ()), matched, tags)
            if out:
                yield told(out)
        if tale:
            yield told([(at, *x) for x in tale.end(most)])

    said = finds.where("trim(point) <> ''").select("query", "id", "source", F.coalesce("date", F.lit("")).alias("date"), "point", "theme", "tokens", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("tags", F.lit(0)).alias("tags"))
    return keyed(said, "query", F.col("date")).mapInArrow(fold, schema)


def window_scores(rows: DataFrame, windows: DataFrame, fields: tuple[str, ...], slot_days: int = 30) -> DataFrame:
    """rows (id, day, fields...) in windows (query, start, end, terms) -> the rows' columns with query, start, end and score.

    terms is array<struct<field, text, weight>> in lower case; a row's score is the sum of the weights of those that its field
    has, 0 if it has none. Days are dates, both ends count. Rows and windows meet by slots of days, so that many windows
    are scored at once and each reads its own days only; null days are in no window, null fields have no term.
    """
    slot = lambda c: F.floor(F.unix_date(c) / slot_days)
    asked = windows.where("start <= end").withColumn("slot", F.explode(F.sequence(slot(F.col("start")), slot(F.col("end")))))
    held = rows.withColumn("slot", slot(F.col("day")))
    both = held.join(asked, "slot").where("day BETWEEN start AND end").drop("slot")

    def weight(t):
        text = F.coalesce(*(F.when(t["field"] == f, F.lower(F.col(f))) for f in fields), F.lit(""))
        return F.when(F.contains(text, t["text"]), t["weight"].cast("double")).otherwise(0.0)

    score = F.aggregate(F.transform("terms", weight), F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("score", F.round(F.coalesce(score, F.lit(0.0)), 6)).drop("terms")
