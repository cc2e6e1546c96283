"""Toxicity scores: a weighted lexicon matched by Aho-Corasick after folding, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Labelled rows that the lexicon and the calibration are learned from, at most: those with the smallest id hashes.
SAMPLE_ROWS = 10_000
PREFIXES = range(4, 9)
#: Terms that would pass by chance among all that are tried, about, and the least log odds of a term.
CHANCE, LEAST_WEIGHT = 0.05, 1.0
#: Occurrences that count in a text, at most; texts that repeat a term say more than those with it once.
REPEATS = 3
#: Plain insults, used without labels and beside learned terms.
SEED_LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.0, "scum": 3.0, "worthless": 2.0, "pathetic": 2.0, "disgusting": 1.5}
#: Everyday phrases with such words. A match inside one of these, or inside a learned phrase, does not count.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "class clown", "clown fish", "pond scum", "soap scum", "idiot proof")

_LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмтвαορεικντυχıɡʟ", "aeopcyxijshdqwkmtbaopeikvtuxigl", strict=True))
_DIGITS = str.maketrans("013457@$!|", "oieastasii")
_DROPPED = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD}
_RUN = re.compile(r"[0-9@$!|]+")


def _run(m: re.Match) -> str:
    """A run of digits and signs as letters: before a letter, or digits alone that end a word of letters."""
    run, text, end = m[0], m.string, m.end()
    if end < len(text) and text[end].isalpha():
        return run.translate(_DIGITS)
    ends = m.start() and text[m.start() - 1].isalpha() and not run.strip("013457")
    return run.translate(_DIGITS) if ends and not (end < len(text) and text[end].isalnum()) else run


class _Fold(dict):
    """What str.translate() makes of each character, worked out when it is first seen."""

    def __missing__(self, code: int):
        c = chr(code)
        if code in _DROPPED or unicodedata.combining(c):
            to = None
        elif c in _LOOKALIKES:
            to = _LOOKALIKES[c]
        else:
            plain = unicodedata.normalize("NFKC", c).lower() if code > 0x2000 else c
            to = plain if plain.isalpha() else " "
        self[code] = to
        return to


_FOLD = _Fold()


def fold(text: str) -> str:
    """Lower case, look-alikes and digits inside a word or at its end as letters, zero-width marks gone, all else a blank.

    Linear in the text, also where it is one run of digits.
    """
    low = unicodedata.normalize("NFC", text).lower()
    return _RUN.sub(_run, low).translate(_FOLD)


def terms(words: Iterable[str]) -> Counter:
    """Counts of the words ("x ") and of their prefixes ("x")."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        if len(w) > 2:
            out[w + " "] += n
        for k in PREFIXES:
            if len(w) < k:
                break
            out[w[:k]] += n
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """lexicon: term (a trailing blank: a whole word, else a word's beginning) to weight."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    #: Of 1, log(1 + weight), log(1 + weight per 100 words), log(1 + words).
    coefficients: tuple[float, float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.lexicon.items():
            a.add_word(f" {t}", (len(t) + 1, w))
        for phrase in self.exceptions:
            a.add_word(f" {' '.join(fold(phrase).split())} ", (len(phrase) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def match_weight(folded: str, automaton: ahocorasick.Automaton) -> float:
    if not len(automaton):
        return 0.0
    total, starts, ends, found = 0.0, [], [], []
    for end, (size, w) in automaton.iter(folded):
        if w is not None:
            found.append((end - size, end, w))
            continue
        while starts and starts[-1] >= end - size:  # matches come by their ends: one that lies in this one says no more
            starts.pop()
            ends.pop()
        starts.append(end - size)
        ends.append(end)
    for a, b, w in found:  # starts and ends ascend: the last phrase that starts at a or before ends last
        k = bisect_right(starts, a)
        if not k or ends[k - 1] < b:
            total += w
    return total


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, float, float]:
    folded = f" {fold(text or '')} "
    words, weight = len(folded.split()), match_weight(folded, automaton)
    return 1.0, math.log1p(weight), math.log1p(100 * weight / (words + 20)), math.log1p(words)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str | Column) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _count_terms(only: frozenset[str] | None):
    """Of rows (toxic, text): (term, docs, hits) for each task; hits are up to REPEATS of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: Counter = Counter()
        hits: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = terms(fold(text or "").split())
                for t in found if only is None else found.keys() & only:
                    docs[t] += 1
                    hits[t] += min(found[t], REPEATS)
        names = list(docs)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([docs[t] for t in names], pa.int64()), pa.array([hits[t] for t in names], pa.int64())], ["term", "docs", "hits"])

    return run


def g2(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of a of n against b of m."""
    p = (a + b) / (n + m)

    def part(k: int, of: int, rate: float) -> float:
        return (k * math.log(k / (of * rate)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - rate))) if of - k else 0.0)

    return 2 * (part(a, n, p) + part(b, m, p)) if 0 < p < 1 else 0.0


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """counts: term to its hits among the toxic and the clean; toxic, clean: hits there could be.

    A term passes by its likelihood ratio (G squared), the higher the more terms are tried. Of terms that begin each
    other one stays.
    """
    scored, least = [], 2 * math.log(max(1, len(counts)) / CHANCE)
    for t, (a, b) in counts.items():
        w = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        strength = g2(a, toxic, b, clean)
        if w >= LEAST_WEIGHT and strength >= least:
            scored.append((-round(strength, 6), not t.endswith(" "), -len(t), t, w))
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # all beginnings of chosen terms
    for _, _, _, t, w in sorted(scored):
        stem = t.rstrip()
        if stem in taken or any(stem[:k] in chosen or stem[:k] + " " in chosen for k in range(1, len(stem) + 1)):
            continue
        chosen[t] = w
        taken.update(stem[:k] for k in range(1, len(stem) + 1))
    return chosen


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    exceptions: tuple[str, ...] = EXCEPTIONS, sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Learns the lexicon and its calibration from at most sample_rows labelled rows outside the held-out fifth.

    Terms are words and word beginnings whose hits among toxic texts exceed those among the others by likelihood ratio;
    all of the sample's that pass are taken, and the weight is the log odds. What comes to the driver is counts of the
    bounded sample. Rows that repeat an identifier count with its highest label; null labels and rows without a text's
    words are left out or score as empty. Without labels of both kinds, an empty table included, the seed lexicon is used.
    """
    train = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(id_col, F.col(label_col).cast("int").alias("y"))
    train = train.groupBy(id_col).agg(F.max("y").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    sample = materialize(docs.select(id_col, F.col(text_col).alias("t")).join(F.broadcast(train), id_col).select("y", "t"), "train")
    schema = "term string, docs long, hits long"
    both = F.sum("docs").alias("docs"), F.sum("hits").alias("hits")
    counted = sample.where("y = 1").mapInArrow(_count_terms(None), schema).groupBy("term").agg(*both)
    top = counted.where("docs >= 3").collect()
    total = {r.y: r.n * REPEATS for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = dict()
    if total.get(0) and total.get(1):
        wanted = frozenset(r.term for r in top)
        clean = sample.where("y = 0").mapInArrow(_count_terms(wanted), schema).groupBy("term").agg(*both)
        seen = {r.term: r.hits for r in clean.collect()}
        lexicon = choose_terms({r.term: (r.hits, seen.get(r.term, 0)) for r in top}, total[1], total[0])
    for w, weight in SEED_LEXICON.items():
        if not any(w.startswith(t.rstrip()) for t in lexicon):
            lexicon[w + " "] = weight
    model = ToxicityModel(lexicon, exceptions, (-4.0, 2.0, 2.0, 0.0))
    if not (total.get(0) and total.get(1)):
        return model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for batch in batches:
            x = np.array([features(t, a) for t in batch.column(1).to_pylist()]).reshape(-1, 4)
            yield pa.record_batch([batch.column(0), *(pa.array(x[:, k]) for k in range(1, 4))], ["y", "a", "b", "c"])

    points = np.array(sample.mapInArrow(rows, "y int, a double, b double, c double").collect(), dtype=float)
    points = points[np.lexsort(points.T)]
    w = _logistic(np.c_[np.ones(len(points)), points[:, 1:]], points[:, 0])
    return ToxicityModel(lexicon, exceptions, tuple(map(float, w)))


def toxicity_score(model: ToxicityModel):
    """A column function of text: the probability of label 1. Null is scored as empty."""

    def score(texts: pa.Array) -> pa.Array:
        global _AUTOMATON
        if _AUTOMATON is None or _AUTOMATON[0] != model:
            _AUTOMATON = (model, model.automaton())
        a, w, out = _AUTOMATON[1], model.coefficients, []
        for text in texts:
            z = sum(p * q for p, q in zip(w, features(text.as_py(), a), strict=True))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return pa.array(out, pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")


_AUTOMATON: tuple | None = None


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs; the whole text is scored.

    Null and empty texts get the score of a text without words. Repeated rows are scored each; other columns are not
    read. held_out is null for a null identifier. An empty table gives an empty result.
    """
    return docs.select(id_col, held_out(id_col).alias("held_out"), toxicity_score(model)(text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs without those scored 0.5 or more; all columns stay, null and empty texts are scored as empty, repeats alike."""
    return docs.where(toxicity_score(model)(text_col) < 0.5)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")))
