"""Personal data: patterns of four kinds, and more spans by bootstrapped contexts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, materialize, quoted, read, spread

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances of a kind that a context needs, the share of its instances they must be, an instance's least score.
LEAST_SUPPORT, LEAST_PATTERN, LEAST_INSTANCE = 4.0, 0.8, 0.8
#: The part of an instance's score that its shape has, and the difference in digits at which it says nothing for a kind.
SHAPE_SHARE, DIGITS_OFF = 0.25, 4.0
#: Code points of a candidate identifier (an address has 254 at most), and those before and after it that are its context.
LONGEST, BEFORE, AFTER = 254, 80, 40
#: Runs that the occurrences and edges of one pattern or instance are dealt to where they meet its score.
RUNS = 64


@dataclass(frozen=True)
class Reach:
    """Code points of the longest candidate, and of the text before and after an occurrence that its context is taken from."""

    longest: int = LONGEST
    before: int = BEFORE
    after: int = AFTER


REACH = Reach()

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the plain pattern begins where a run of digits does; the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9+])\+?\(?[0-9][\x20().0-9-]{5,28}[0-9](?![0-9])")
_MARK = re.compile(r"[0-9@]")
_SPACE = " \t\n\r\x0b\x0c"
_TRIM = "\"'`.,;:!?()[]{}<>|*"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ whose local part, the run of characters before it, and domain are there; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind is an index of KINDS."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 or not p[:-3].strip("0") for p in m.groups()) and all(int(p[-3:]) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _union(taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans, whatever their kinds, as disjoint intervals in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(taken):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]], reach: Reach = REACH) -> list[tuple[int, int]]:
    """Strings that may be identifiers: groups of digits, and words with a digit or @; none overlaps taken."""
    out, busy = [], _union(taken)
    k = end = 0
    for m in sorted([*_NUMBER.finditer(text), *_words(text, reach.longest)], key=lambda m: m.span() if hasattr(m, "span") else m):
        a, b = m.span() if hasattr(m, "span") else m
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        if a >= end and b - a >= 6 and not (k < len(busy) and busy[k][0] < b):
            out.append((a, b))
            end = b
    return out


def _words(text: str, longest: int) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a = b = m.start()
        while a > end and m.start() - a <= longest and text[a - 1] not in _SPACE:
            a -= 1
        while b < len(text) and b - m.start() <= longest and text[b] not in _SPACE:
            b += 1
        end = b
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if 6 <= b - a <= longest:
            yield a, b


def context(text: str, start: int, end: int, reach: Reach = REACH) -> tuple[str, str]:
    """The last two words of the text within reach before and the first behind; lower case, digits as 0."""
    left = text[max(0, start - reach.before) : start].lower().split()[-2:]
    right = text[end : end + reach.after].lower().split()[:1]
    return _DIGIT.sub("0", " ".join(left)), _DIGIT.sub("0", " ".join(right)).strip(_TRIM)


SPAN = "struct<start:long,kind:int,end:long>"
OCCURRENCE = "struct<start:long,kind:int,end:long,instance:string,left:string,right:string>"


def _find(reach: Reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen, keys = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = base_spans(text)
                keys.append(xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63))
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                found = []
                if spans or "@" in text or _DIGIT.search(text):
                    for a, k, b in spans + [(a, None, b) for a, b in candidates(text, spans, reach)]:
                        left, right = context(text, a, b, reach)
                        value = text[a:b].lower()
                        found.append({"start": a, "kind": k, "end": b, "instance": value, "left": left, "right": right})
                seen.append(found)
            span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
            more = [(x, pa.string()) for x in ("instance", "left", "right")]
            yield pa.record_batch(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(base, pa.list_(pa.struct(span))), pa.array(seen, pa.list_(pa.struct(span + more)))],
                ["id", "key", "base", "seen"],
            )

    return run


def _shape(instance: str):
    """(family, digits): what characters an instance has, and how many digits (those of an address don't count)."""
    c = F.col(instance)
    family = F.when(F.contains(c, F.lit("@")), "address").when(c.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "dots").when(c.rlike(r"^[\x20()+./0-9-]+$"), "number").otherwise("other")
    digits = F.when(family == "address", 0).otherwise(F.length(F.regexp_replace(c, "[^0-9]", "")))
    return family.alias("family"), digits.alias("digits")


def _fits(shapes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(family, digits, kind, fit): the mean nearness in digits of a kind's seeds, 0 for seeds of another family.

    There are four families and at most as many numbers of digits as a candidate has code points, so all tables here are small.
    """
    per = seeds.groupBy("kind", "family", "digits").agg(F.count("*").alias("n"))
    total = per.groupBy("kind").agg(F.sum("n").alias("total"))
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("digits") - F.col("d")) / DIGITS_OFF)
    pairs = shapes.select("family", F.col("digits").alias("d")).distinct().join(per, "family")
    return pairs.groupBy("family", F.col("d").alias("digits"), "kind").agg(F.sum(near * F.col("n")).alias("x")).join(total, "kind").select("family", "digits", "kind", (F.col("x") / F.col("total")).alias("fit")).where("fit > 0")


def _dealt(rows: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """rows (run, key, ...) with the scores of their keys. Scores go to the runs that have the key, so no task has all rows of a hot one."""
    there = rows.select("run", key).distinct()
    return rows.join(there.join(scores, key), ["run", key])


def bootstrap(seen: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """seen (id, key, start, kind, end, instance, left, right), kind null for candidates -> (id, key, start, kind, end).

    Two lexical patterns of words alone stand for each occurrence: the two words before it, and the word before with
    the word after. Pattern and instances are a bipartite graph of distinct edges. A pattern's confidence in a kind is
    the summed confidence of its instances over their number. An instance's is one less the product of its patterns'
    doubts; its score adds, by SHAPE_SHARE, how near its shape is to those of the kind's seeds, and it is 0 without a
    seed anywhere near, so a context finds identifiers of other shapes than the seeds', but not of any. Seeds stay at
    1 for their kind. Rounds go on until the patterns are those of an earlier round (where they would go round in a circle,
    the first that comes again is taken); more than most_rounds, if given, are an error. Then the candidates at patterns and with instances over
    the thresholds are found. All scores are Spark aggregates over the whole corpus. No seeds or candidates: no rows.
    """
    full = F.col("left").rlike(r"\S+ \S+")
    patterns = F.array_compact(
        F.array(
            F.when(full, F.concat_ws("\u0001", F.lit("l"), "left")),
            F.when(full & (F.col("right") != ""), F.concat_ws("\u0001", F.lit("b"), F.regexp_extract("left", r"(\S+)$", 1), "right")),
        )
    )
    rows = seen.withColumn("pattern", F.explode(patterns)).withColumn("p", F.xxhash64("pattern")).withColumn("i", F.xxhash64("instance"))
    rows = materialize(rows.select("id", "key", "start", "end", "kind", "p", "i", *_shape("instance"), spread("key", RUNS).alias("run")), "occurrences")
    edges = rows.select("p", "i").distinct()
    by_instance = materialize(edges.select("p", "i", spread("p", RUNS).alias("run")), "edges")
    by_pattern = materialize(by_instance.select("p", "i", spread("i", RUNS).alias("run")), "edges")
    seeds = materialize(rows.where("kind IS NOT NULL").select("i", "kind", "family", "digits").distinct(), "seeds")
    first = seeds.select("i", "kind", F.lit(1.0).alias("c"))
    shapes = rows.where("kind IS NULL").select("i", "family", "digits").distinct()
    fits = materialize(_fits(shapes, seeds), "fits")
    fitting = materialize(shapes.join(F.broadcast(fits), ["family", "digits"]).join(seeds.select("i"), "i", "left_anti").select("i", "kind", "fit"), "shapes")
    sizes = by_pattern.groupBy("p").agg(F.count("*").alias("n"))
    known, scored, states, rounds = first, None, set(), 0
    while True:
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError("bootstrap: more rounds than allowed")
        support = _dealt(by_instance, known, "i").groupBy("p", "kind").agg(F.sum("c").alias("support"))
        scored = support.where(F.col("support") >= LEAST_SUPPORT).join(sizes, "p").select("p", "kind", (F.col("support") / F.col("n")).alias("c"))
        scored = materialize(scored.where(F.col("c") >= LEAST_PATTERN), "patterns")
        state = tuple(scored.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("p", "kind", F.round("c", 6)), F.lit(1 << 40)))).first())
        if not state[0] or state in states:
            break
        states.add(state)
        doubt = F.sum(F.log(1 - F.least(F.col("c"), F.lit(0.99))))
        guessed = _dealt(by_pattern, scored, "p").groupBy("i", "kind").agg((1 - F.exp(doubt)).alias("c")).join(fitting, ["i", "kind"])
        guessed = guessed.select("i", "kind", (F.col("c") * (1 - SHAPE_SHARE) + F.col("fit") * SHAPE_SHARE).alias("c")).where(F.col("c") >= LEAST_INSTANCE)
        guessed = guessed.groupBy("i").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"))).alias("x")).select("i", (-F.col("x.k")).alias("kind"), F.col("x.c").alias("c"))
        known = materialize(first.unionByName(guessed), "known")
    good = known.join(seeds.select("i").distinct(), "i", "left_anti")
    found = _dealt(rows.where("kind IS NULL").drop("kind"), scored.select("p", "kind"), "p")
    found = _dealt(found, good.select("i", F.col("kind").alias("own")), "i").where("kind = own")
    return found.select("id", "key", "start", "kind", "end").distinct()


def _listing(spans: str):
    named = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(named, ",")


def _scan(docs: DataFrame, id_col: str, text_col: str, reach: Reach) -> tuple[DataFrame, DataFrame]:
    kind = dict(docs.dtypes)[id_col]
    found = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _find(reach), f"id {kind}, key long, base array<{SPAN}>, seen array<{OCCURRENCE}>"
        ),
        "pii",
    )
    more = bootstrap(found.select("id", "key", F.explode("seen").alias("s")).select("id", "key", "s.*"))
    more = more.groupBy("id", "key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    return found, materialize(more, "discovered")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: Reach = REACH) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered) for every row.

    The counts and the hash are of the base patterns' spans, spans also lists what the contexts add; offsets are code
    points of the whole text, end exclusive. Null is empty: no spans, the hash of an empty list. Rows that repeat an
    identifier and a text get the same spans; other columns are not read. An empty table gives an empty result.
    """
    found, more = _scan(docs, id_col, text_col, reach)
    rows = found.join(more, found["id"].eqNullSafe(more["id"]) & (found["key"] == more["key"]), "left").select(
        found["id"], "base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")).alias("more")
    )
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(
        F.col("id").alias(id_col), *counts, F.sha2(_listing("base"), 256).alias("base_sha256"),
        _listing(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_discovered"),
    )


def redact(text: str | None, more: list[tuple[int, int, int]]) -> str | None:
    """The text with <KIND> for each span; of overlapping spans the union is replaced once, by the first kind."""
    if not text:
        return text
    out, end = [], 0
    for a, k, b in sorted(base_spans(text) + more):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = 500_000, reach: Reach = REACH) -> DataFrame:
    """docs with every span of find_pii() replaced in the text; all rows and columns stay, whatever their names.

    Null texts stay null, empty ones empty; rows that repeat an identifier and a text are changed alike. The texts with
    discovered spans are few or none; up to ``few`` spans (counted first) are broadcast, more are joined by a shuffle.
    An empty table stays empty.
    """
    _, more = _scan(docs, id_col, text_col, reach)
    n = more.agg(F.coalesce(F.sum(F.size("more")), F.lit(0))).first()[0]

    def apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(
            [redact(t.as_py(), [(s["start"], s["kind"], s["end"]) for s in x.as_py() or []]) for t, x in zip(texts, spans, strict=True)],
            pa.string(),
        )

    apply.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    apply = F.arrow_udf(apply, "string")
    none = F.lit(None).cast(f"array<{SPAN}>")
    if not n:
        return docs.withColumn(text_col, apply(F.col(text_col), none))

    def key(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_intdigest((t.as_py() or "").encode()) - (1 << 63) for t in texts], pa.int64())

    key.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    digest, mine, other, added = hidden(docs, "digest", "mine", "other", "added")
    keyed = docs.withColumn(digest, F.arrow_udf(key, "long")(text_col))
    spans = more.select(F.col("id").alias(mine), F.col("key").alias(other), F.col("more").alias(added))
    spans = F.broadcast(spans) if n <= few else spans
    joined = keyed.join(spans, F.col(id_col).eqNullSafe(F.col(mine)) & (F.col(digest) == F.col(other)), "left")
    return joined.withColumn(text_col, apply(F.col(text_col), F.col(added))).select(*quoted(*docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
