"""What a text offers as evidence: terms, phrases, quantities, references, dates and cues, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name nothing by themselves in a question about the past.
GENERIC = ("the", "and", "for", "with", "that", "this", "was", "are", "did", "what", "when", "about", "tell", "should", "would", "thing", "things")
#: Words for scales, by factor, and units by their spellings.
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
#: Days that a relative phrase goes back; months are negative multiples of a hundred thousand.
RELATIVE_DAYS = {"today": 0, "yesterday": -1, "tomorrow": 1, "last week": -7, "next week": 7}
RELATIVE_MONTHS = {"last month": -1, "next month": 1, "last year": -12, "next year": 12}
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: Hours that a zone's clock is ahead of UTC.
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2}

CUES = (
    ("question", r"\?"),
    ("conditional", r"(^|[^a-z])(if|unless|provided that)([^a-z]|$)"),
    ("hypothetical", r"(^|[^a-z])(imagine|suppose|what if|hypothetically)([^a-z]|$)"),
    ("recommendation", r"(^|[^a-z])(should|recommend|ought to|had better)([^a-z]|$)"),
    ("uncertain", r"(^|[^a-z])(maybe|perhaps|might|i think|not sure|probably)([^a-z]|$)"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_at(c: Column | str, term: str) -> Column:
    """Place of the first whole-word match, from 1; 0 if there is none."""
    return F.regexp_instr(F.lower(_col(c)), F.lit(rf"(?<![a-z0-9]){term}(?![a-z0-9])"))


def term_span(c: Column | str, terms: list[str], none: int = 1_000_000) -> Column:
    """Distance of the outermost first matches of the terms; none where fewer than two are there."""
    at = F.filter(F.array(*(first_at(c, t) for t in terms)), lambda x: x > 0)
    return F.when(F.size(at) < 2, none).otherwise(F.array_max(at) - F.array_min(at)).cast("long")


def priority_terms(c: Column | str) -> Column:
    """Distinct words of four characters and more that are not generic, and short acronyms, in order, in lower case."""
    words = F.regexp_extract_all(_col(c), F.lit("([A-Za-z0-9_]+)"))
    keep = F.filter(words, lambda w: ((F.char_length(w) >= 4) & ~F.lower(w).isin(*GENERIC)) | w.rlike("^[A-Z]{2,3}$"))
    return F.array_distinct(F.transform(keep, F.lower))


def percents(c: Column | str, most: int = 4) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"([0-9]+(?:\.[0-9]+)?%)"))), 1, most)


def versions(c: Column | str, most: int = 4) -> Column:
    """Distinct versions of two or more dots without their v."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?:^|[^0-9a-zA-Z.])v?([0-9]+(?:\.[0-9]+){2,})"), 1)
    return F.slice(F.array_distinct(found), 1, most)


def coverage_components(c: Column | str) -> Column:
    """What a text lists after "across", "between" or "among", up to the sentence's end: "across A, B and C"."""
    listed = F.regexp_extract(F.lower(_col(c)), r"(?:^|[^a-z])(?:across|between|among) ([^.?!;\n]+)", 1)
    parts = F.split(listed, r", and |, or |,| and | or ")
    named = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^(the|both|all) ", ""), r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.array_distinct(F.filter(named, lambda p: p != ""))


def phrase_candidates(c: Column | str) -> Column:
    """Quoted phrases, numbered steps, snake-case names, seasons and episodes, dates, and names of several capitalised words."""
    text = _col(c)
    patterns = (r'"([^"]+)"', r"((?:Step|Turn|Phase|Part) [0-9]+)", r"([a-z]+(?:_[a-z0-9]+)+)", r"(Season [0-9]+ Episode [0-9]+)", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)")
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p)) for p in patterns)))


def around_phrase(c: Column | str, phrase: str, reach: int = 300) -> Column:
    """The lines around a phrase's first match, from reach characters before it to as many behind; null if it isn't there."""
    text = _col(c)
    at = F.instr(F.lower(text), phrase.lower()) - 1
    start, end = F.greatest(F.lit(0), at - reach), F.least(F.char_length(text), at + len(phrase) + reach)
    head = F.left(text, start + 1)
    back = F.instr(F.reverse(head), "\n")
    start = F.when((start > 0) & (back > 0), F.char_length(head) - back).when(start > 0, F.lit(0)).otherwise(start)
    ahead = F.instr(F.substr(text, end + 1), "\n")
    end = F.when(ahead > 0, end + ahead - 1).otherwise(F.char_length(text))
    return F.when(at >= 0, F.regexp_replace(F.substr(text, start + 1, end - start), r"^\s+|\s+$", ""))


def modality(c: Column | str) -> Column:
    """The first of question, conditional, hypothetical, recommendation and uncertain that a cue shows; else asserted."""
    low = F.lower(_col(c))
    out = F.when(F.trim(low) == "", "uncertain")
    for name, pattern in CUES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("asserted")


def safety_critical(c: Column | str) -> Column:
    """Whether the text states something about its writer that must not be lost: a correction, an allergy, a stop."""
    low = F.lower(F.trim(_col(c)))
    own = low.rlike(r"(^|[^a-z])i([^a-z]|$)")
    return (low.rlike(r"(^|[^a-z])(actually|correction|i meant)([^a-z]|$)") & own) | low.rlike(r"(^|[^a-z])i( am|'m)? (allergic|diabetic|pregnant|no longer|stopped taking)([^a-z]|$)")


def object_keyword(c: Column | str, least: int = 5) -> Column:
    """The longest capitalised word of five letters or more, else the longest word; the first of equal ones; null if none."""
    words = F.filter(F.regexp_extract_all(_col(c), F.lit("([A-Za-z']+)")), lambda w: (F.char_length(w) >= least) & ~F.lower(w).isin(*GENERIC))

    def longest(a: Column) -> Column:
        return F.aggregate(a, F.lit(None).cast("string"), lambda best, w: F.when(best.isNull() | (F.char_length(w) > F.char_length(best)), w).otherwise(best))

    return F.coalesce(longest(F.filter(words, lambda w: w.rlike("^[A-Z]"))), longest(words))


def code_refs(c: Column | str, most: int = 12) -> Column:
    """Distinct paths of source files without a leading ./, in order."""
    found = F.regexp_extract_all(_col(c), F.lit(r"([A-Za-z0-9_./-]+\.(?:py|js|ts|rs|go|java|sql))"))
    return F.slice(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"^(\./)+", ""))), 1, most)


def ambiguous_referent(c: Column | str) -> Column:
    """Whether a pronoun stands for a person whom the text doesn't name."""
    return F.lower(_col(c)).rlike(r"(^|[^a-z])(he|she|him|her|they|them|someone|somebody)([^a-z]|$)")


def theme_label(c: Column | str, most: int = 3) -> Column:
    """The longest priority terms, ties by the alphabet, joined."""
    ordered = F.array_sort(F.transform(priority_terms(c), lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
    return F.concat_ws(" ", F.transform(F.slice(ordered, 1, most), lambda x: x["w"]))


def quantities(c: Column | str) -> Column:
    """Numbers with a scale and a unit, as array of (value, unit): "3.5 million queries" is (3500000, queries)."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)( thousand| million| billion)? ([a-z]+)"
    text = F.lower(_col(c))
    n, scale, unit = (F.regexp_extract_all(text, F.lit(pattern), k) for k in (1, 2, 3))
    factor = lambda s: F.when(s == " thousand", 1e3).when(s == " million", 1e6).when(s == " billion", 1e9).otherwise(1.0)
    return F.transform(F.arrays_zip(n.alias("n"), scale.alias("s"), unit.alias("u")), lambda x: F.struct((x["n"].cast("double") * factor(x["s"])).alias("value"), x["u"].alias("unit")))


def relative_date(c: Column | str, day: Column) -> Column:
    """The date that the first relative phrase names, seen from day; null without one. A vague word alone names none."""
    low = F.lower(_col(c))
    has = lambda p: low.rlike(rf"(^|[^a-z0-9]){p}([^a-z0-9]|$)")
    ago = F.regexp_extract(low, r"(?:^|[^a-z0-9])([0-9]+|" + "|".join(NUMBER_WORDS) + r") (?:day|week)s? ago", 1)
    n = F.coalesce(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), ago).cast("int"), F.lit(0))
    n = F.when(ago.rlike("^[0-9]+$"), ago.try_cast("int")).otherwise(n)
    n = F.when(low.rlike(r" weeks? ago"), n * 7).otherwise(n)
    out = F.when(low.rlike(r"(^|[^a-z])(recently|sometime|a while ago)([^a-z]|$)"), F.lit(None).cast("date")).when(ago != "", F.date_sub(day, n))
    for phrase, days in RELATIVE_DAYS.items():
        out = out.when(has(phrase), F.date_add(day, F.lit(days)))
    for phrase, months in RELATIVE_MONTHS.items():
        out = out.when(has(phrase), F.add_months(day, months))
    return out


def with_dates(c: Column | str, day: Column) -> Column:
    """The text with its relative phrase written as a date."""
    phrases = [r"(?:[0-9]+|" + "|".join(NUMBER_WORDS) + r") (?:days?|weeks?) ago", *RELATIVE_DAYS, *RELATIVE_MONTHS]
    found = relative_date(c, day)
    written = F.regexp_replace(_col(c), F.lit(r"\b(?:" + "|".join(phrases) + r")\b"), F.concat(F.lit("on "), F.date_format(found, "yyyy-MM-dd")))
    return F.when(found.isNull(), _col(c)).otherwise(written)


def comparison_date(c: Column | str) -> Column:
    """2023-04-20, 2023/04/20 and what follows them as a date; null for anything else."""
    head = F.translate(F.left(_col(c), F.lit(10)), "/", "-")
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(F.try_to_timestamp(head, F.lit("yyyy-MM-dd"))))


def envelope_time(c: Column | str) -> Column:
    """UTC of "Mon 2024-05-06 14:05 EST": the zone's name shifts the clock; null without a known zone."""
    text = _col(c)
    at = F.try_to_timestamp(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})", 1), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    zone = F.regexp_extract(text, r" ([A-Z]{3,4})$", 1)
    ahead = F.element_at(F.create_map(*(F.lit(x) for z in ZONES.items() for x in z)), zone)
    return at - F.make_dt_interval(hours=ahead)
