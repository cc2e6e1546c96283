"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = ("the", "and", "for", "with", "that", "this", "was", "are", "from", "to", "of", "in", "is", "it", "on", "as", "an", "at", "be", "by")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(c: Column | str) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty text."""
    n = F.char_length(_col(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def excerpt(c: Column | str, needle: Column | str, reach: int = 200) -> Column:
    """reach characters on both sides of the first match, with dots where it is cut; else the first 2*reach."""
    text = _col(c)
    at = F.instr(F.lower(text), F.lower(needle))
    start, end = F.greatest(at - reach, F.lit(1)), F.least(at + F.char_length(needle) + reach, F.char_length(text) + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.char_length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, 2 * reach))


def normalize_turn_text(c: Column | str) -> Column:
    """Without a session header and media marks; blanks in runs are one, lines are trimmed."""
    text = F.regexp_replace(_col(c), r"^\[Session from [^\]]*\]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\[media:[^\]]*\]", ""), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, r"\n+", "\n"))


def turn_hash(user: Column | str, assistant: Column | str) -> Column:
    """SHA-256 over a version byte, the user's text, a rule and the assistant's text."""
    return F.sha2(F.concat(F.lit("\u0001"), F.coalesce(_col(user), F.lit("")), F.lit("\n---\n"), F.coalesce(_col(assistant), F.lit(""))), 256)


def normalize_tag(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def query_terms(c: Column | str) -> Column:
    """Distinct lower-case words of two or more letters or digits that are no stopwords, in order."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-z0-9]{2,})"))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS)))


def ngrams(words: Column | str, n: int) -> Column:
    w = _col(words)
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(n))))
    )


def value_tokens(c: Column | str, most: int = 8) -> Column:
    """Dates, versions, percentages and numbers, leftmost first and longest kind first."""
    return F.slice(F.regexp_extract_all(_col(c), F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2}|v?[0-9]+\.[0-9]+\.[0-9]+|[0-9]+(?:\.[0-9]+)?%|[0-9]+(?:\.[0-9]+)?)")), 1, most)


def value_signal_bonus(c: Column | str) -> Column:
    numbers = F.size(F.regexp_extract_all(_col(c), F.lit(r"([0-9]+)")))
    percents = F.size(F.regexp_extract_all(_col(c), F.lit(r"([0-9]+%)")))
    both = F.when((numbers > 0) & (percents > 0), 1.0).otherwise(0.0)
    return F.round(F.least(numbers * 0.4, F.lit(2.5)) + F.least(percents * 1.0, F.lit(2.0)) + both, 6)


def specificity(c: Column | str) -> Column:
    text = _col(c)
    words = F.size(F.regexp_extract_all(text, F.lit(r"(\S+)")))
    digits = F.size(F.regexp_extract_all(text, F.lit(r"([0-9])")))
    return F.round(F.least(words / 25.0, F.lit(1.0)) + F.least(digits / 6.0, F.lit(1.0)), 6)


def normalize_answer(c: Column | str) -> Column:
    """Lower case, without punctuation and articles; blanks in runs are one."""
    text = F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\b(a|an|the)\b", " "), r"\s+", " "))


def handle_base(c: Column | str) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(base == "", "speaker").otherwise(F.substring(base, 1, 24))


def summary_target(tokens: Column | str) -> Column:
    """15 % of the tokens, between 200 and 2000."""
    return F.least(F.greatest(F.floor(_col(tokens) * 0.15), F.lit(200)), F.lit(2000)).cast("long")


def image_tokens(width: Column | str, height: Column | str) -> Column:
    """Area over 750 after scaling the longer side to 1568 at most."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    scale = F.least(F.lit(1.0), 1568.0 / F.greatest(w, h))
    return F.ceil(F.floor(w * scale) * F.floor(h * scale) / 750).cast("long")


def keyword_tags(c: Column | str, table: dict[str, tuple[str, ...]], fallback: str = "_general") -> Column:
    """Sorted tags that have a keyword in the text; the fallback if there is none."""
    text = F.lower(_col(c))
    hits = []
    for tag, keywords in sorted(table.items()):
        found = F.lit(False)
        for k in keywords:
            found = found | F.contains(text, F.lit(k))
        hits.append(F.when(found, tag))
    tags = F.array_compact(F.array(*hits))
    return F.when(F.size(tags) == 0, F.array(F.lit(fallback))).otherwise(tags)
