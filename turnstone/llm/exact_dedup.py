"""Exact duplicates by a tree-merge of sorted digest runs; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hidden, materialize, one_of_each, quoted, read, spread

#: Runs are dealt to RADIX ** rounds nodes, of about NODE_ROWS rows each; each round merges RADIX runs at a node.
RADIX, LEAST_ROUNDS, NODE_ROWS = 16, 2, 1_000_000
#: Rows to drop that are broadcast (counted first); more are joined by a shuffle.
FEW = 200_000
KEY = ("digest", "check", "size")


def _digits(x: str, keep: int, radix: int, rounds: int):
    """The leading keep digits of x in base radix, the others 0."""
    unit = radix ** (rounds - keep)
    return (F.floor(F.col(x) / unit) * unit).cast("int")


def _norm(text_col: str):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _sha256(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chars, digest, check, size): the text without white space as SHA-256, a second hash and its length."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"),
        _norm(text_col).alias("norm"),
    ).select("id", "chars", _sha256(F.col("norm")).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("size"))


def rounds_for(rows: int, radix: int = RADIX) -> int:
    """As many rounds as leave a node about NODE_ROWS rows; as a number of digits, so that any input has enough nodes."""
    rounds = LEAST_ROUNDS
    while radix**rounds * NODE_ROWS < rows:
        rounds += 1
    return rounds


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX, rounds: int | None = None
) -> DataFrame:
    """Decides for every row whether it stays among the rows with an equal text.

    Texts are equal when they are identical without the characters [\\x20\\x09-\\x0D]; null counts as empty. Of equal
    texts the one with the most code points stays, then the smallest id. Returns id_col, keep_id, group_size, kept,
    text_sha256 (of the normalised text), one row for each input row; other columns of docs are not read, so their
    names cannot clash. Rows with one identifier and equal texts stay or go together (null is an identifier like
    others here); rows with one identifier and different texts are decided each. An empty table gives an empty result.

    Each run holds the rows whose identifier hashes to it, aggregated where they were read and sorted by digest.
    In round r the nodes that agree in all digits but the r-th exchange their runs (a binomial exchange with radix
    partners): a row goes to the partner that its digest's r-th digit names, where the radix runs are merged and the
    best identifier and the count of each digest retained. After the last round each node holds a digest range whole.
    A digest has at most radix rows at a node, however many copies there are. The two-part hash and the length
    verify an identity at every level. The way back goes over (run, digest), so a large group returns in all runs.
    The number of rounds, and with it of nodes, follows the number of rows unless it is given.
    """
    slim = materialize(digests(docs, id_col, text_col), "digests")
    rounds = rounds_for(slim.count(), radix) if rounds is None else rounds
    n = radix**rounds
    slim = slim.withColumn("run", spread("id", n))
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("none"), "id")).alias("best")
    first = slim.groupBy("run", *KEY).agg(best, F.count("*").alias("n"))
    level = first.withColumn("range", F.pmod("check", F.lit(n)).cast("int"))
    for r in range(1, rounds + 1):
        # digits 1..r name the digest range, the others still the run
        rest = F.col("run") - _digits("run", r, radix, rounds)
        level = (
            level.withColumn("node", _digits("range", r, radix, rounds) + rest)
            .repartition("node")
            .sortWithinPartitions("node", *KEY)
            .groupBy("node", *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.first("range").alias("range"))
            .withColumn("run", F.col("node"))
        )
    final = level.select(*KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    back = first.select("run", *KEY).join(final, list(KEY))
    return (
        slim.join(back, ["run", *KEY])
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """docs without the rows that exact_dedup() lets go; all columns stay, whatever their names.

    One row of each text stays: of rows with one identifier and equal texts that with the most code points (then by a
    hash of all columns). Rows go by identifier and text together, so a row whose identifier another text has too is
    judged on its own; a null identifier is one like others, last in order. Nulls and empty texts are one text. Up to
    ``few`` rows to drop (counted first) are broadcast, more are joined by a shuffle. An empty table stays empty.
    """
    decided = exact_dedup(docs, id_col, text_col).groupBy(id_col, "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    digest, key, other, kept = hidden(docs, "digest", "key", "other", "kept")
    named = (F.col(id_col).alias(key), F.unhex("text_sha256").alias(other), F.col("kept").alias(kept))
    decided = materialize(decided.where("NOT kept OR n > 1").select(*named), "copies")
    near = F.broadcast(decided) if decided.limit(few + 1).count() <= few else decided.hint("merge")
    marked = docs.withColumn(digest, _sha256(_norm(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(other))
    alone = marked.join(near, same, "left_anti").select(*quoted(*docs.columns))
    again = decided.where(F.col(kept))
    if not again.limit(1).count():
        return alone
    rows = marked.join(again, same, "left_semi")
    return alone.unionByName(one_of_each(rows, [id_col, digest], F.length(F.coalesce(F.col(text_col), F.lit(""))), docs.columns))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
