"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .licenses import op7_license_scan
from .ordinal import op8_quality
from .packing import op2_packing
from .partenum import OP6_SQL, op6_ngram_jaccard_join
from .pii import op3_pii
from .rp_forest import op10_rp_forest
from .sp_sampling import op5_sp_sampling
from .superkmers import OP12_SQL, op12_substring_dedup
from .toxicity import op1_toxicity
from .warc import op4_warc
from .yinyang import OP13_SQL, op13_yinyang

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_sp_sampling": op5_sp_sampling,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_rp_forest": op10_rp_forest,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_yinyang": op13_yinyang,
}

ORACLE_SQL: dict[str, str] = {"op6_ngram_jaccard_join": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_collocations": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_yinyang": OP13_SQL}
