"""The registered queries of the training-data operators and, where SQL can say it, the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import op4_bpe
from .classifier import op5_quality_classifier
from .hard_negatives import op12_hard_negatives
from .license_scan import op3_license_scan
from .merkle import op13_merkle
from .mixing import op10_mixing
from .nearest import op9_nearest
from .ngram_join import op6_ngram_join
from .piece_bpe import op11_pieces
from .quality_rules import op1_quality_rules
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op7_toxicity
from .url_filter import op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_nearest": op9_nearest,
    "op10_mixing": op10_mixing,
    "op11_pieces": op11_pieces,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": oracles.OP1, "op10_mixing": oracles.OP10, "op12_hard_negatives": oracles.OP12, "op13_merkle": oracles.OP13}
