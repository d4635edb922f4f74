"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP1_SQL, op1_decontamination
from .language import op6_language
from .line_templates import OP3_SQL, op3_line_templates
from .maxent import op2_maxent
from .neighbours import op4_neighbours
from .ngram_join import op8_ngram_join
from .sentence_pieces import op10_sentence_pieces
from .sharding import op5_sharding
from .token_store import op9_token_store
from .toxicity import op7_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_maxent": op2_maxent,
        "op3_line_templates": op3_line_templates,
        "op4_neighbours": op4_neighbours,
        "op5_sharding": op5_sharding,
        "op6_language": op6_language,
        "op7_toxicity": op7_toxicity,
        "op8_ngram_join": op8_ngram_join,
        "op9_token_store": op9_token_store,
        "op10_sentence_pieces": op10_sentence_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op3_line_templates": OP3_SQL,
    }
