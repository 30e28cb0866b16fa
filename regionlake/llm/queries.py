"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dartminhash, decontaminate, html_text, mixing, pq, suffix_array, suffix_tree, tokens, toxicity, warc
from .common import table

#: The vocabulary file that op8's query counts by.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": lambda s, d: decontaminate.op1(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_pq": lambda s, d: pq.op2(table(s, d, "embeddings")),
        "op3_html_text": lambda s, d: html_text.op3(table(s, d, "pages")),
        "op4_warc": lambda s, d: warc.op4(table(s, d, "pages")),
        "op5_suffix_array": lambda s, d: suffix_array.op5(table(s, d, "documents")),
        "op6_mixing": lambda s, d: mixing.op6(table(s, d, "documents")),
        "op7_suffix_tree": lambda s, d: suffix_tree.op7(table(s, d, "documents")),
        "op8_token_counts": lambda s, d: tokens.op8(table(s, d, "documents"), VOCABULARY),
        "op9_dartminhash": lambda s, d: dartminhash.op9(table(s, d, "documents")),
        "op10_toxicity": lambda s, d: toxicity.op10(table(s, d, "documents"), table(s, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op2_pq": pq.ORACLE,
        "op4_warc": warc.ORACLE,
        "op5_suffix_array": suffix_array.ORACLE,
        "op7_suffix_tree": suffix_tree.ORACLE,
        "op9_dartminhash": dartminhash.ORACLE,
    }
