"""The operators' registered queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.decontam import OP4_SQL, op4_decontamination
from tallyframe.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from tallyframe.llm.html_text import op10_html
from tallyframe.llm.lm_scoring import OP8_SQL, op8_lm_scoring
from tallyframe.llm.packing import op6_packing
from tallyframe.llm.quality import OP2_SQL, op2_quality
from tallyframe.llm.recompression import OP13_SQL, op13_periods
from tallyframe.llm.revisits import OP3_SQL, op3_revisits
from tallyframe.llm.secrets import OP5_SQL, op5_secrets
from tallyframe.llm.sharding import op1_sharding
from tallyframe.llm.simhash import op9_simhash
from tallyframe.llm.toxicity import op7_toxicity
from tallyframe.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_revisits": op3_revisits,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_simhash": op9_simhash,
    "op10_html": op10_html,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_whitening": op12_whitening,
    "op13_periods": op13_periods,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality": OP2_SQL,
    "op3_revisits": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_secrets": OP5_SQL,
    "op8_lm_scoring": OP8_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op13_periods": OP13_SQL,
}
