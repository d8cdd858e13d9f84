"""Queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.bpe import op5_bpe
from brindle.llm.canonical import op2_fingerprints
from brindle.llm.divergence import OP12_SQL, op12_source_divergence
from brindle.llm.edits import op10_token_counts
from brindle.llm.kneser_ney import op1_lm_score
from brindle.llm.licences import op8_licences
from brindle.llm.monoid import op11_byte_bpe
from brindle.llm.quality import op7_quality
from brindle.llm.simhash import op4_simhash
from brindle.llm.suffix import op9_decontamination
from brindle.llm.warc import OP6_SQL, op6_warc
from brindle.llm.whitening import op13_whitening
from brindle.llm.winnow import op3_line_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_fingerprints": op2_fingerprints,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_licences": op8_licences,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op6_warc": OP6_SQL,
    "op12_source_divergence": OP12_SQL,
}
