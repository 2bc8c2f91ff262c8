"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import oracles
from millrace.llm.bpe import op5_bpe_encoding
from millrace.llm.chat import op9_chat_formatting
from millrace.llm.decontaminate import op4_benchmark_decontamination
from millrace.llm.licenses import op7_license_scan
from millrace.llm.piecewise import op3_document_fingerprints
from millrace.llm.quality import op10_quality_classifier
from millrace.llm.repeats import op8_suffix_array_dedup
from millrace.llm.sharding import op6_sharding
from millrace.llm.simhash import op1_simhash_near_dedup
from millrace.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_bpe_encoding": op5_bpe_encoding,
    "op6_sharding": op6_sharding,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op4_benchmark_decontamination": oracles.OP4,
    "op7_license_scan": oracles.OP7,
    "op8_suffix_array_dedup": oracles.OP8,
    "op9_chat_formatting": oracles.OP9,
}
