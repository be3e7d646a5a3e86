"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm.brown_lm import op4_brown_class_lm
from millrace.llm.byte_bpe import op9_byte_bpe
from millrace.llm.decontaminate import ORACLE_SQL as DECONTAMINATION_SQL
from millrace.llm.decontaminate import op7_benchmark_decontamination
from millrace.llm.divergence import op3_distribution_divergence
from millrace.llm.licenses import ORACLE_SQL as LICENSE_SQL
from millrace.llm.licenses import op1_license_scan
from millrace.llm.pii_crf import op6_pii_crf
from millrace.llm.quality_rank import op8_quality_bradley_terry
from millrace.llm.resharding import op2_min_cost_resharding
from millrace.llm.simhash_golay import op10_simhash_golay
from millrace.llm.toxicity import op5_toxicity_grammar

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_license_scan": op1_license_scan,
    "op2_min_cost_resharding": op2_min_cost_resharding,
    "op3_distribution_divergence": op3_distribution_divergence,
    "op4_brown_class_lm": op4_brown_class_lm,
    "op5_toxicity_grammar": op5_toxicity_grammar,
    "op6_pii_crf": op6_pii_crf,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_bradley_terry": op8_quality_bradley_terry,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash_golay": op10_simhash_golay,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": LICENSE_SQL,
    "op7_benchmark_decontamination": DECONTAMINATION_SQL,
}
