"""The subpackage's queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from quantloom.llm.alignment import op13_byte_owner_alignment
from quantloom.llm.bigru import op7_bigru_language
from quantloom.llm.decontamination import OP5_SQL, op5_benchmark_windows
from quantloom.llm.host_rules import OP6_SQL, op6_host_rules
from quantloom.llm.kneser_ney import op10_kneser_ney
from quantloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from quantloom.llm.minmax import OP8_SQL, op8_minmax_dedup
from quantloom.llm.mixing import op9_temperature_mix
from quantloom.llm.packing import op12_mixture_packing
from quantloom.llm.pii import op2_boosted_pii
from quantloom.llm.secrets import op1_secret_forest
from quantloom.llm.sharding import op4_sampled_splitters
from quantloom.llm.toxicity import op3_ftrl_toxicity

QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_boosted_pii": op2_boosted_pii,
    "op3_ftrl_toxicity": op3_ftrl_toxicity,
    "op4_sampled_splitters": op4_sampled_splitters,
    "op5_benchmark_windows": op5_benchmark_windows,
    "op6_host_rules": op6_host_rules,
    "op7_bigru_language": op7_bigru_language,
    "op8_minmax_dedup": op8_minmax_dedup,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_mixture_packing": op12_mixture_packing,
    "op13_byte_owner_alignment": op13_byte_owner_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op5_benchmark_windows": OP5_SQL,
    "op6_host_rules": OP6_SQL,
    "op8_minmax_dedup": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
