"""Queries of the corpus operators, by name, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from strandloom.llm.bpe import op13_bpe_round_trip
from strandloom.llm.collocations import op12_collocations
from strandloom.llm.collocations_sql import collocations_sql
from strandloom.llm.language_id import op6_language_id
from strandloom.llm.license_scan import op10_license_scan
from strandloom.llm.license_sql import licence_sql
from strandloom.llm.multi_index import op9_multi_index
from strandloom.llm.multi_index_sql import near_vectors_sql
from strandloom.llm.order_minhash import op7_order_minhash
from strandloom.llm.packing import op5_best_fit_packing
from strandloom.llm.quality import op8_quality
from strandloom.llm.resampling import op11_importance_resampling
from strandloom.llm.resampling_sql import resampling_sql
from strandloom.llm.source_mix import op1_source_mix
from strandloom.llm.source_mix_sql import source_mix_sql
from strandloom.llm.spot_signatures import op4_spot_signatures
from strandloom.llm.spot_signatures_sql import spot_signatures_sql
from strandloom.llm.token_counts import op3_token_counts
from strandloom.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_spot_signatures": op4_spot_signatures,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_order_minhash": op7_order_minhash,
    "op8_quality": op8_quality,
    "op9_multi_index": op9_multi_index,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_collocations": op12_collocations,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}
SQL: dict[str, str] = {"op1_source_mix": source_mix_sql(), "op4_spot_signatures": spot_signatures_sql(), "op9_multi_index": near_vectors_sql(), "op10_license_scan": licence_sql(), "op11_importance_resampling": resampling_sql(), "op12_collocations": collocations_sql()}
