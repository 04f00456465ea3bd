"""The queries of this subpackage, by name. ORACLES: DuckDB SQL where SQL can express a query."""

from __future__ import annotations

from lamellar.llm import oracles, quality
from lamellar.llm.decontamination import op3_decontaminate
from lamellar.llm.langid import op8_language_id
from lamellar.llm.packing import op7_best_fit_pack
from lamellar.llm.pii import op9_pii
from lamellar.llm.quality import op4_quality_rules
from lamellar.llm.quotes import op6_quotation_linking
from lamellar.llm.sharding import op2_sharding
from lamellar.llm.simhash import op1_simhash
from lamellar.llm.token_files import op10_token_files
from lamellar.llm.urls import op5_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_quotation_linking": op6_quotation_linking,
    "op7_best_fit_pack": op7_best_fit_pack,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_token_files": op10_token_files,
}

ORACLES: dict[str, str] = {"op4_quality_rules": quality.oracle()} | oracles.ORACLES
