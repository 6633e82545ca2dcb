"""The queries of this subpackage."""

from __future__ import annotations

from .alignment import op11_tokenizer_alignment
from .decontamination import OP10_SQL, op10_decontamination
from .language_id import op7_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .license_scan import op1_license_scan
from .lm_scoring import op3_lm_scoring
from .near_dedup import op8_near_dedup
from .packing import op4_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import op5_quality_rules
from .token_output import op6_token_output
from .toxicity import op2_toxicity
from .url_filter import OP12_SQL, op12_url_filter


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_toxicity": op2_toxicity,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_packing": op4_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_output": op6_token_output,
        "op7_language_id": op7_language_id,
        "op8_near_dedup": op8_near_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_decontamination": op10_decontamination,
        "op11_tokenizer_alignment": op11_tokenizer_alignment,
        "op12_url_filter": op12_url_filter,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_decontamination": OP10_SQL, "op12_url_filter": OP12_SQL, "op13_lexical_search": OP13_SQL}
