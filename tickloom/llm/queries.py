"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontam import OP4_SQL, op4_decontaminate
from .html import op9_text_density
from .language import op1_language_id
from .license import op7_license_scan
from .packing import op5_packing
from .pii import op2_pii
from .quality import OP10_SQL, op10_quality_cascade
from .simhash import op6_simhash
from .suffix_tree import op3_suffix_tree
from .tokens import op8_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_license_scan": op7_license_scan,
    "op8_token_counts": op8_token_counts,
    "op9_text_density": op9_text_density,
    "op10_quality_cascade": op10_quality_cascade,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": OP4_SQL,
    "op10_quality_cascade": OP10_SQL,
}
