"""Queries of this subpackage, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

from .collocations import op11_collocations
from .decontaminate import op7_decontamination
from .divergence import op12_source_divergence
from .fingerprints import op5_multiset_fingerprint
from .html_text import op6_html_extraction
from .line_dedup import op8_line_dedup
from .near_dedup import op2_minhash_near_dedup
from .oracles import ORACLES as ORACLES
from .packing import op3_best_fit_packing
from .pii import op1_personal_data
from .suffix_dedup import op4_suffix_dedup
from .token_files import op10_token_files
from .toxicity import op9_toxicity
from .warc import op13_warc

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_multiset_fingerprint": op5_multiset_fingerprint,
    "op6_html_extraction": op6_html_extraction,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_warc": op13_warc,
}
