"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from quarry.llm.fingerprints import op11_fingerprints
from quarry.llm.jaccard import op2_jaccard_join
from quarry.llm.neighbours import op8_neighbours
from quarry.llm.packing import op9_packing
from quarry.llm.periodic import op13_periodic_runs
from quarry.llm.quality import op4_quality_rules
from quarry.llm.secrets import op6_secret_scans
from quarry.llm.sentencepiece import op1_sentencepiece
from quarry.llm.spelling import op12_spelling_variants
from quarry.llm.substrings import op5_substring_dedup
from quarry.llm.token_counts import op10_token_counts
from quarry.llm.token_output import op3_token_output
from quarry.llm.toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_jaccard_join, op3_token_output, op4_quality_rules, op5_substring_dedup,
        op6_secret_scans, op7_toxicity, op8_neighbours, op9_packing, op10_token_counts,
        op11_fingerprints, op12_spelling_variants, op13_periodic_runs,
    )
}

#: None of the thirteen can be said in SQL (tokenizers, fitted models, regular-expression places, hashed indexes, checksums
#: that the SQL engine lacks); tests/llm holds each against a brute-force version, an exact round trip or held-out labels.
ORACLE_SQL: dict[str, str] = {}
