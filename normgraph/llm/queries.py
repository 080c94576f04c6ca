"""The registered queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from .fingerprints import op1_document_fingerprints
from .jaccard_join import OP4_SQL, op4_ngram_jaccard_join
from .mixing import OP7_SQL, op7_mixing_sources
from .packing import op6_harmonic_packing
from .quality_rules import op10_quality_rules
from .repeats import OP8_SQL, op8_suffix_dedup
from .rule_ensemble import op5_rule_ensemble
from .token_counts import op3_token_counts
from .toxicity import op9_toxicity
from .warc import OP2_SQL, op2_warc_index_merge

QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_warc_index_merge,
        op3_token_counts,
        op4_ngram_jaccard_join,
        op5_rule_ensemble,
        op6_harmonic_packing,
        op7_mixing_sources,
        op8_suffix_dedup,
        op9_toxicity,
        op10_quality_rules,
    )
}

SQL = {"op2_warc_index_merge": OP2_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op7_mixing_sources": OP7_SQL, "op8_suffix_dedup": OP8_SQL}
