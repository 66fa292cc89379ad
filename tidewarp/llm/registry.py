"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_collocations
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .filter_audit import OP13_SQL, op13_filter_audit
from .line_dedup import OP7_SQL, op7_line_dedup
from .mixing import OP9_SQL, op9_poisson_mixing
from .ngram_join import OP2_SQL, op2_ngram_jaccard
from .packing import op6_harmonic_packing
from .quality import op12_quality_discriminant
from .secrets import BASE_SQL, op5_secret_scan, secret_base_counts
from .sharding import OP3_SQL, op3_extendible_sharding
from .topk import OP1_SQL, op1_topk_codes
from .toxicity import op10_toxicity
from .warc import op4_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_codes,
        op2_ngram_jaccard,
        op3_extendible_sharding,
        op4_warc,
        op5_secret_scan,
        op6_harmonic_packing,
        op7_line_dedup,
        op8_exact_dedup,
        op9_poisson_mixing,
        op10_toxicity,
        op11_collocations,
        op12_quality_discriminant,
        op13_filter_audit,
        secret_base_counts,
    )
}
ORACLES = {
    "op1_topk_codes": OP1_SQL,
    "op2_ngram_jaccard": OP2_SQL,
    "op3_extendible_sharding": OP3_SQL,
    "secret_base_counts": BASE_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_poisson_mixing": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
