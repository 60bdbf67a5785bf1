"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import op8_quotation_links, op8_quoted_replies
from .chat_sql import OP8_SQL, REPLIES_SQL
from .decontam import op10_fm_decontamination
from .decontam_sql import OP10_SQL
from .filter_audit import OP12_SQL, op12_filter_audit
from .langid import op4_language_evidence
from .line_dedup import OP2_SQL, op2_line_runs
from .neighbours import op11_projection_forest
from .packing import op1_mixture_packing
from .quality import op9_compression_bands
from .sharding import OP5_SQL, op5_feistel_shards
from .simhash import op7_bit_sliced_simhash
from .token_alignment import op13_token_alignment
from .token_counts import op3_token_counts
from .warc import OP6_SQL, op6_merkle_fixity

QUERIES = {
    f.__name__: f
    for f in (
        op1_mixture_packing,
        op2_line_runs,
        op3_token_counts,
        op4_language_evidence,
        op5_feistel_shards,
        op6_merkle_fixity,
        op7_bit_sliced_simhash,
        op8_quotation_links,
        op9_compression_bands,
        op10_fm_decontamination,
        op11_projection_forest,
        op12_filter_audit,
        op13_token_alignment,
        op8_quoted_replies,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_runs": OP2_SQL,
    "op5_feistel_shards": OP5_SQL,
    "op6_merkle_fixity": OP6_SQL,
    "op8_quotation_links": OP8_SQL,
    "op8_quoted_replies": REPLIES_SQL,
    "op10_fm_decontamination": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
}
