"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversations import OP12_SQL, op12_repair
from .decontaminate import op2_decontaminate
from .jaccard import OP7_SQL, op7_jaccard
from .licenses import OP11_SQL, op11_licenses
from .lm import op6_lm
from .packing import op1_packing
from .pii import op3_pii
from .sharding import op5_sharding
from .token_counts import op8_token_counts
from .topk import OP4_SQL, op4_topk
from .toxicity import op9_toxicity
from .warc import OP10_SQL, op10_warc
from .whitening import op13_whitening

QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_topk": op4_topk,
    "op5_sharding": op5_sharding,
    "op6_lm": op6_lm,
    "op7_jaccard": op7_jaccard,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_licenses": op11_licenses,
    "op12_repair": op12_repair,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {"op4_topk": OP4_SQL, "op7_jaccard": OP7_SQL, "op10_warc": OP10_SQL, "op11_licenses": OP11_SQL, "op12_repair": OP12_SQL}
