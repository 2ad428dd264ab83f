"""Queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .audio import op8_audio
from .bpe import op1_bpe
from .decontaminate import ORACLE as OP5
from .decontaminate import op5_decontaminate
from .line_dedup import op7_line_dedup
from .minhash import op2_minhash
from .pii import op9_pii
from .ranked_search import ORACLE as OP12
from .ranked_search import op12_ranked_search
from .sharding import ORACLE as OP3
from .sharding import op3_sharding
from .token_counts import op13_token_counts
from .toxicity import op6_toxicity
from .url_filter import ORACLE as OP4
from .url_filter import op4_url_filter
from .warc import ORACLE_SQL as OP10
from .warc import op10_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_audio": op8_audio,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_alignment": op11_alignment,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {"op3_sharding": OP3, "op4_url_filter": OP4, "op5_decontaminate": OP5, "op10_warc": OP10, "op12_ranked_search": OP12}
