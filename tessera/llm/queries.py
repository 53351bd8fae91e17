"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_centroids
from .chat import OP12_SQL, op12_chat
from .codes import OP11_SQL, op11_codes
from .language import op7_language
from .lm import op2_lm
from .neardup import op6_neardup
from .neighbours import op8_neighbours
from .packing import op5_packing
from .pieces import op4_pieces
from .quality import op3_quality
from .rules import OP10_SQL, op10_rules
from .suffixes import op9_suffixes
from .urls import OP1_SQL, op1_urls

QUERIES = {
    "op1_urls": op1_urls,
    "op2_lm": op2_lm,
    "op3_quality": op3_quality,
    "op4_pieces": op4_pieces,
    "op5_packing": op5_packing,
    "op6_neardup": op6_neardup,
    "op7_language": op7_language,
    "op8_neighbours": op8_neighbours,
    "op9_suffixes": op9_suffixes,
    "op10_rules": op10_rules,
    "op11_codes": op11_codes,
    "op12_chat": op12_chat,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_urls": OP1_SQL,
    "op10_rules": OP10_SQL,
    "op11_codes": OP11_SQL,
    "op12_chat": OP12_SQL,
    "op13_centroids": OP13_SQL,
}
