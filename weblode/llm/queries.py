"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from weblode.llm.chats import OP10_SQL, op10_chats
from weblode.llm.fingerprints import op5_fingerprints
from weblode.llm.jaccard import OP3_SQL, op3_jaccard
from weblode.llm.language import op2_language
from weblode.llm.licenses import op4_licenses
from weblode.llm.merkle import OP12_SQL, op12_merkle
from weblode.llm.negatives import OP13_SQL, op13_negatives
from weblode.llm.packing import op7_packing
from weblode.llm.pieces import op6_pieces
from weblode.llm.secrets import op8_secrets
from weblode.llm.suffixes import op1_suffixes
from weblode.llm.tokens import op11_tokens
from weblode.llm.topk import OP9_SQL, op9_topk

QUERIES = {
    "op1_suffixes": op1_suffixes,
    "op2_language": op2_language,
    "op3_jaccard": op3_jaccard,
    "op4_licenses": op4_licenses,
    "op5_fingerprints": op5_fingerprints,
    "op6_pieces": op6_pieces,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_topk": op9_topk,
    "op10_chats": op10_chats,
    "op11_tokens": op11_tokens,
    "op12_merkle": op12_merkle,
    "op13_negatives": op13_negatives,
}

#: Sketches, models, tokens, bins and cuts at byte level have no SQL counterpart; those queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_jaccard": OP3_SQL, "op9_topk": OP9_SQL, "op10_chats": OP10_SQL, "op12_merkle": OP12_SQL, "op13_negatives": OP13_SQL,
}
