"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from bytefacts.llm.audio import op10_audio
from bytefacts.llm.licenses import op8_licenses
from bytefacts.llm.packing import op2_packing
from bytefacts.llm.piece_encoding import op1_piece_encoding
from bytefacts.llm.pii import op9_pii
from bytefacts.llm.quality import op7_quality
from bytefacts.llm.shards import OP4_SQL, op4_shards
from bytefacts.llm.simhash import op6_simhash
from bytefacts.llm.topk import OP3_SQL, op3_topk
from bytefacts.llm.token_counts import op5_token_counts

QUERIES = {
    "op1_piece_encoding": op1_piece_encoding,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_shards": op4_shards,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_pii": op9_pii,
    "op10_audio": op10_audio,
}

ORACLES: dict[str, str] = {
    "op3_topk": OP3_SQL,
    "op4_shards": OP4_SQL,
}
