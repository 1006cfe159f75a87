"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontam, hamming, neardup, pii, quality, token_shards, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1,
    "op2_toxicity": toxicity.op2,
    "op3_hamming_topk": hamming.op3,
    "op4_chat_format": chat_format.op4,
    "op5_token_shards": token_shards.op5,
    "op6_quality": quality.op6,
    "op7_minhash_neardup": neardup.op7,
    "op8_byte_bpe": byte_bpe.op8,
    "op9_decontamination": decontam.op9,
    "op10_warc": warc.op10,
}

ORACLE_SQL = {
    "op3_hamming_topk": hamming.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op9_decontamination": decontam.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}
