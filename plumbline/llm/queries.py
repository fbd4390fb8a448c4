"""The queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from . import chat, decontam, embed_dedup, licenses, mixing, ngram_join, quality, secrets, sharding, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality": quality.op2_quality,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_ngram_jaccard": ngram_join.op4_ngram_jaccard,
    "op5_format_chats": chat.op5_format_chats,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_warc_audit": warc.op8_warc_audit,
    "op9_hilbert_shards": sharding.op9_hilbert_shards,
    "op10_embedding_dedup": embed_dedup.op10_embedding_dedup,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op4_ngram_jaccard": ngram_join.ORACLE,
    "op5_format_chats": chat.ORACLE,
    "op6_license_scan": licenses.oracle(),
    "op8_warc_audit": warc.ORACLE,
    "op10_embedding_dedup": embed_dedup.ORACLE,
}
