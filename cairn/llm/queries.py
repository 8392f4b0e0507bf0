"""The registered queries of this folder and their DuckDB twins."""

from __future__ import annotations

from cairn.llm.bpe import op9_byte_bpe
from cairn.llm.credentials import op8_secret_scan
from cairn.llm.divergence import OP11_SQL, op11_source_divergence
from cairn.llm.langid import op7_language_id
from cairn.llm.neighbours import op10_adaptive_scan
from cairn.llm.packing import op2_length_buckets
from cairn.llm.pii import op6_contextual_pii
from cairn.llm.quality import OP1_SQL, op1_quality_rules
from cairn.llm.simhash import op4_simhash_golay
from cairn.llm.substring import op3_substring_dedup
from cairn.llm.trie import OP12_SQL, op12_conversation_trie
from cairn.llm.urls import OP13_SQL, op13_url_filter
from cairn.llm.warc import OP5_SQL, op5_merkle_fixity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_length_buckets": op2_length_buckets,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_merkle_fixity": op5_merkle_fixity,
    "op6_contextual_pii": op6_contextual_pii,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_adaptive_scan": op10_adaptive_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_url_filter": op13_url_filter,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op5_merkle_fixity": OP5_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
