"""The queries of this subpackage, as `__spark_entry__` registers them."""

from __future__ import annotations

import corpus_pipeline
from regdelta.llm.bpe import op7_byte_bpe
from regdelta.llm.conversation_trie import OP12_SQL, op12_conversation_trie
from regdelta.llm.decontaminate import op6_decontaminate
from regdelta.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from regdelta.llm.langid import op1_language_id
from regdelta.llm.licenses import op10_license_scan
from regdelta.llm.mixing import OP13_SQL, op13_source_mix
from regdelta.llm.quality import op3_quality
from regdelta.llm.resampling import op11_importance_resampling
from regdelta.llm.simhash import op5_simhash
from regdelta.llm.token_counts import op4_token_counts
from regdelta.llm.toxicity import op8_toxicity
from regdelta.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_mix": op13_source_mix,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_source_mix": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
