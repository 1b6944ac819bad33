"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quizmill.llm.alignment import op11_token_alignment
from quizmill.llm.decontaminate import op9_latent_decontamination
from quizmill.llm.dialogue import op12_conversation_repair
from quizmill.llm.edit_fingerprint import op6_edit_fingerprint
from quizmill.llm.importance import op2_importance_resampling
from quizmill.llm.line_dedup import OP4_SQL, op4_line_dedup
from quizmill.llm.mixing import OP8_SQL, op8_source_mixing
from quizmill.llm.ngram_join import op10_ngram_jaccard_join
from quizmill.llm.secret_scan import op1_secret_scan
from quizmill.llm.sharding import OP7_SQL, op7_hash_tree_sharding
from quizmill.llm.token_counts import op13_token_counts
from quizmill.llm.toxicity import op3_toxicity_cnn
from quizmill.llm.warc import OP5_SQL, op5_warc_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_importance_resampling, op3_toxicity_cnn, op4_line_dedup, op5_warc_index,
        op6_edit_fingerprint, op7_hash_tree_sharding, op8_source_mixing, op9_latent_decontamination, op10_ngram_jaccard_join,
        op11_token_alignment, op12_conversation_repair, op13_token_counts,
    )
}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op5_warc_index": OP5_SQL, "op7_hash_tree_sharding": OP7_SQL, "op8_source_mixing": OP8_SQL}
