"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from couponlab.llm import oracles
from couponlab.llm.byte_bpe import op5_byte_bpe
from couponlab.llm.chat_format import op3_chat_format
from couponlab.llm.language import op6_language_id
from couponlab.llm.neighbours_scan import op7_dimension_scan
from couponlab.llm.piece_bpe import op11_piece_bpe
from couponlab.llm.quality import op9_quality
from couponlab.llm.repeats import op10_suffix_dedup
from couponlab.llm.secret_scan import op1_secret_scan
from couponlab.llm.simhash import op8_simhash
from couponlab.llm.source_divergence import op13_source_divergence
from couponlab.llm.token_counts import op2_token_counts
from couponlab.llm.whitening import op12_whitening
from couponlab.llm.winnowing import op4_winnowing

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_token_counts,
        op3_chat_format,
        op4_winnowing,
        op5_byte_bpe,
        op6_language_id,
        op7_dimension_scan,
        op8_simhash,
        op9_quality,
        op10_suffix_dedup,
        op11_piece_bpe,
        op12_whitening,
        op13_source_divergence,
    )
}

ORACLES = {
    "op1_secret_scan": oracles.SECRETS,
    "op3_chat_format": oracles.CHATS,
    "op4_winnowing": oracles.WINDOWS,
    "op13_source_divergence": oracles.DIVERGENCES,
}
