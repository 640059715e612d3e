"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import op1_line_quality as op1
from . import op2_additive_ann as op2
from . import op3_toxicity as op3
from . import op4_sentencepiece as op4
from . import op5_jaccard_join as op5
from . import op6_suffix_dedup as op6
from . import op7_language_id as op7
from . import op8_debruijn_dedup as op8
from . import op9_mixing as op9
from . import op10_sharding as op10
from . import op11_merkle_manifest as op11
from . import op12_prefix_trie as op12
from . import op13_pivot_search as op13

QUERIES = {
    "op1_line_quality": op1.op1_line_quality,
    "op2_additive_ann": op2.op2_additive_ann,
    "op3_toxicity": op3.op3_toxicity,
    "op4_sentencepiece": op4.op4_sentencepiece,
    "op5_jaccard_join": op5.op5_jaccard_join,
    "op6_suffix_dedup": op6.op6_suffix_dedup,
    "op7_language_id": op7.op7_language_id,
    "op8_debruijn_dedup": op8.op8_debruijn_dedup,
    "op9_mixing": op9.op9_mixing,
    "op10_sharding": op10.op10_sharding,
    "op11_merkle_manifest": op11.op11_merkle_manifest,
    "op12_prefix_trie": op12.op12_prefix_trie,
    "op13_pivot_search": op13.op13_pivot_search,
}
ORACLES = {
    "op1_line_quality": op1.oracle(),
    "op5_jaccard_join": op5.oracle(),
    "op6_suffix_dedup": op6.oracle(),
    "op8_debruijn_dedup": op8.oracle(),
    "op11_merkle_manifest": op11.oracle(),
    "op12_prefix_trie": op12.oracle(),
    "op13_pivot_search": op13.oracle(),
}
