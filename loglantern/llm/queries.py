"""The queries of the subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from loglantern.llm.exact_dups import op11_exact_dups
from loglantern.llm.hard_negatives import op13_hard_negatives
from loglantern.llm.host_rules import op5_host_rules
from loglantern.llm.lexical_search import op12_lexical_search
from loglantern.llm.mixing import op9_mixing
from loglantern.llm.near_dups import op10_near_dups
from loglantern.llm.oracle import ORACLE
from loglantern.llm.passages import op4_passages
from loglantern.llm.pieces import op6_pieces
from loglantern.llm.quality_net import op1_quality_net
from loglantern.llm.sharding import op8_sharding
from loglantern.llm.token_counts import op2_token_counts
from loglantern.llm.toxicity import op7_toxicity
from loglantern.llm.vector_links import op3_vector_links

QUERIES = {
    "op1_quality_net": op1_quality_net,
    "op2_token_counts": op2_token_counts,
    "op3_vector_links": op3_vector_links,
    "op4_passages": op4_passages,
    "op5_host_rules": op5_host_rules,
    "op6_pieces": op6_pieces,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_near_dups": op10_near_dups,
    "op11_exact_dups": op11_exact_dups,
    "op12_lexical_search": op12_lexical_search,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLE", "QUERIES"]
