"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from runledger.llm.decontam import OP3_SQL, op3_query
from runledger.llm.html_text import op10_query
from runledger.llm.langid import op9_query
from runledger.llm.line_dedup import OP5_SQL, op5_query
from runledger.llm.near_dup import OP4_SQL, op4_query
from runledger.llm.packing import op6_query
from runledger.llm.quality import op8_query
from runledger.llm.sharding import op1_query
from runledger.llm.url_filters import OP2_SQL, op2_query
from runledger.llm.warc import OP7_SQL, op7_query

QUERIES = {
    "op1_kk_sharding": op1_query,
    "op2_url_filters": op2_query,
    "op3_greedy_tiling": op3_query,
    "op4_tensored_minhash": op4_query,
    "op5_line_dedup": op5_query,
    "op6_sum_of_squares_packing": op6_query,
    "op7_capture_index": op7_query,
    "op8_quality_rules": op8_query,
    "op9_language_id": op9_query,
    "op10_consensus_paths": op10_query,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op3_greedy_tiling": OP3_SQL,
    "op4_tensored_minhash": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_capture_index": OP7_SQL,
}
