"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from siftwave.llm.bpe import op8_bpe
from siftwave.llm.cap_filters import op2_cap_filters
from siftwave.llm.chat_format import OP7_SQL, op7_chat_format
from siftwave.llm.collocations import OP11_SQL, op11_collocations
from siftwave.llm.decontam import OP3_SQL, op3_decontamination
from siftwave.llm.language_id import op1_language_id
from siftwave.llm.licenses import op4_license_scan
from siftwave.llm.line_dedup import OP10_SQL, op10_line_dedup
from siftwave.llm.periodic_runs import op13_periodic_runs
from siftwave.llm.sharding import op9_sharding
from siftwave.llm.shingle_join import OP6_SQL, op6_ngram_jaccard
from siftwave.llm.suffix_dedup import OP12_SQL, op12_suffix_dedup
from siftwave.llm.url_filter import op5_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_cap_filters": op2_cap_filters,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_chat_format": op7_chat_format,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op3_decontamination": OP3_SQL, "op6_ngram_jaccard": OP6_SQL, "op7_chat_format": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op12_suffix_dedup": OP12_SQL}
