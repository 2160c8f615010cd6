"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from spectrail.llm.html import op1_main_text
from spectrail.llm.language import op3_language
from spectrail.llm.lexical import op13_search, op13_sql
from spectrail.llm.licences import op6_licences, op6_sql
from spectrail.llm.mixing import op2_mix, op2_sql
from spectrail.llm.neardup import op4_neardup, op4_sql
from spectrail.llm.packing import op10_pack
from spectrail.llm.personal import op12_personal
from spectrail.llm.quality import op7_quality
from spectrail.llm.secrets import op5_secrets
from spectrail.llm.substrings import op8_substrings, op8_sql
from spectrail.llm.trie import op11_trie, op11_sql
from spectrail.llm.vectors import op9_vectors, op9_sql

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_mix": op2_mix,
    "op3_language": op3_language,
    "op4_neardup": op4_neardup,
    "op5_secrets": op5_secrets,
    "op6_licences": op6_licences,
    "op7_quality": op7_quality,
    "op8_substrings": op8_substrings,
    "op9_vectors": op9_vectors,
    "op10_pack": op10_pack,
    "op11_trie": op11_trie,
    "op12_personal": op12_personal,
    "op13_search": op13_search,
}
ORACLES = {
    "op2_mix": op2_sql(),
    "op4_neardup": op4_sql(),
    "op6_licences": op6_sql(),
    "op8_substrings": op8_sql(),
    "op9_vectors": op9_sql(),
    "op11_trie": op11_sql(),
    "op13_search": op13_sql(),
}
