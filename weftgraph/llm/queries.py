"""The training-data queries of the driver's contract and their SQL."""

from __future__ import annotations

from weftgraph.llm.ann import op4_ann
from weftgraph.llm.bpe import op8_bpe
from weftgraph.llm.decontaminate import OP6_SQL, op6_decontaminate
from weftgraph.llm.html_extract import op7_html
from weftgraph.llm.jaccard_join import OP9_SQL, op9_jaccard_join
from weftgraph.llm.langid import op2_language
from weftgraph.llm.licenses import OP5_SQL, op5_licenses
from weftgraph.llm.quality import op1_quality
from weftgraph.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from weftgraph.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ann": op4_ann,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_html": op7_html,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL,
    "op5_licenses": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op9_jaccard_join": OP9_SQL,
}
