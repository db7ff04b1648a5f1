"""The queries of this subpackage and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from loomgraph.llm import decontaminate, jaccard_join, warc
from loomgraph.llm.decontaminate import op3_decontamination
from loomgraph.llm.fingerprint import op4_fingerprint
from loomgraph.llm.html_extract import op2_html_extraction
from loomgraph.llm.jaccard_join import op1_ngram_jaccard_join
from loomgraph.llm.packing import op7_packing
from loomgraph.llm.quality import op9_quality
from loomgraph.llm.token_count import op10_token_count
from loomgraph.llm.toxicity import op6_toxicity
from loomgraph.llm.warc import op8_warc
from loomgraph.llm.token_store import op5_token_store

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_fingerprint": op4_fingerprint,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_token_count": op10_token_count,
}
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
}
