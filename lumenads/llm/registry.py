"""Queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from lumenads.llm.alignment import op11_alignment
from lumenads.llm.language import op5_language
from lumenads.llm.mixing import op4_mixing
from lumenads.llm.neighbours import op3_neighbours
from lumenads.llm.packing import op1_packing
from lumenads.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from lumenads.llm.quality import op9_quality
from lumenads.llm.simhash import op2_simhash
from lumenads.llm.sketch import op8_sketch
from lumenads.llm.token_counts import op7_token_counts
from lumenads.llm.token_files import op10_token_files
from lumenads.llm.toxicity import op6_toxicity
from lumenads.llm.url_filters import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_neighbours": op3_neighbours,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_sketch": op8_sketch,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_url_filters": op12_url_filters,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op12_url_filters": OP12_SQL, "op13_prefix_trie": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
