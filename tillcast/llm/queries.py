"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from tillcast.llm.collocations import OP12_SQL, op12_collocations
from tillcast.llm.decontaminate import OP13_SQL, op13_decontaminate
from tillcast.llm.language_id import op7_language_id
from tillcast.llm.lexical_search import OP11_SQL, op11_lexical_search
from tillcast.llm.line_dedup import OP8_SQL, op8_line_dedup
from tillcast.llm.packing import op10_packing
from tillcast.llm.pivot_topk import OP2_SQL, op2_exact_topk
from tillcast.llm.repetition import op5_quality_rules
from tillcast.llm.secret_scan import op6_secret_scans
from tillcast.llm.sentence_pieces import op9_sentencepiece, op9_sentencepiece_documents
from tillcast.llm.shingle_join import op3_ngram_jaccard
from tillcast.llm.toxicity import op4_toxicity
from tillcast.llm.url_filter import op1_url_filters

QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_exact_topk, op3_ngram_jaccard, op4_toxicity, op5_quality_rules, op6_secret_scans,
    op7_language_id, op8_line_dedup, op9_sentencepiece_documents, op9_sentencepiece, op10_packing, op11_lexical_search, op12_collocations,
    op13_decontaminate)}

#: DuckDB SQL of the queries that SQL can state.
ORACLE: dict[str, str] = {"op2_exact_topk": OP2_SQL, "op8_line_dedup": OP8_SQL, "op11_lexical_search": OP11_SQL,
                          "op12_collocations": OP12_SQL, "op13_decontaminate": OP13_SQL}
