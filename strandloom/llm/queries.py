"""The registered queries of this folder: name -> (spark, sf_dir) -> DataFrame, and the SQL that must agree."""

from __future__ import annotations

from strandloom.llm import infill, rules, topk
from strandloom.llm.bitplanes import op2_bitplane_tokens
from strandloom.llm.infill import op12_fill_in_middle
from strandloom.llm.mixing import op5_entropy_mixing
from strandloom.llm.ngrams import op13_ngram_join
from strandloom.llm.packing import op7_best_fit_packing
from strandloom.llm.pages import op3_page_differencing
from strandloom.llm.quality import op9_quality_trees
from strandloom.llm.quotes import op1_quotation_links
from strandloom.llm.rules import op10_rule_ledger
from strandloom.llm.simhash import op6_simhash_pigeonhole
from strandloom.llm.suffixes import op4_suffix_dedup
from strandloom.llm.topk import op8_exact_top_k
from strandloom.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_quotation_links": op1_quotation_links,
    "op2_bitplane_tokens": op2_bitplane_tokens,
    "op3_page_differencing": op3_page_differencing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_entropy_mixing": op5_entropy_mixing,
    "op6_simhash_pigeonhole": op6_simhash_pigeonhole,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_quality_trees": op9_quality_trees,
    "op10_rule_ledger": op10_rule_ledger,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ngram_join": op13_ngram_join,
}
ORACLES: dict[str, str] = {"op8_exact_top_k": topk.ORACLE, "op10_rule_ledger": rules.ORACLE, "op12_fill_in_middle": infill.ORACLE}
