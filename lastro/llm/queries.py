"""The registered queries of this subpackage and the SQL that expresses some of them."""

from __future__ import annotations

from lastro.llm.jaccard import JACCARD_SQL, op11_ngram_jaccard
from lastro.llm.lm_score import op1_lm_score
from lastro.llm.minhash import op6_minhash_dedup
from lastro.llm.mixing import MIX_SQL, op5_source_mix
from lastro.llm.packing import op8_packing
from lastro.llm.phrases import PHRASE_SQL, op12_phrase_collocations
from lastro.llm.quality import op7_quality_rules
from lastro.llm.quality_sql import QUALITY_SQL
from lastro.llm.runs import op13_periodic_runs
from lastro.llm.substring import op3_substring_dedup
from lastro.llm.token_counts import op10_token_counts
from lastro.llm.topk import TOP_K_SQL, op9_top_k
from lastro.llm.toxicity import op2_toxicity
from lastro.llm.warc import WARC_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_lm_score, op2_toxicity, op3_substring_dedup, op4_warc, op5_source_mix, op6_minhash_dedup, op7_quality_rules, op8_packing, op9_top_k, op10_token_counts, op11_ngram_jaccard, op12_phrase_collocations, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op4_warc": WARC_SQL, "op5_source_mix": MIX_SQL, "op7_quality_rules": QUALITY_SQL, "op9_top_k": TOP_K_SQL, "op11_ngram_jaccard": JACCARD_SQL, "op12_phrase_collocations": PHRASE_SQL}
