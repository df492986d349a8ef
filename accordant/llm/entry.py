"""The queries of this subpackage and the SQL that they are held against."""

from accordant.llm import decontamination, embedding_dedup, minhash_dedup, warc_revisit
from accordant.llm.best_fit_packing import op4_best_fit_packing
from accordant.llm.decontamination import op8_decontamination
from accordant.llm.embedding_dedup import op6_embedding_dedup
from accordant.llm.html_extraction import op2_html_extraction
from accordant.llm.language_id import op7_language_id
from accordant.llm.minhash_dedup import op5_minhash_dedup
from accordant.llm.quality import op10_quality
from accordant.llm.suffix_array_dedup import op1_suffix_array_dedup
from accordant.llm.toxicity import op9_toxicity
from accordant.llm.warc_revisit import op3_warc_revisit

QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_html_extraction, op3_warc_revisit, op4_best_fit_packing, op5_minhash_dedup, op6_embedding_dedup, op7_language_id, op8_decontamination, op9_toxicity, op10_quality)}
ORACLES = {"op3_warc_revisit": warc_revisit.ORACLE_SQL, "op8_decontamination": decontamination.ORACLE_SQL, "op5_minhash_dedup": minhash_dedup.ORACLE_SQL, "op6_embedding_dedup": embedding_dedup.ORACLE_SQL}
