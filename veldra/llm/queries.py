"""The corpus operators' queries, under the names by which the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldra.llm.fill_in_middle import OP12_SQL, op12_counted_quantifiers
from veldra.llm.hard_negatives import OP11_SQL, op11_multi_index_negatives
from veldra.llm.jpeg import op4_jpeg_media
from veldra.llm.language_id import op3_language_codes
from veldra.llm.ngram_scores import op13_elias_fano_scores
from veldra.llm.packing import op2_best_fit_packing
from veldra.llm.pii import op10_pii_boosting
from veldra.llm.piece_bpe import op6_piece_backtracking
from veldra.llm.quality import op9_weak_label_quality
from veldra.llm.simhash import op7_simhash_segments
from veldra.llm.token_planes import op5_token_planes
from veldra.llm.topk_search import OP1_SQL, op1_topk_search
from veldra.llm.toxicity import op8_ordinal_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_codes": op3_language_codes,
    "op4_jpeg_media": op4_jpeg_media,
    "op5_token_planes": op5_token_planes,
    "op6_piece_backtracking": op6_piece_backtracking,
    "op7_simhash_segments": op7_simhash_segments,
    "op8_ordinal_toxicity": op8_ordinal_toxicity,
    "op9_weak_label_quality": op9_weak_label_quality,
    "op10_pii_boosting": op10_pii_boosting,
    "op11_multi_index_negatives": op11_multi_index_negatives,
    "op12_counted_quantifiers": op12_counted_quantifiers,
    "op13_elias_fano_scores": op13_elias_fano_scores,
}

#: Only what DuckDB can express over whole tables in reasonable time.
ORACLES: dict[str, str] = {"op1_topk_search": OP1_SQL, "op11_multi_index_negatives": OP11_SQL, "op12_counted_quantifiers": OP12_SQL}
