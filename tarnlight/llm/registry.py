"""The queries of this subpackage and the SQL that gives the same rows, by name."""

from __future__ import annotations

from .ann import op2_rp_forest
from .chat import SQL_OP9, op9_chat_format
from .langid import op1_language_id
from .licenses import SQL_OP8, op8_license_join
from .mixing import SQL_OP4, op4_pareto_mix
from .ngram_join import op5_ngram_jaccard
from .packing import op3_length_buckets
from .sharding import op6_external_shuffle
from .toxicity import op10_kneser_ney
from .vector_dedup import op7_pivot_permutation

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_rp_forest": op2_rp_forest,
    "op3_length_buckets": op3_length_buckets,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_external_shuffle": op6_external_shuffle,
    "op7_pivot_permutation": op7_pivot_permutation,
    "op8_license_join": op8_license_join,
    "op9_chat_format": op9_chat_format,
    "op10_kneser_ney": op10_kneser_ney,
}

SQL: dict[str, str] = {
    "op4_pareto_mix": SQL_OP4,
    "op8_license_join": SQL_OP8,
    "op9_chat_format": SQL_OP9,
}
