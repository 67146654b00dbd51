"""The queries of this subpackage and, where SQL can express one, its oracle."""

from . import fingerprints, jaccard_join, licenses, neighbours, oracles, packing, quality, sentencepieces, suffix_array, suffix_trees, url_filter

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_substring_dedup": suffix_trees.op3_substring_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_sentencepiece": sentencepieces.op5_sentencepiece,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_suffix_array_dedup": suffix_array.op7_suffix_array_dedup,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
    "op10_license_scan": licenses.op10_license_scan,
}

ORACLE = oracles.ORACLE
