"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from lagweave.llm import exact_dedup, licenses, mixing, ngram_join, packing, pii, quality_rules, toxicity, url_templates, warc_archive

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_pareto_mix": mixing.op2_pareto_mix,
    "op3_bilstm_crf": pii.op3_bilstm_crf,
    "op4_line_frequency": quality_rules.op4_line_frequency,
    "op5_nearest_toxic": toxicity.op5_nearest_toxic,
    "op6_content_addressed_warc": warc_archive.op6_content_addressed_warc,
    "op7_path_templates": url_templates.op7_path_templates,
    "op8_patience_licenses": licenses.op8_patience_licenses,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_bounded_packing": packing.op10_bounded_packing,
}
ORACLES = {"op4_line_frequency": quality_rules.OP4_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL}
