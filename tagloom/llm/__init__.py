"""Operators for training-data pipelines over documents and pages."""

MODULES = (
    "op01_sharding", "op02_token_counts", "op03_url_filters", "op04_quality", "op05_packing", "op06_ngram_join", "op07_toxicity",
    "op08_line_dedup", "op09_quality_rules", "op10_decontamination", "op11_spelling", "op12_merkle", "op13_exact_dedup",
)
